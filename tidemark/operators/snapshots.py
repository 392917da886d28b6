"""Training snapshots of all symbols at once: bars with news of the last days, features, and labels of later bars.

Feature columns are checked by name: an allow list of market words, and a contract of eleven columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W

#: Shares of up to 17 words are whole numbers of this: the least common multiple of 1 to 17.
SHARE = 12252240

#: Columns that echo a model, columns and parts of names that tell the outcome, and words of market features.
ECHOES = (
    "feature_probability_up", "feature_probability_up_delta_from_last_signal", "feature_previous_recommendation_buy", "feature_recommendation_changed",
    "feature_symbol_buy_count_7d", "feature_symbol_sell_count_7d", "feature_symbol_signal_count_7d", "feature_days_since_last_signal",
)
TELLING = ("return_5d", "label_up_5d", "label_asof_date", "feature_return_5d", "probability_up", "model_version", "recommendation")
TELLING_PARTS = ("future_", "forward_", "outcome_", "realized_return", "label_")
ORIGINS = ("feature_endpoint_", "feature_source_", "feature_rec_")
MARKET = (
    "lagged", "return", "rsi", "macd", "sma", "ema", "vwap", "trend", "volume", "liquidity", "volatility", "atr", "regime", "spy", "sector", "relative",
    "price_to_", "moving_average", "beta",
)
CONTRACT = (
    "feature_return_1d_lagged", "feature_return_5d_lagged", "feature_return_20d_lagged", "feature_rsi_14", "feature_macd_hist", "feature_volume_ratio_20d",
    "feature_price_vs_sma_20", "feature_volatility_20d", "feature_spy_return_5d", "feature_symbol_minus_spy_5d", "feature_market_regime_risk_on",
)
CONTRACT_FORBIDS = ("probability_up", "feature_rec_", "feature_source_", "future_", "forward_", "realized_return", "outcome_", "label_")


def news_columns(bars: DataFrame, news: DataFrame) -> DataFrame:
    """``bars`` with ``_ts``, their midnight (UTC), and the news of the day and the three days before it, both ends included.

    ``news`` has symbol, published_ts (seconds), weight (of its publisher, with two decimals) and tone (-1 to 1, a share of up to
    17 words). News without a time or a symbol go, and so do bars without a symbol or a day. Without news all columns are 0.
    To midnights all news between two of them are alike, so they are added up first: a symbol has two rows of news a day at most.
    Bars and these share one shuffle by ranges of symbols, and totals are differences of running totals. Rows are left in the
    order of (symbol, _ts), across partitions too: windows by both need no shuffle or sort of their own.
    """
    tone, weight = F.round(F.coalesce("tone", F.lit(0.0)) * SHARE).cast("long"), F.round(F.coalesce("weight", F.lit(0.0)) * 100).cast("long")
    published, past = F.col("published_ts"), F.pmod("published_ts", F.lit(86400))
    counted = news.where("symbol is not null and published_ts is not null").select("symbol", F.when(past == 0, published).otherwise(published - past + 1).alias("_ts"), F.lit(1).alias("_n"), weight.alias("_weight"), tone.alias("_tone"), (tone * weight).alias("_both"))
    counted = counted.groupBy("symbol", "_ts").agg(*(F.sum(c).alias(c) for c in ("_n", "_weight", "_tone", "_both")))
    dated = bars.where("symbol is not null and bar_date is not null").withColumn("_ts", F.unix_date("bar_date").cast("long") * 86400)
    moments = dated.unionByName(counted, allowMissingColumns=True).repartitionByRange("symbol")
    w = W.by_symbol(at="_ts")
    upto = lambda v, s: F.coalesce(F.sum(f"_{v}").over(w.rangeBetween(Window.unboundedPreceding, -s)), F.lit(0))
    last = {"24": (86401, ["n", "tone"]), "72": (259201, ["n", "weight", "tone", "both"])}
    totals = {f"_{v}_{name}": upto(v, 0) - upto(v, s) for name, (s, values) in last.items() for v in values}
    t = moments.withColumns(totals).where("bar_date is not null")
    mean = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 4)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a) / SHARE, F.col(b)), F.lit(0.0)), 4)
    weighted = F.when(F.col("_weight_72") > 0, share("_both_72", "_weight_72")).otherwise(0.0)
    t = t.withColumn("_weights", F.col("_weight_72") / 100)
    return t.select(
        *bars.columns, "_ts", weighted.alias("news_sentiment_score"), F.col("_n_24").cast("double").alias("news_headline_count_24h"), mean("_weights", "_n_72").alias("news_source_score_72h"),
        share("_tone_24", "_n_24").alias("news_momentum_24h"), share("_tone_72", "_n_72").alias("news_momentum_72h"),
    )


def indicators(bars: DataFrame, at: str = "bar_date") -> DataFrame:
    """Bars with return_1d, return_5d, rsi_14 (null without any loss), macd_hist from the first bar on, vol_ratio_20d."""
    w = W.by_symbol(at=at)
    delta = F.col("close_px") - F.lag("close_px").over(w)
    moved = bars.withColumns({"_gain": F.greatest(delta, F.lit(0.0)), "_loss": F.greatest(-delta, F.lit(0.0)), "_known": delta.isNotNull()})
    moved = moved.withColumns({c: F.when(F.col("_known"), F.col(c)) for c in ("_gain", "_loss")})
    strength = W.safe_ratio(W.moving_average("_gain", 14, w), W.moving_average("_loss", 14, w))
    out = moved.withColumns({"return_1d": W.lagged_return("close_px", 1, w), "return_5d": W.lagged_return("close_px", 5, w), "rsi_14": 100 - 100 / (1 + strength), "vol_ratio_20d": W.safe_ratio(F.col("volume"), W.moving_average("volume", 20, w))})
    lines = W.with_ema_in_place(out.drop("_gain", "_loss", "_known"), {"_fast": ("close_px", 12), "_slow": ("close_px", 26), "_signal": (("_fast", "_slow"), 9)}, at=at)
    return lines.withColumn("macd_hist", F.col("_fast") - F.col("_slow") - F.col("_signal")).drop("_fast", "_slow", "_signal")


def training_snapshot(bars: DataFrame, news: DataFrame, horizon: int = 5, target: float = 0.0) -> DataFrame:
    """One row for each bar of every symbol, by (symbol, bar_date): news columns, indicators, forward return and label.

    A bar whose horizon lies beyond the last bar has no forward return, and label 0. ``bars`` has one row for each (symbol,
    bar_date), close_px and volume. Rows keep the order that ``news_columns`` gives them, so nothing is sorted at the end.
    """
    ahead = f"forward_return_{horizon}d"
    told = news_columns(bars.select("symbol", "bar_date", "close_px", "volume"), news)
    # Averages come last: a window behind them would shuffle once more.
    f = indicators(told.withColumn(ahead, W.forward_return("close_px", horizon, W.by_symbol(at="_ts"))), at="_ts")
    f = f.withColumn(f"label_up_{horizon}d", F.coalesce(F.col(ahead) > target, F.lit(False)).cast("double"))
    tail = [ahead, f"label_up_{horizon}d", *(c for c in f.columns if c.startswith("news_"))]
    return f.select("symbol", "bar_date", *(c for c in f.columns if c not in ("symbol", "bar_date", "_ts", *tail)), *tail)


def is_market_feature(name: str) -> bool:
    """Whether a column's name may be a market feature: no echo of a model, no outcome, no origin, and a market word."""
    low = name.lower()
    told = name in ECHOES or name in TELLING or any(part in low for part in TELLING_PARTS)
    return low.startswith("feature_") and not told and not low.startswith(ORIGINS) and any(word in low for word in MARKET)


def market_features(frame: DataFrame) -> DataFrame:
    """feature, n: columns of ``frame`` that may be market features and hold n > 0 numbers; only these columns are read.

    Text that reads as a number is one; NaN is none. Names that differ by case only are ambiguous to Spark: give each once.
    """
    names = sorted(c for c in frame.columns if is_market_feature(c))
    if not names:
        return frame.sparkSession.createDataFrame([], "feature string, n long")
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    counts = frame.agg(*(F.count(F.when(number(c).isNotNull() & ~F.isnan(number(c)), 1)).alias(f"n{i}") for i, c in enumerate(names)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names))))).where("n > 0")


def contract_breach(name: Column) -> Column:
    """Why a column breaks the contract of features: forbidden (part of its name), unlisted; null where it keeps it."""
    low = F.lower(name)
    forbidden = F.lit(False)
    for part in CONTRACT_FORBIDS:
        forbidden = forbidden | F.contains(low, F.lit(part))
    return F.when(forbidden, "forbidden").when(~name.isin(*CONTRACT), "unlisted")
