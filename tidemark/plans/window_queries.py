"""Queries of the time-series windows over daily bars and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..sources import market as M
from .registry import query

_BARS = M.with_views("bars")
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)"


def _f(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _shown(df: DataFrame, **columns) -> DataFrame:
    return df.select("symbol", "bar_date", *[F.round(c, 6).alias(k) for k, c in columns.items()])


@query("win01_lagged_return", _BARS + f"""SELECT symbol, bar_date, round(close_px / lag(close_px, 1) OVER w - 1, 6) AS ret_1, round(close_px / lag(close_px, 5) OVER w - 1, 6) AS ret_5,
  round(close_px / lag(close_px, 20) OVER w - 1, 6) AS ret_20 FROM bars {_W}""")  # fmt: skip
def lagged_returns(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    return _shown(M.bars(spark, d), ret_1=W.lagged_return("close_px", 1, w), ret_5=W.lagged_return("close_px", 5, w), ret_20=W.lagged_return("close_px", 20, w))


@query("win02_moving_average", _BARS + f"""SELECT symbol, bar_date, round(CASE WHEN count(close_px) {_f(20)} = 20 THEN avg(close_px) {_f(20)} END, 6) AS sma_20,
  round(CASE WHEN count(close_px) {_f(50)} = 50 THEN avg(close_px) {_f(50)} END, 6) AS sma_50 FROM bars""")  # fmt: skip
def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    return _shown(M.bars(spark, d), sma_20=W.moving_average("close_px", 20, w), sma_50=W.moving_average("close_px", 50, w))


@query("win03_rolling_extremes", _BARS + f"""SELECT symbol, bar_date, round(CASE WHEN count(high_px) {_f(20)} = 20 THEN max(high_px) {_f(20)} END, 6) AS high_20,
  round(CASE WHEN count(low_px) {_f(20)} = 20 THEN min(low_px) {_f(20)} END, 6) AS low_20 FROM bars""")  # fmt: skip
def rolling_extremes(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    return _shown(M.bars(spark, d), high_20=W.rolling_max("high_px", 20, w), low_20=W.rolling_min("low_px", 20, w))


@query("win04_z_score", _BARS + f"""SELECT symbol, bar_date, round(CASE WHEN count(close_px) {_f(20)} = 20 THEN CASE WHEN max(close_px) {_f(20)} = min(close_px) {_f(20)} THEN 0e0
  ELSE (close_px - avg(close_px) {_f(20)}) / stddev_pop(close_px) {_f(20)} END END, 6) AS z_20 FROM bars""")  # fmt: skip
def z_scores(spark: SparkSession, d: str) -> DataFrame:
    return _shown(M.bars(spark, d), z_20=W.z_score("close_px", 20, W.by_symbol()))


_RET = M.with_views("bars", more=f"r AS (SELECT *, close_px / lag(close_px) OVER w - 1 AS ret, close_px - lag(close_px) OVER w AS delta FROM bars {_W})")


def _with_returns(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    return M.bars(spark, d).withColumns({"ret": W.lagged_return("close_px", 1, w), "delta": F.col("close_px") - F.lag("close_px").over(w)})


@query("win05_volatility", _RET + f"SELECT symbol, bar_date, round(CASE WHEN count(ret) {_f(20)} = 20 THEN stddev_pop(ret) {_f(20)} END, 6) AS vol_20 FROM r")
def volatility(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_with_returns(spark, d), vol_20=W.rolling_volatility("ret", 20, W.by_symbol()))


_GAIN, _LOSS = f"avg(greatest(delta, 0e0)) {_f(14)}", f"avg(greatest(-delta, 0e0)) {_f(14)}"


@query("win06_rsi", _RET + f"SELECT symbol, bar_date, round(CASE WHEN count(delta) {_f(14)} = 14 THEN CASE WHEN {_LOSS} = 0 THEN 100e0 ELSE 100 - 100 / (1 + {_GAIN} / {_LOSS}) END END, 6) AS rsi_14 FROM r")
def rsi(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_with_returns(spark, d), rsi_14=W.rsi("delta", 14, W.by_symbol()))


@query("win07_rsi_variants", _RET + f"""SELECT symbol, bar_date,
  round(CASE WHEN count(delta) {_f(14)} = 14 AND {_LOSS} <> 0 THEN 100 - 100 / (1 + {_GAIN} / {_LOSS}) END, 6) AS rsi_null,
  round(CASE WHEN count(delta) {_f(14)} = 14 THEN CASE WHEN {_LOSS} = 0 THEN CASE WHEN {_GAIN} = 0 THEN 50e0 ELSE 100e0 END ELSE 100 - 100 / (1 + {_GAIN} / {_LOSS}) END END, 6) AS rsi_fifty FROM r""")  # fmt: skip
def rsi_variants(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    return _shown(_with_returns(spark, d), rsi_null=W.rsi("delta", 14, w, "null"), rsi_fifty=W.rsi("delta", 14, w, "fifty"))


def _ema_sql(source: str, value: str, span: int, name: str) -> str:
    a = f"(2e0 / {span + 1})"
    return f"""{name} AS (SELECT symbol, i, {value} AS v FROM {source} WHERE i = 1 UNION ALL
  SELECT s.symbol, s.i, e.v * (1 - {a}) + s.{value} * {a} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.i = e.i + 1)"""


_INDEXED = M.with_views("bars", more=f"b AS (SELECT *, row_number() OVER w AS i FROM bars {_W})").replace("WITH ", "WITH RECURSIVE ", 1).rstrip("\n")


@query("win08_ema", _INDEXED + ",\n" + _ema_sql("b", "close_px", 12, "e12") + ",\n" + _ema_sql("b", "close_px", 26, "e26") + """
SELECT b.symbol, b.bar_date, round(CASE WHEN b.i >= 12 THEN e12.v END, 6) AS ema_12, round(CASE WHEN b.i >= 26 THEN e26.v END, 6) AS ema_26
FROM b JOIN e12 ON b.symbol = e12.symbol AND b.i = e12.i JOIN e26 ON b.symbol = e26.symbol AND b.i = e26.i""")  # fmt: skip
def ema(spark: SparkSession, d: str) -> DataFrame:
    b = W.with_ema(M.bars(spark, d).withColumn("i", F.row_number().over(W.by_symbol())).select("symbol", "bar_date", "close_px", "i"), {"fast": ("close_px", 12), "slow": ("close_px", 26)})
    return _shown(b, ema_12=F.when(F.col("i") >= 12, F.col("fast")), ema_26=F.when(F.col("i") >= 26, F.col("slow")))


@query("win09_macd", _INDEXED + ",\n" + _ema_sql("b", "close_px", 12, "e12") + ",\n" + _ema_sql("b", "close_px", 26, "e26") + """,
m AS (SELECT b.symbol, b.bar_date, b.i - 24 AS i, e12.v - e26.v AS macd FROM b JOIN e12 ON b.symbol = e12.symbol AND b.i = e12.i JOIN e26 ON b.symbol = e26.symbol AND b.i = e26.i WHERE b.i >= 25),
""" + _ema_sql("m", "macd", 9, "sig") + """
SELECT m.symbol, m.bar_date, round(m.macd, 6) AS macd, round(CASE WHEN m.i >= 9 THEN sig.v END, 6) AS signal, round(CASE WHEN m.i >= 9 THEN m.macd - sig.v END, 6) AS hist
FROM m JOIN sig ON m.symbol = sig.symbol AND m.i = sig.i""")  # fmt: skip
def macd(spark: SparkSession, d: str) -> DataFrame:
    return _shown(macd_lines(M.bars(spark, d)).where("i >= 25"), macd=F.col("macd"), signal=F.col("signal"), hist=F.col("macd") - F.col("signal"))


def macd_lines(bars: DataFrame) -> DataFrame:
    """symbol, bar_date, close_px, i, macd from the 25th bar on, signal from the ninth of these on."""
    b = bars.select("symbol", "bar_date", "close_px").withColumn("i", F.row_number().over(W.by_symbol()))
    lines = W.with_ema(b, {"fast": ("close_px", 12), "slow": ("close_px", 26)})
    lines = lines.withColumn("macd", F.when(F.col("i") >= 25, F.col("fast") - F.col("slow")))
    # The signal starts at the first value of macd: nulls before it leave the average alone.
    lines = W.with_ema(lines, {"signal": ("macd", 9)})
    return lines.select("symbol", "bar_date", "close_px", "i", "macd", F.when(F.col("i") >= 33, F.col("signal")).alias("signal"))


@query("win10_atr", M.with_views("bars", more=f"t AS (SELECT *, CASE WHEN lag(close_px) OVER w IS NOT NULL THEN greatest(high_px - low_px, abs(high_px - lag(close_px) OVER w), abs(low_px - lag(close_px) OVER w)) END AS tr FROM bars {_W})")
    + f"SELECT symbol, bar_date, round(CASE WHEN count(tr) {_f(14)} = 14 THEN avg(tr) {_f(14)} END, 6) AS atr_14 FROM t")
def atr(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    ranged = M.bars(spark, d).withColumn("tr", W.true_range("high_px", "low_px", "close_px", w))
    return _shown(ranged, atr_14=W.average_true_range("tr", 14, w))


@query("win11_vwap", _BARS + f"SELECT symbol, bar_date, round(CASE WHEN count(close_px) {_f(20)} = 20 THEN sum(close_px * volume) {_f(20)} / nullif(sum(volume) {_f(20)}, 0) END + 1e-9, 6) AS vwap_20 FROM bars")
def vwap(spark: SparkSession, d: str) -> DataFrame:
    return M.bars(spark, d).select("symbol", "bar_date", F.round(W.vwap("close_px", "volume", 20, W.by_symbol()) + 1e-9, 6).alias("vwap_20"))


@query("win12_slope", M.with_views("bars", more=f"b AS (SELECT *, row_number() OVER w AS i FROM bars {_W})")
    + f"SELECT symbol, bar_date, round(CASE WHEN count(close_px) {_f(10)} = 10 THEN covar_pop(i, close_px) {_f(10)} / var_pop(i) {_f(10)} / first_value(close_px) {_f(10)} END, 6) AS slope_10 FROM b")
def slope(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    return _shown(M.bars(spark, d).withColumn("i", F.row_number().over(w)), slope_10=W.relative_slope("close_px", "i", 10, w))


_BENCH_RET = "s AS (SELECT bar_date, close_px / lag(close_px) OVER (ORDER BY bar_date) - 1 AS bench_ret, close_px / lag(close_px, 5) OVER (ORDER BY bar_date) - 1 AS bench_ret5, CASE WHEN count(close_px) OVER (ORDER BY bar_date ROWS 19 PRECEDING) = 20 THEN avg(close_px) OVER (ORDER BY bar_date ROWS 19 PRECEDING) END AS bench_sma20, close_px AS bench_close FROM bench)"


def benchmark_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per calendar day of the benchmark: as many as there are days, so one window over all is bounded."""
    w = Window.partitionBy("series").orderBy("bar_date")
    b = M.bench(spark, d).withColumn("series", F.lit(1))
    return b.select("bar_date", F.col("close_px").alias("bench_close"), W.lagged_return("close_px", 1, w).alias("bench_ret"), W.lagged_return("close_px", 5, w).alias("bench_ret5"), W.moving_average("close_px", 20, w).alias("bench_sma20"))


@query("win14_regime", M.with_views("bench", more=_BENCH_RET) + "SELECT bar_date, CASE WHEN bench_ret5 > 0 AND bench_close >= bench_sma20 THEN 1 ELSE 0 END AS regime FROM s WHERE bench_sma20 IS NOT NULL")
def regime(spark: SparkSession, d: str) -> DataFrame:
    up = (F.col("bench_ret5") > 0) & (F.col("bench_close") >= F.col("bench_sma20"))
    return benchmark_features(spark, d).where("bench_sma20 is not null").select("bar_date", F.when(up, 1).otherwise(0).alias("regime"))


@query("win16_derived", _BARS + f"""SELECT symbol, bar_date, round(open_px / lag(close_px) OVER w - 1, 6) AS gap,
  round(close_px / CASE WHEN count(high_px) {_f(20)} = 20 THEN max(high_px) {_f(20)} END - 1, 6) AS from_high_20,
  round(close_px / CASE WHEN count(low_px) {_f(20)} = 20 THEN min(low_px) {_f(20)} END - 1, 6) AS from_low_20,
  round(close_px / CASE WHEN count(close_px) {_f(20)} = 20 THEN avg(close_px) {_f(20)} END - 1, 6) AS vs_sma_20,
  round(volume / nullif(CASE WHEN count(volume) {_f(20)} = 20 THEN avg(volume) {_f(20)} END, 0), 6) AS relative_volume,
  round(close_px * volume, 6) AS dollar_volume FROM bars {_W}""")  # fmt: skip
def derived(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    close, volume = F.col("close_px"), F.col("volume")
    return _shown(
        M.bars(spark, d),
        gap=W.safe_ratio(F.col("open_px"), F.lag("close_px").over(w)) - 1,
        from_high_20=close / W.rolling_max("high_px", 20, w) - 1,
        from_low_20=close / W.rolling_min("low_px", 20, w) - 1,
        vs_sma_20=close / W.moving_average("close_px", 20, w) - 1,
        relative_volume=W.safe_ratio(volume, W.moving_average("volume", 20, w)),
        dollar_volume=close * volume,
    )


@query("win18_forward_label", _BARS + f"""SELECT symbol, bar_date, round(lead(close_px, 5) OVER w / close_px - 1, 6) AS fwd_5,
  CASE WHEN lead(close_px, 5) OVER w / close_px - 1 > 0.01 THEN 1 ELSE 0 END AS label FROM bars {_W}""")  # fmt: skip
def forward_label(spark: SparkSession, d: str) -> DataFrame:
    ahead = W.forward_return("close_px", 5, W.by_symbol())
    return M.bars(spark, d).select("symbol", "bar_date", F.round(ahead, 6).alias("fwd_5"), F.when(ahead > 0.01, 1).otherwise(0).alias("label"))


_DEC = M.with_views("decisions")


@query("win19_recent_signals", _DEC + """SELECT seq, count(*) OVER f AS signals_7d, count(*) FILTER (action IN ('STRONG BUY', 'BUY')) OVER f AS buys_7d,
  count(*) FILTER (action = 'SELL') OVER f AS sells_7d FROM decisions WINDOW f AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def recent_signals(spark: SparkSession, d: str) -> DataFrame:
    f = Window.partitionBy("symbol").orderBy("ts").rangeBetween(-604800, -1)
    return M.decisions(spark, d).select(
        "seq",
        F.count(F.lit(1)).over(f).alias("signals_7d"),
        F.count(F.when(F.col("action").isin("STRONG BUY", "BUY"), 1)).over(f).alias("buys_7d"),
        F.count(F.when(F.col("action") == "SELL", 1)).over(f).alias("sells_7d"),
    )


@query("win20_previous_signal", _DEC + """, p AS (SELECT *, max(row(ts, seq, action, probability_up)) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM decisions)
SELECT seq, ts - b[1] AS seconds_since, CASE WHEN b[3] <> action THEN 1 WHEN b[3] = action THEN 0 END AS changed, round(probability_up - b[4], 6) AS probability_delta FROM p""")  # fmt: skip
def previous_signal(spark: SparkSession, d: str) -> DataFrame:
    f = Window.partitionBy("symbol").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    before = M.decisions(spark, d).withColumn("b", F.max(F.struct("ts", "seq", "action", "probability_up")).over(f))
    return before.select(
        "seq",
        (F.col("ts") - F.col("b.ts")).alias("seconds_since"),
        (F.col("b.action") != F.col("action")).cast("int").alias("changed"),
        F.round(F.col("probability_up") - F.col("b.probability_up"), 6).alias("probability_delta"),
    )


@query("win21_action_churn", _DEC + """, c AS (SELECT symbol, CASE WHEN lag(action) OVER (PARTITION BY symbol ORDER BY ts, seq) <> action THEN 1e0 WHEN lag(action) OVER (PARTITION BY symbol ORDER BY ts, seq) = action THEN 0e0 END AS c FROM decisions)
SELECT symbol, round(avg(c), 6) AS churn, count(c) AS pairs FROM c GROUP BY symbol""")  # fmt: skip
def action_churn(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    changed = M.decisions(spark, d).select("symbol", (F.lag("action").over(w) != F.col("action")).cast("double").alias("c"))
    return changed.groupBy("symbol").agg(F.round(F.avg("c"), 6).alias("churn"), F.count("c").alias("pairs"))


@query("win22_drawdown", _BARS + """SELECT symbol, round(min(dd), 6) AS max_drawdown FROM (SELECT symbol, close_px / max(close_px) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) GROUP BY symbol""")
def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    down = M.bars(spark, d).select("symbol", W.drawdown("close_px", W.by_symbol()).alias("dd"))
    return down.groupBy("symbol").agg(F.round(F.min("dd"), 6).alias("max_drawdown"))


@query("win24_falling_closes", _BARS + f"SELECT symbol, bar_date, coalesce(lag(close_px, 2) OVER w > lag(close_px, 1) OVER w AND lag(close_px, 1) OVER w > close_px, false) AS falling FROM bars {_W}")
def falling_closes(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    falling = (F.lag("close_px", 2).over(w) > F.lag("close_px", 1).over(w)) & (F.lag("close_px", 1).over(w) > F.col("close_px"))
    return M.bars(spark, d).select("symbol", "bar_date", F.coalesce(falling, F.lit(False)).alias("falling"))


@query("win26_row_weight", _DEC + "SELECT seq, round(1e0 / count(*) OVER (PARTITION BY symbol, event_date, endpoint, decision_source), 6) AS weight FROM decisions")
def row_weight(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "event_date", "endpoint", "decision_source"))
    return M.decisions(spark, d).select("seq", F.round(F.lit(1.0) / n, 6).alias("weight"))


@query("win27_best_five", _BARS + f""", r AS (SELECT symbol, bar_date, lead(close_px, 5) OVER w / close_px - 1 AS fwd FROM bars {_W})
SELECT symbol, bar_date, CASE WHEN row_number() OVER (PARTITION BY bar_date ORDER BY fwd DESC, symbol) <= 5 THEN 1 ELSE 0 END AS top5 FROM r WHERE fwd IS NOT NULL""")  # fmt: skip
def best_five(spark: SparkSession, d: str) -> DataFrame:
    r = M.bars(spark, d).withColumn("fwd", W.forward_return("close_px", 5, W.by_symbol())).where("fwd is not null")
    w = Window.partitionBy("bar_date").orderBy(F.desc("fwd"), "symbol")
    return r.select("symbol", "bar_date", F.when(F.row_number().over(w) <= 5, 1).otherwise(0).alias("top5"))


@query("win28_sample_weight", _BARS + f""", r AS (SELECT symbol, bar_date, lead(close_px, 5) OVER w / close_px - 1 AS fwd, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars {_W})
SELECT symbol, bar_date, CASE WHEN fwd < -0.03 THEN 2e0 WHEN fwd > 0.03 THEN 1.5e0 ELSE 1e0 END AS bucket_weight,
  round(CASE WHEN n > 1 THEN 0.5 + 2e0 * (i - 1) / (n - 1) ELSE 1e0 END, 6) AS ramp FROM r""")  # fmt: skip
def sample_weight(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    r = M.bars(spark, d).withColumns({"fwd": W.forward_return("close_px", 5, w), "i": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    bucket = F.when(F.col("fwd") < -0.03, 2.0).when(F.col("fwd") > 0.03, 1.5).otherwise(1.0)
    ramp = F.when(F.col("n") > 1, 0.5 + F.lit(2.0) * (F.col("i") - 1) / (F.col("n") - 1)).otherwise(1.0)
    return r.select("symbol", "bar_date", bucket.alias("bucket_weight"), F.round(ramp, 6).alias("ramp"))
