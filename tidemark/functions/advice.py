"""Decision tables over signals and positions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the points of the rules that hold; a rule that is null gives none."""
    total = F.lit(0.0)
    for rule, value in rules:
        total = total + F.when(rule, value).otherwise(0.0)
    return total


def technical_score(macd: Column, rsi: Column, close: Column, sma50: Column, relative_volume: Column) -> Column:
    """MACD above 0: 3; RSI above 55: 1.5; close above its 50-bar mean: 2; volume above average 1, far below -1; cap 12.

    A close that equals its mean is not above it, whatever the rounding of the mean's sum.
    """
    score = points((macd > 0, 3.0), (rsi > 55, 1.5), (F.round(close - sma50, 9) > 0, 2.0), (relative_volume > 1, 1.0), (relative_volume < 0.5, -1.0))
    return F.least(score, F.lit(12.0))


def verdict(score: Column) -> Column:
    return F.when(score >= 9, "STRONG BUY").when(score >= 6, "BUY").when(score >= 3, "HOLD").otherwise("HOLD OFF FOR NOW")


def softened(action: Column, price: Column, position_weight: Column, sector_weight: Column, probability: Column) -> tuple[Column, Column]:
    """(action, rules that hold): buys become HOLD where any rule of risk holds."""
    rules = F.array_compact(F.array(
        F.when(price < 105, "low_price"), F.when(position_weight > 0.2, "position_limit"), F.when(sector_weight > 0.5, "sector_limit"), F.when(probability < 0.4, "low_confidence"),
    ))
    buy = action.isin("STRONG BUY", "BUY")
    return F.when(buy & (F.size(rules) > 0), "HOLD").otherwise(action), F.concat_ws(",", rules)


def threshold_action(probability: Column, gain: Column) -> Column:
    """BUY at 0.6 and above, SELL at 0.35 and below or at a loss of 15 %, else HOLD."""
    return F.when((probability <= 0.35) | (gain <= -0.15), "SELL").when(probability >= 0.6, "BUY").otherwise("HOLD")


def position_advice(price: Column, entry: Column, rsi: Column, macd: Column, sentiment: Column, trend: Column, base: Column, dip: float = 0.05, profit: float = 8.0) -> tuple[Column, Column, Column, Column]:
    """(advice, profit in percent, risk flags, confidence) of a position; missing inputs count as neutral.

    A dip below the entry or a turn from oversold buys, a gain with risk takes profit, a loss is held unless news, trend
    and momentum all speak against it, and what is left follows the base action.
    """
    rsi, macd, mood = F.coalesce(rsi, F.lit(50.0)), F.coalesce(macd, F.lit(0.0)), F.coalesce(sentiment, F.lit(0.5))
    pnl = F.when(entry > 0, (price - entry) / entry * 100)
    flags = F.array_compact(F.array(F.when(rsi >= 70, "overbought"), F.when(macd < 0, "momentum_down"), F.when(mood <= 0.35, "negative_news")))
    risky = F.size(flags) > 0
    turn = (rsi <= 35) & (macd > 0) & (mood >= 0.55)
    breaking = (mood <= 0.25) & (trend == "bearish") & (rsi >= 45)
    advice = (
        F.when(price.isNull(), "HOLD").when((price <= entry * (1 - dip)) | turn, "BUY").when((pnl >= profit) & (risky | (base == "SELL")), "SELL")
        .when(pnl < 0, F.when(breaking, "SELL").otherwise("HOLD")).when(pnl.between(-5, 15) & ~risky, "HOLD").when(~base.isin("BUY", "HOLD", "SELL"), "HOLD").otherwise(base)
    )
    return advice, pnl, flags, F.lit(5.0) + F.when(mood > 0.6, 1.5).when(mood < 0.4, -1.0).otherwise(0.0)


def rule_call(base: Column, rsi: Column, macd: Column, sentiment: Column, positive: Column) -> Column:
    strong = (base == "STRONG BUY") | ((rsi <= 35) & (sentiment >= 0.7))
    buy = (base == "BUY") | ((rsi < 55) & positive & (macd.isNull() | (macd >= 0)))
    return F.when(strong, "STRONG BUY").when(buy, "BUY").otherwise("HOLD OFF FOR NOW")


def recent_action(rsi: Column, macd: Column, change: Column) -> Column:
    """An action from recent data alone; ``change`` in percent."""
    hot = (rsi >= 72) & (macd.isNull() | (macd < 0))
    cheap = (rsi <= 35) & (macd.isNull() | (macd >= 0))
    steady = (rsi < 58) & (macd >= 0) & (change.isNull() | (change > -3))
    return F.when(rsi.isNull() & macd.isNull(), "HOLD").when(hot, "HOLD").when(cheap | steady, "BUY").otherwise("HOLD")


def quote_signal(change: Column) -> tuple[Column, Column]:
    """(action, score from 0 to 10) from a day's change in percent."""
    return F.when(change >= 5, "BUY").when(change <= -5, "SELL").otherwise("HOLD"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), 5 + change / 2)), 2)


def ledger(trades: Column) -> Column:
    """(held, cost, realised) after an array of trades (shares, price) in order: buys average the cost, sales realise.

    A sale of more than is held sells what is held.
    """
    start = F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("realised"))

    def step(acc: Column, t: Column) -> Column:
        n, price = t["shares"].cast("double"), t["price"]
        bought = F.when(n > 0, (acc["held"] * acc["cost"] + n * price) / (acc["held"] + n)).otherwise(acc["cost"])
        gain = F.when(n < 0, F.least(acc["held"], -n) * (price - acc["cost"])).otherwise(0.0)
        return F.struct(F.greatest(F.lit(0.0), acc["held"] + n).alias("held"), bought.alias("cost"), (acc["realised"] + gain).alias("realised"))

    return F.aggregate(trades, start, step)


def scored_call(probability: Column) -> tuple[Column, Column, Column]:
    """(call, confidence from 0 to 1, whether the probability was missing and counts as one half)."""
    p = F.coalesce(probability, F.lit(0.5))
    return F.when(p >= 0.75, "STRONG BUY").when(p >= 0.55, "BUY").otherwise("HOLD OFF FOR NOW"), F.abs(p - 0.5) * 2, probability.isNull()
