"""What drove a score, and cards of instruments from their last quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D
from . import evaluation as E

#: Fixed value: seconds after which a card shows no price, so that it outlasts weekends and holidays.
STALE = 96 * 3600
Artifact = dict[str, tuple[float, float, float]]


def _value(feature: str, mean: float) -> Column:
    """The feature as a number; missing, NaN and infinite values are the mean."""
    x = F.col(feature).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(float(mean))


def _part(feature: str, mean: float, deviation: float, weight: float) -> Column:
    return (_value(feature, mean) - mean) / (deviation or 1.0) * weight


def with_score(rows: DataFrame, artifact: Artifact, intercept: float, name: str) -> DataFrame:
    """``rows`` with the probability of a linear model, feature -> (mean, deviation, weight)."""
    z = F.lit(float(intercept))
    for feature, fixed in artifact.items():
        z = z + _part(feature, *fixed)
    return rows.withColumn(name, D.clipped_sigmoid(z))


def drivers(artifact: Artifact, k: int) -> Column:
    """The k features that moved the score most either way, as structs (rank, feature, value, weight, contribution).

    Ties go by name. The array has a place for each feature of the model, so a row is sorted by itself, without a shuffle.
    """
    parts = [F.struct((-F.abs(F.round(_part(f, *fixed), 6))).alias("order"), F.lit(f).alias("feature"), F.round(_value(f, fixed[0]), 6).alias("value"), F.lit(round(fixed[2], 6)).alias("weight"), F.round(_part(f, *fixed), 6).alias("contribution")) for f, fixed in artifact.items()]
    first = F.slice(F.array_sort(F.array(*parts)), 1, k)
    return F.transform(first, lambda x, i: F.struct((i + 1).alias("rank"), x["feature"].alias("feature"), x["value"].alias("value"), x["weight"].alias("weight"), x["contribution"].alias("contribution")))


def index_cards(quotes: DataFrame, closes: DataFrame, last: int = 15) -> DataFrame:
    """A card for each row of ``quotes`` (symbol, price, change_percent, previous_close, age in seconds).

    A quote older than STALE has no price; of unknown age it counts as fresh. A missing previous close is recovered from
    the same quote's price and change, a missing change from both closes; a fall by 100 % recovers nothing. Cards without a
    price say why. ``closes`` (symbol, at, close) gives the last closes, oldest first.
    """
    old = F.coalesce(F.col("age") > STALE, F.lit(False))
    c = quotes.withColumn("old", old).withColumn("price", F.when(~F.col("old"), F.col("price")))
    pct = F.col("change_percent")
    c = c.withColumn("close", F.coalesce("previous_close", F.when(pct != -100, F.col("price") / (1 + pct / 100))))
    step = F.col("price") - F.col("close")
    c = c.withColumns({"step": step, "pct": F.coalesce(pct, F.try_divide(step, F.col("close")) * 100)})
    recent = E.top_k(closes, ["symbol"], [F.desc("at")], last).groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.round("close", 2).alias("close")))), lambda x: x["close"]).alias("series"))
    shown = lambda x: F.when(F.col("price").isNotNull(), F.round(F.col(x) + 1e-9, 2))
    why = F.when(F.col("price").isNull(), F.when(F.col("old"), "quote_older_than_96h").otherwise("missing_current_value"))
    return c.join(recent, "symbol", "left").select(
        "symbol", F.col("price").isNotNull().alias("available"), F.round("price", 2).alias("price"), shown("close").alias("previous_close"), shown("step").alias("change"), shown("pct").alias("change_percent"),
        F.round("age", 1).alias("freshness_seconds"), why.alias("unavailable_reason"), F.coalesce("series", F.array().cast("array<double>")).alias("series"),
    )
