"""Joins in event time: backward and forward as-of, interval and split-factor joins.

As-of joins are a union and one window for each key and stretch of time, so they shuffle once and never build pairs. What
a stretch does not hold itself comes from the last one before it that holds anything: a table of one row for each key
and stretch. So a key with many rows is spread over as many tasks as its time has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import STRETCH, stretch


def _asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], backward: bool, days: float) -> DataFrame:
    """Rows of ``left`` with a struct of ``right``'s values at the nearest row on one side; ties count as met.

    The last value met along the order is kept, so the frame only ever grows and each row is looked at once.
    """
    held = F.struct(F.col(right_at).alias("_at"), *values)
    kinds = {"_left": left.select(F.struct("*").alias("s")).schema["s"].dataType, "_right": right.select(held.alias("s")).schema["s"].dataType}
    none = lambda side: F.lit(None).cast(kinds[side]).alias(side)
    row = lambda df, at, kind, own, other: df.select(F.col(key).alias("_key"), F.col(at).alias("_time"), stretch(df, at, days).alias("_part"), F.lit(kind).alias("_kind"), own, other)
    a = row(left, left_at, 1, F.struct("*").alias("_left"), none("_right"))
    b = row(right, right_at, 0, none("_left"), held.alias("_right"))
    side = F.asc if backward else F.desc
    w = Window.partitionBy("_key", "_part").orderBy(side("_time"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    within = a.unionByName(b).withColumn("_met", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    nearest = (F.max_by if backward else F.min_by)("_right", "_time")
    ends = b.groupBy("_key", "_part").agg(nearest.alias("_end")).unionByName(a.select("_key", "_part").distinct().withColumn("_end", none("_right")))
    ends = ends.groupBy("_key", "_part").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy("_key").orderBy(side("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_key").alias("_of"), F.col("_part").alias("_at_part"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = within.join(carried, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at_part")), "left")
    return out.select("_left.*", F.coalesce("_met", "_carried").alias("met"))


def backward_asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], days: float = STRETCH) -> DataFrame:
    """The last row of ``right`` at or before each row of ``left``, as struct ``met`` (its time is ``met._at``)."""
    return _asof(left, right, key, left_at, right_at, values, True, days)


def forward_asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], days: float = STRETCH) -> DataFrame:
    """The first row of ``right`` at or after each row of ``left``."""
    return _asof(left, right, key, left_at, right_at, values, False, days)


def bar_index(bars: DataFrame, key: str = "symbol", at: str = "bar_date") -> DataFrame:
    return bars.withColumn("bar_idx", F.row_number().over(Window.partitionBy(key).orderBy(at)))


def exits(bars: DataFrame, horizons: list[int], close: str = "close_px", key: str = "symbol", at: str = "bar_date") -> DataFrame:
    """Bars with the closes of later bars as exit_<n>."""
    w = Window.partitionBy(key).orderBy(at)
    return bars.withColumns({f"exit_{n}": F.lead(close, n).over(w) for n in horizons})


def path_closes(close: str, n: int, key: str = "symbol", at: str = "bar_date") -> Column:
    return F.collect_list(close).over(Window.partitionBy(key).orderBy(at).rowsBetween(0, n))


def running_totals(rows: DataFrame, key: str, at: str, values: list[str], days: float = STRETCH) -> DataFrame:
    """key, time and the totals of ``values`` up to and with that time; one row for each key and time.

    Rows of one time are added up first. Totals run within stretches of time; a stretch's total is carried into later ones.
    Values should be integers: then totals are exact, whatever the order of adding. Rows without key or time go.
    """
    sums = [F.sum(v).alias(v) for v in values]
    moments = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(*sums)
    moments = moments.withColumn("_part", stretch(moments, at, days))
    within = Window.partitionBy(key, "_part").orderBy(at)
    order = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    parts = moments.groupBy(key, "_part").agg(*sums)
    before = parts.select(F.col(key).alias("_of"), F.col("_part").alias("_stretch"), *(F.coalesce(F.sum(v).over(order), F.lit(0)).alias(f"_before_{v}") for v in values))
    run = moments.select(key, at, "_part", *(F.sum(v).over(within).alias(v) for v in values))
    met = run.join(before, (F.col(key) == F.col("_of")) & (F.col("_part") == F.col("_stretch")))
    return met.select(key, at, *((F.coalesce(v, F.lit(0)) + F.col(f"_before_{v}")).alias(v) for v in values))


def interval_totals(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, by: list[str], values: list[str], spans: dict[str, int], days: float = STRETCH) -> DataFrame:
    """``by`` (unique in ``left``) and, as <value>_<name>, totals of ``right``'s values over the last spans[name] seconds.

    A row of ``right`` counts where left_at - span < right_at <= left_at, both in whole seconds. A total is the difference of
    two running totals, so no pair of rows is ever formed, however many lie in an interval. Without any row it is 0.
    """
    run = running_totals(right, key, right_at, values, days)
    probes = F.array(F.struct(F.lit("").alias("_name"), F.col(left_at).alias("_probe")), *(F.struct(F.lit(n).alias("_name"), (F.col(left_at) - s).alias("_probe")) for n, s in spans.items()))
    asked = left.select(*dict.fromkeys([*by, key]), F.inline(probes))
    met = backward_asof(asked, run, key, "_probe", right_at, values, days)
    upto = lambda name, v: F.coalesce(F.max(F.when(F.col("_name") == name, F.col(f"met.{v}"))), F.lit(0))
    return met.groupBy(*by).agg(*((upto("", v) - upto(n, v)).alias(f"{v}_{n}") for n in spans for v in values))


def cumulative_factor(splits: DataFrame) -> DataFrame:
    """ticker, execution_date, factor: the product of from/to over all splits up to and on that day."""
    day = splits.groupBy("ticker", "execution_date").agg(F.product(F.col("split_from") / F.col("split_to")).alias("f"))
    w = Window.partitionBy("ticker").orderBy("execution_date").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("ticker", "execution_date", F.exp(F.sum(F.log("f")).over(w)).alias("factor"))


def with_factor(rows: DataFrame, splits: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """``rows`` with the cumulative split factor on their day (1 before the first split)."""
    factors = cumulative_factor(splits).withColumnRenamed("ticker", key)
    out = backward_asof(rows, factors, key, at, "execution_date", ["factor"])
    return out.withColumn(name, F.coalesce("met.factor", F.lit(1.0))).drop("met")
