"""Calibration, drift, concentration and portfolio measures as partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def calibration_bins(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_y; the last bin is closed at 1."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(binned: DataFrame) -> DataFrame:
    """One row: the mean gap between forecast and share over bins, by their rows."""
    return binned.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


#: Ranges into which the values of a group are cut before they are ranked.
RANGES = 64


def running_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _n, _upto, _all): how often each value occurs in its group, up to it, and altogether.

    The values of a group are cut into ranges of about equal numbers of distinct values. Ranges are counted, and their running
    sums (a few rows for each group) carry a range's count into it; only within a range are values ordered. So a group
    of any size is spread over RANGES tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 1000).alias("_cuts"))
    keyed = lambda df: df.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    met = counts.join(keyed(cuts), same, "inner") if by else counts.crossJoin(F.broadcast(cuts))  # one row
    ranged = met.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts", *(f"_{c}" for c in by))
    whole = Window.partitionBy(*by)
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_of"))
    sizes = sizes.withColumns({"_before": F.sum("_of").over(whole.orderBy("_range")) - F.col("_of"), "_all": F.sum("_of").over(whole)}).drop("_of")
    within = Window.partitionBy(*by, "_range").orderBy(value)
    run = ranged.withColumn("_within", F.sum("_n").over(within)).join(keyed(sizes.withColumnRenamed("_range", "_part")), [*same, F.col("_range") == F.col("_part")])
    return run.select(*by, value, "_n", (F.col("_before") + F.col("_within")).alias("_upto"), "_all")


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], upper: bool = False) -> DataFrame:
    """Percentiles by nearest rank: the lower one (index int((n-1)*q)), or the ceiling of n*q."""
    run = running_counts(rows, by, value)
    rank = lambda q: F.greatest(F.ceil(F.col("_all") * q), F.lit(1)) if upper else F.floor((F.col("_all") - 1) * q) + 1
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") >= rank(q), F.col(value))).alias(name) for name, q in shares.items()])


def stability_index(reference: DataFrame, current: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Population stability index over given edges, with half a row in empty bins."""
    cut = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges), F.lit(0))
    count = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(cut.alias("bin")).agg(F.count(F.lit(1)).alias(name))
    bins = reference.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    both = bins.join(count(reference, "a"), "bin", "left").join(count(current, "b"), "bin", "left").select("bin", F.greatest(F.coalesce("a", F.lit(0)), F.lit(0.5)).alias("a"), F.greatest(F.coalesce("b", F.lit(0)), F.lit(0.5)).alias("b"))
    totals = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = both.crossJoin(F.broadcast(totals)).select((F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))  # one row
    return shares.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def date_ranks(rows: DataFrame, at: str) -> DataFrame:
    """Rows with the number of their day among all days, and of all days: from the small table of days, not from rows."""
    days = rows.select(at).where(F.col(at).isNotNull()).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(at)
    ranked = days.withColumns({"day_no": F.row_number().over(w), "days": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    return rows.join(F.broadcast(ranked), at)  # one row per calendar day


def purged_split(rows: DataFrame, at: str, train_share: float, purge: int, embargo: int) -> DataFrame:
    """Rows with part = train, purged, embargoed or test, by whole days around one boundary."""
    ranked = date_ranks(rows, at)
    cut = F.floor(F.col("days") * train_share)
    boundary = ranked.where(F.col("day_no") == cut + 1).agg(F.min(at).alias("boundary"))
    r = ranked.crossJoin(F.broadcast(boundary))  # one row
    part = F.when(F.col(at) < F.date_sub("boundary", purge), "train").when(F.col(at) < F.col("boundary"), "purged").when(F.col(at) < F.date_add("boundary", embargo), "embargoed").otherwise("test")
    return r.withColumn("part", part).drop("day_no", "days", "boundary")
