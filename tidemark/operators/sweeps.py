"""Sweeps of decision rules over a lattice of parameters, from a few small tables instead of a pass for each point.

Rules that take the k best scores of a day differ in k and in a least score only, so the day's ranking down to the
largest k is made once, and every point counts a part of it. Rules with thresholds alone follow from a histogram of the
scores between thresholds, summed from above. Decisions count by ``weight``, so copies of one decision count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .suite import BIG_GAIN, BIG_LOSS

#: The lattice, and by how much a regime moves a score.
THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70)
MARGINS, TOP_K, LAMBDAS, REGIME_STEP = (0.0, 0.025, 0.05), (1, 3, 5), (0.25, 0.5, 0.75, 1.0), 0.05
SUMS = ("n", "w", "ret", "down", "loss_w", "losses", "gains")
POINT = ("family", "threshold", "second", "top_k")


def duplicate_weights(rows: DataFrame) -> DataFrame:
    """``weight``: one over the decisions that share symbol, day, endpoint and source."""
    copies = Window.partitionBy("symbol", "event_date", "endpoint", "decision_source")
    return rows.withColumn("weight", 1 / F.count(F.lit(1)).over(copies))


def _sums(ret: str) -> list[Column]:
    r, w = F.col(ret), F.col("weight")
    return [
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(w * r).alias("ret"), F.sum(w * F.greatest(-r, F.lit(0.0))).alias("down"), F.sum(F.when(r < BIG_LOSS, w).otherwise(0.0)).alias("loss_w"),
        F.count(F.when(r < BIG_LOSS, 1)).alias("losses"), F.count(F.when(r >= BIG_GAIN, 1)).alias("gains"),
    ]


def _ranked(rows: DataFrame, score: str, ret: str, key: str, points: list[tuple], family: str) -> DataFrame:
    """Sums of points (threshold, second, k): of each day the k best with a score of threshold + second or more."""
    most = max(p[2] for p in points)
    order = Window.partitionBy("event_date").orderBy(F.desc(score), key)
    best = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(F.col(score).alias("_score"), "_r", "weight", ret)
    lattice = rows.sparkSession.createDataFrame([(family, *map(float, p[:2]), int(p[2])) for p in points], "family string, threshold double, second double, top_k int")
    met = best.join(F.broadcast(lattice), (F.col("_r") <= F.col("top_k")) & (F.col("_score") >= F.col("threshold") + F.col("second")))
    return lattice.join(met.groupBy(*POINT).agg(*_sums(ret)), list(POINT), "left")


def _steps(score: Column, thresholds: tuple[float, ...]) -> Column:
    return sum((F.when(score >= t, 1).otherwise(0) for t in thresholds), F.lit(0))


def _above(cells: DataFrame, by: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    steps = cells.sparkSession.createDataFrame([(k + 1, float(t)) for k, t in enumerate(thresholds)], "at int, threshold double")
    return cells.join(F.broadcast(steps), F.col("step") >= F.col("at")).groupBy(*by, "threshold").agg(*(F.sum(c).alias(c) for c in SUMS))


def sweep(rows: DataFrame, p: str, risk: str, gain: str, regime: str, ret: str, key: str) -> DataFrame:
    """One row for each point of each family with its measures; ``best`` marks each family's point of highest utility.

    ``rows`` has event_date, weight, the scores and whether the regime is on. Families: filter (p less lambda times the
    risk, ``second``: lambda), ranker (the k highest gain scores of a day), overlay (the k best of a day that reach threshold
    and margin, ``second``: margin), regime (p moved by the regime, ``second``: the threshold while it is off).
    """
    spark = rows.sparkSession
    whole = rows.agg(F.count(F.when(F.col(ret) < BIG_LOSS, 1)).alias("all_losses"), F.count(F.when(F.col(ret) >= BIG_GAIN, 1)).alias("all_gains"))
    overlay = _ranked(rows, p, ret, key, [(t, m, k) for t in THRESHOLDS for m in MARGINS for k in TOP_K], "overlay")
    ranker = _ranked(rows, gain, ret, key, [(float("-inf"), 0.0, k) for k in TOP_K], "ranker").withColumn("threshold", F.lit(None).cast("double"))
    long = rows.select(p, risk, ret, "weight", F.explode(F.array(*map(F.lit, LAMBDAS))).alias("second"))
    cells = long.groupBy("second", _steps(F.col(p) - F.col("second") * F.col(risk), THRESHOLDS).alias("step")).agg(*_sums(ret))
    filters = _above(cells, ["second"], THRESHOLDS).select(F.lit("filter").alias("family"), "threshold", "second", F.lit(0).alias("top_k"), *SUMS)
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p) + F.when(F.col(regime), REGIME_STEP).otherwise(-REGIME_STEP)))
    sides = _above(rows.groupBy(F.col(regime).alias("on"), _steps(moved, THRESHOLDS).alias("step")).agg(*_sums(ret)), ["on"], THRESHOLDS)
    grid = spark.createDataFrame([(on, off) for on in THRESHOLDS for off in THRESHOLDS if on != off], "threshold double, second double")
    each = grid.select("threshold", "second", F.explode(F.array(F.struct(F.lit(True).alias("on"), F.col("threshold").alias("t")), F.struct(F.lit(False).alias("on"), F.col("second").alias("t")))).alias("s")).select("threshold", "second", "s.*")
    regimes = each.join(sides.withColumnRenamed("threshold", "t"), ["on", "t"], "left").groupBy("threshold", "second").agg(*(F.sum(c).alias(c) for c in SUMS))
    regimes = regimes.select(F.lit("regime").alias("family"), "threshold", "second", F.lit(0).alias("top_k"), *SUMS)
    points = overlay.select(*POINT, *SUMS).unionByName(ranker.select(*POINT, *SUMS)).unionByName(filters).unionByName(regimes).crossJoin(F.broadcast(whole))  # one row
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    capture = F.coalesce(ratio("gains", "all_gains"), F.lit(0.0))
    utility = ratio("ret", "w") - ratio("down", "w") - ratio("loss_w", "w") + 0.1 * capture
    measured = points.select(*POINT, F.coalesce("n", F.lit(0)).alias("n"), ratio("ret", "w").alias("mean_return"), F.coalesce(ratio("losses", "all_losses"), F.lit(0.0)).alias("loss_rate"), capture.alias("capture"), utility.alias("utility"))
    first = Window.partitionBy("family").orderBy(F.desc_nulls_last(F.round("utility", 9)), "threshold", "second", "top_k")  # a few dozen points
    return measured.withColumn("best", F.row_number().over(first) == 1)


def research_gates(points: DataFrame, baseline: DataFrame) -> DataFrame:
    """family, what its best point fails beside the baseline (one row of the same measures), and whether it wins."""
    now = baseline.select(*(F.col(c).alias(f"now_{c}") for c in ("mean_return", "loss_rate", "utility")))
    both = points.where("best").crossJoin(F.broadcast(now))  # one row
    fails = {
        "support": (F.col("n") < 10) | (F.coalesce("mean_return", F.lit(0.0)) <= 0) | (F.col("capture") <= 0),
        "return": F.coalesce(F.col("mean_return") <= F.col("now_mean_return"), F.lit(True)),
        "utility": F.coalesce(F.col("utility") <= F.col("now_utility"), F.lit(True)),
        "big_losses": (F.col("loss_rate") > F.col("now_loss_rate")) & F.coalesce(F.col("mean_return") < F.col("now_mean_return") + 0.02, F.lit(True)),
    }
    failed = F.concat_ws(",", *(F.when(c, n) for n, c in fails.items()))
    return both.select("family", failed.alias("failed"), (failed == "").alias("research_winner"))
