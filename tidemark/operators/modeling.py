"""Features shared by training and scoring, linear models, calibration and resampling over days."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import windows as W
from .evaluation import running_counts

FEATURES = ["ret_1", "ret_5", "ret_20", "rsi_14", "macd_hist", "volume_ratio", "vs_sma_20", "volatility_20", "bench_ret_5", "relative_5", "risk_on"]


def shared_features(bars: DataFrame, bench: DataFrame, columns: Sequence[str] = FEATURES, also: Sequence[str] = ()) -> DataFrame:
    """symbol, bar_date, close_px, ``columns`` of the contract's features and ``also`` of the bars' columns; ``bench`` has
    bar_date, bench_close, bench_ret5, bench_sma20.

    A benchmark has one row a day, so it is broadcast; all else is windows over one shuffle by symbol. Averages by Arrow batches
    keep Spark from leaving out what nobody reads, so only what is asked for is made.
    """
    w = W.by_symbol()
    close, delta = F.col("close_px"), F.col("close_px") - F.lag("close_px").over(w)
    asked = {*columns, *(["ret_5", "bench_ret_5"] if "relative_5" in columns else [])}
    own = {
        "ret_1": W.lagged_return("close_px", 1, w), "ret_5": W.lagged_return("close_px", 5, w), "ret_20": W.lagged_return("close_px", 20, w),
        "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))), "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
        "_r": W.lagged_return("close_px", 1, w), "_volume": F.col("volume").cast("double"), "_i": F.row_number().over(w),
    }
    rolling = {"rsi_14": {"_gains": ("_gain", 14, "mean"), "_losses": ("_loss", 14, "mean")}, "volume_ratio": {"_volumes": ("_volume", 20, "mean")}, "vs_sma_20": {"_closes": ("close_px", 20, "mean")}, "volatility_20": {"volatility_20": ("_r", 20, "deviation")}}
    rolling = {name: of for c, parts in rolling.items() if c in asked for name, of in parts.items()}
    averages = {"_fast": ("close_px", 12), "_slow": ("close_px", 26), "_signal": (("_fast", "_slow"), 9)} if "macd_hist" in asked else {}
    needed = asked | {c for c, _, _ in rolling.values()} | ({"_i"} if averages else set())
    b = bars.select("symbol", "bar_date", "close_px", *also, *(v.alias(c) for c, v in own.items() if c in needed))
    if averages or rolling:
        b = W.with_ema_in_place(b, averages, skip={"_signal": 25}, rolling=rolling)
    rest = {
        "rsi_14": F.when(F.col("_losses") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_gains") / F.col("_losses"))),
        "macd_hist": F.when(F.col("_i") >= 34, F.col("_fast") - F.col("_slow") - F.col("_signal")),
        "volume_ratio": W.safe_ratio(F.col("_volume"), F.col("_volumes")), "vs_sma_20": W.safe_ratio(close, F.col("_closes")) - 1,
    }
    b = b.withColumns({c: v for c, v in rest.items() if c in asked})
    if asked & {"bench_ret_5", "risk_on"}:
        market = bench.select("bar_date", F.col("bench_ret5").alias("bench_ret_5"), F.when(F.col("bench_ret5").isNotNull() & F.col("bench_sma20").isNotNull(), ((F.col("bench_ret5") > 0) & (F.col("bench_close") >= F.col("bench_sma20"))).cast("double")).alias("risk_on"))
        b = b.join(F.broadcast(market), "bar_date", "left")
    if "relative_5" in asked:
        b = b.withColumn("relative_5", F.col("ret_5") - F.col("bench_ret_5"))
    return b.select("symbol", "bar_date", "close_px", *also, *columns)


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians of the columns, ranked by ranges of their values."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    found = interpolated(rows.select(F.inline(pairs)), ["column"], "value", {"median": 0.5}).collect()
    return {r["column"]: r["median"] for r in found}


def standardised(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns less their mean by their deviation, and both; a deviation of 0 counts as 1."""
    found = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = {c: (found[f"m_{c}"] or 0.0, found[f"s_{c}"] or 1.0) for c in columns}
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}), scale


def fit_logistic(rows: DataFrame, columns: list[str], label: str, l2: float = 0.001, weight: str | None = None):
    """Weighted logistic regression with L2; (coefficients, intercept) over the columns as they are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(rows)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=100, **({"weightCol": weight} if weight else {})).fit(data)
    return dict(zip(columns, map(float, model.coefficients))), float(model.intercept)


def linear_score(coefficients: dict[str, float], intercept: float) -> Column:
    return D.clipped_sigmoid(sum((F.col(c) * w for c, w in coefficients.items()), F.lit(float(intercept))))


def contributions(coefficients: dict[str, float], scale: dict[str, tuple[float, float]]) -> Column:
    """(feature, part of the score) of every feature, as an array of structs."""
    return F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - scale[c][0]) / scale[c][1] * w).alias("part")) for c, w in coefficients.items()])


def _histogram(rows: DataFrame, p: str, y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, labels and counts of each distinct (probability to six digits, label): two million rows at most."""
    held = rows.groupBy(F.round(p, 6).alias("p"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["p", "y"])
    q = np.clip(held["p"].to_numpy(float), 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q)), held["y"].to_numpy(float), held["n"].to_numpy(float)


def platt(rows: DataFrame, p: str, y: str, rate: float = 0.05, epochs: int = 500) -> dict[str, float | bool]:
    """Slope and intercept on the logit by log loss; left at 1 and 0 unless the Brier score gets better."""
    x, label, n = _histogram(rows, p, y)
    total = n.sum()
    brier = lambda a, b: float((n * (1 / (1 + np.exp(-(a * x + b))) - label) ** 2).sum() / total)
    slope, intercept, raw = 1.0, 0.0, brier(1.0, 0.0) if total else 0.0
    if len(set(label)) < 2:
        return {"slope": 1.0, "intercept": 0.0, "raw_brier": raw, "brier": raw, "applied": False}
    for _ in range(epochs):
        error = n * (1 / (1 + np.exp(-(slope * x + intercept))) - label) / total
        slope, intercept = slope - rate * float((error * x).sum()), intercept - rate * float(error.sum())
    fitted = brier(slope, intercept)
    better = fitted < raw
    return {"slope": slope if better else 1.0, "intercept": intercept if better else 0.0, "raw_brier": raw, "brier": fitted if better else raw, "applied": better}


def platt_by_brier(rows: DataFrame, p: str, y: str, rate: float = 0.03, steps: int = 600) -> tuple[float, float]:
    """(intercept, slope - 1) by descent on the Brier score, the slope within 0.25 and 3."""
    x, label, n = _histogram(rows, p, y)
    slope, intercept, total = 1.0, 0.0, n.sum()
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(intercept + slope * x, -35, 35)))
        g = n * 2 * (q - label) * q * (1 - q) / total
        intercept, slope = intercept - rate * float(g.sum()), min(3.0, max(0.25, slope - rate * float((g * x).sum())))
    return intercept, slope - 1


def day_blocks(daily: DataFrame, at: str, value: str, width: int) -> DataFrame:
    """Means of runs of ``width`` days, numbered from 0; ``daily`` has one row for each day, so its order is one window."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at)) - 1
    return daily.withColumn("block", F.floor(n / width)).groupBy("block").agg(F.avg(value).alias("mean"))


def block_bootstrap(blocks: DataFrame, resamples: int = 500) -> DataFrame:
    """resample, mean: each draws as many blocks as there are, by integer hashes instead of a generator's state."""
    total = blocks.agg(F.count(F.lit(1)).alias("n"))
    draws = blocks.select(F.col("block").alias("draw")).crossJoin(F.broadcast(total))  # one row
    draws = draws.select("draw", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    picked = draws.select("resample", F.pmod(F.lit(7919) * F.col("resample") + F.lit(104729) * F.col("draw") + F.pmod(F.col("resample") * F.col("draw"), F.lit(31)), F.col("n")).alias("block"))
    return picked.join(blocks, "block").groupBy("resample").agg(F.avg("mean").alias("mean"))


def bounds(samples: DataFrame) -> DataFrame:
    """One row: the 95 % interval, the median and the share above 0 of the resamples' means."""
    q = lambda p: F.percentile("mean", F.lit(p))
    return samples.agg(F.round(q(0.025), 6).alias("lower"), F.round(q(0.5), 6).alias("median"), F.round(q(0.975), 6).alias("upper"), F.round(F.avg((F.col("mean") > 0).cast("double")), 6).alias("positive"))


def plateau(grid: DataFrame, step: str, utility: str, tolerance: float) -> DataFrame:
    """The middle of the longest run of neighbouring grid steps whose utility is within ``tolerance`` of the best.

    Of runs of equal length the one with the best step counts, then the first.
    """
    best = grid.agg(F.max(utility).alias("best"))
    near = grid.crossJoin(F.broadcast(best)).where(F.col(utility) >= F.col("best") - tolerance)  # one row
    near = near.withColumn("run", F.col(step) - F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(step)))
    runs = near.groupBy("run").agg(F.count(F.lit(1)).alias("width"), F.max(utility).alias("top"), F.sort_array(F.collect_list(step)).alias("steps"))
    first = runs.orderBy(F.desc("width"), F.desc("top"), "run").limit(1)
    return first.select(F.element_at("steps", (F.floor((F.col("width") - 1) / 2) + 1).cast("int")).alias(step), "width", "top")


def undominated(models: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """Models that no other beats in one objective while it is no worse in all; a table of models is small."""
    other = models.select(F.col(key).alias("_other"), *[F.col(o).alias(f"_{o}") for o in objectives])
    no_worse = [F.col(f"_{o}") >= F.col(o) for o in objectives]
    better = F.lit(False)
    for o in objectives:
        better = better | (F.col(f"_{o}") > F.col(o))
    condition = (F.col("_other") != F.col(key)) & better
    for c in no_worse:
        condition = condition & c
    return models.join(F.broadcast(other), condition, "left_anti")


def interpolated(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], exclusive: bool = False) -> DataFrame:
    """Percentiles between neighbours: at (n-1)*q of the sorted values, or at (n+1)*q where ``exclusive``.

    Values are counted and ranked by ranges, so neither a row nor a task holds a group's values.
    """
    run = running_counts(rows, by, value)
    picks = []
    for name, q in shares.items():
        at = (F.col("_all") + 1) * q - 1 if exclusive else (F.col("_all") - 1) * q
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value)))
        high = F.coalesce(F.min(F.when(F.col("_upto") > F.floor(at) + 1, F.col(value))), low)
        part = F.max(at - F.floor(at))
        picks.append((low + (high - low) * part).alias(name))
    return run.groupBy(*by).agg(*picks)
