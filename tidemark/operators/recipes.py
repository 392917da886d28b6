"""Many logistic fits in shared scans: every recipe of a grid, on every fold, by Newton's method.

A step needs a recipe's gradient and its weighted Gram matrix only. Tasks sum both for all recipes over the rows they
read, the sums meet in a partial aggregate, and the driver solves systems as large as a recipe has features. So a grid
takes as many jobs as its slowest recipe takes steps (about four from a start near the end), however many recipes and folds it has, and rows
never leave the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Steps after which a fit counts as converged whatever the last one was, and the step below which it has.
STEPS, SMALL = 40, 1e-9
#: Where a fit starts is found on one row in NEAR, NEAR_ROWS at most; from less than NEAR_LEAST rows, or beyond FAR, it starts at
#: zero. All steps from there on read every row until SMALL, so the start decides how many there are, not where they end.
NEAR, NEAR_ROWS, NEAR_LEAST, FAR = 32, 40_000, 2000, 10.0


@dataclass(frozen=True)
class Recipe:
    """``rows`` and ``weight`` name columns: a condition for the rows to fit on, and their weights (none: all, 1).

    ``scaler``: standard (mean and deviation), robust (median and quartile distance to a ten-thousandth of ranks) or none.
    """

    name: str
    features: tuple[str, ...]
    label: str
    l2: float = 0.001
    rows: str | None = None
    weight: str | None = None
    scaler: str = "standard"


@dataclass
class Fit:
    recipe: Recipe
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    steps: int = 0

    def raw(self) -> tuple[dict[str, float], float]:
        """Weights and intercept for features as they are."""
        w = self.weights / self.scale
        return dict(zip(self.recipe.features, w.tolist())), float(self.intercept - (w * self.centre).sum())


def _scales(rows: DataFrame, recipes: list[Recipe]) -> dict[tuple, tuple[float, float]]:
    """(centre, scale) of each (rows, feature, scaler) that some recipe needs, in one job."""
    wanted = sorted({(r.rows, f, r.scaler) for r in recipes for f in r.features if r.scaler != "none"}, key=str)
    out = []
    for k, (where, f, scaler) in enumerate(wanted):
        x = F.when(F.col(where), F.col(f)) if where else F.col(f)
        if scaler == "robust":
            out.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{k}"))
        else:
            out += [F.avg(x).alias(f"m{k}"), F.stddev_pop(x).alias(f"s{k}")]
    found = rows.agg(*out).first() if out else {}
    scales = {}
    for k, key in enumerate(wanted):
        if key[2] == "robust":
            low, centre, high = found[f"q{k}"] or (0.0, 0.0, 0.0)
            scales[key] = centre, (high - low) or 1.0
        else:
            scales[key] = found[f"m{k}"] or 0.0, found[f"s{k}"] or 1.0
    return scales


def fit_many(rows: DataFrame, recipes: list[Recipe]) -> list[Fit]:
    """Fits of all recipes over ``rows``: the mean log loss, weighted, plus half of l2 times the squared weights.

    Rows with a null among a recipe's features, its label or weight take no part in it.
    """
    scales = _scales(rows, recipes)
    fits = []
    for r in recipes:
        pairs = [scales.get((r.rows, f, r.scaler), (0.0, 1.0)) for f in r.features]
        fits.append(Fit(r, np.array([m for m, _ in pairs]), np.array([s for _, s in pairs]), np.zeros(len(r.features))))
    names = sorted({c for r in recipes for c in (*r.features, r.label, r.weight) if c})
    flags = sorted({r.rows for r in recipes if r.rows})
    held = rows.select(*(F.col(c).cast("double").alias(c) for c in names), *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags))
    near = held.where(F.pmod(F.xxhash64(*names), F.lit(NEAR)) == 0).limit(NEAR_ROWS).toArrow().to_batches(10_000)
    moving = _newton(fits, lambda which: _whole(_add(near, [(i, fits[i]) for i in which]), fits, which), 12)
    for i, fit in enumerate(fits):
        n = sum(pc.sum(b.column(fit.recipe.rows)).as_py() or 0 if fit.recipe.rows else b.num_rows for b in near)
        if n < NEAR_LEAST or i in moving or np.abs([*fit.weights, fit.intercept]).max() > FAR:
            fit.weights, fit.intercept = np.zeros(len(fit.weights)), 0.0
        fit.steps = 0
    _newton(fits, lambda which: _sums(held, fits, which), STEPS)
    return fits


def _newton(fits: list[Fit], sums: Callable[[list[int]], dict[int, tuple[np.ndarray, np.ndarray, float]]], steps: int) -> set[int]:
    """Steps of all fits that still move, from the sums of each; the ones that have not come to rest."""
    moving = set(range(len(fits)))
    for _ in range(steps):
        if not moving:
            break
        for i, (gradient, gram, total) in sums(sorted(moving)).items():
            fit, d = fits[i], len(fits[i].weights)
            penalty = np.diag([fit.recipe.l2] * d + [0.0])
            if total == 0:
                moving.discard(i)
                continue
            at = np.append(fit.weights, fit.intercept)
            # A singular system (a constant feature without penalty) takes its smallest step.
            step = np.linalg.lstsq(gram / total + penalty, gradient / total + penalty @ at, rcond=None)[0]
            step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-300))
            fit.weights, fit.intercept, fit.steps = at[:d] - step[:d], float(at[d] - step[d]), fit.steps + 1
            if np.abs(step).max() < SMALL:
                moving.discard(i)
    return moving


def _sums(held: DataFrame, fits: list[Fit], which: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Gradient, Gram matrix and weight of each fit that still moves, from one job over all rows."""
    shared = held.sparkSession.sparkContext.broadcast([(i, fits[i]) for i in which])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, found in _add(batches, shared.value).items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], ["fit", "place", "value"])

    found = held.mapInArrow(add, "fit int, place int, value double").groupBy("fit", "place").agg(F.sum("value").alias("value")).collect()
    out: dict[int, np.ndarray] = {}
    for row in found:
        out.setdefault(row["fit"], np.zeros(_size(fits[row["fit"]])))[row["place"]] = row["value"]
    return _whole(out, fits, which)


def _size(fit: Fit) -> int:
    d = len(fit.recipe.features) + 1
    return d + d * d + 1


def _whole(sums: dict[int, np.ndarray], fits: list[Fit], which: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Gradient, Gram matrix and weight from flat sums; none counts as zeros."""
    split = lambda v, d: (v[:d], v[d:-1].reshape(d, d), float(v[-1]))
    return {i: split(sums.get(i, np.zeros(_size(fits[i]))), len(fits[i].recipe.features) + 1) for i in which}


def _add(batches: Iterable[pa.RecordBatch], fits: list[tuple[int, Fit]]) -> dict[int, np.ndarray]:
    """Flat sums of each fit over the batches."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        for i, fit in fits:
            r = fit.recipe
            able = columns[r.rows].astype(bool) if r.rows else np.ones(batch.num_rows, bool)
            x = (np.column_stack([columns[f][able] for f in r.features]) - fit.centre) / fit.scale
            y, w = columns[r.label][able], columns[r.weight][able] if r.weight else np.ones(len(x))
            known = np.isfinite(x).all(axis=1) & np.isfinite(y) & np.isfinite(w)
            if not known.all():
                x, y, w = x[known], y[known], w[known]
            p = 1 / (1 + np.exp(-np.clip(x @ fit.weights + fit.intercept, -500, 500)))
            x = np.column_stack([x, np.ones(len(x))])
            gram = (x * (w * p * (1 - p))[:, None]).T @ x
            found = np.concatenate([x.T @ (w * (p - y)), gram.ravel(), [w.sum()]])
            sums[i] = sums[i] + found if i in sums else found
    return sums


def models(spark: SparkSession, fits: list[Fit], features: list[str], threshold: float = 0.55, **more: str) -> DataFrame:
    """Fits as rows of a table of models: model, threshold, intercept, ``w_<feature>`` and further constant columns."""
    rows = []
    for f in fits:
        weights, intercept = f.raw()
        rows.append((f.recipe.name, threshold, intercept, *(weights.get(c, 0.0) for c in features), *more.values()))
    schema = ", ".join(["model string", "threshold double", "intercept double", *(f"w_{c} double" for c in features), *(f"{k} string" for k in more)])
    return spark.createDataFrame(rows, schema)


def hard_examples(rows: DataFrame, score: str, threshold: float, bucket: str, key: str, share: float = 0.15, weight: float = 5.0) -> DataFrame:
    """Rows with ``weight``: bought big losses and missed big gains, the worst first, ``share`` of all rows at most.

    How bad a mistake is goes in ten-thousandths; counts of these say where the share ends, and only the mistakes of
    that one degree are ordered, by ``key``.
    """
    bought, p = F.col(score) >= threshold, F.col(score)
    wrong = (bought & (F.col(bucket) == "big_loss")) | (~bought & (F.col(bucket) == "big_gain"))
    degree = F.floor(F.when(bought, p).otherwise(1 - p) * 10_000)
    judged = rows.withColumn("_degree", F.when(wrong, degree))
    most = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy()) * share))
    counts = judged.groupBy("_degree").agg(F.count(F.lit(1)).alias("n")).withColumn("most", most)  # ten thousand rows at most
    worse = F.sum("n").over(Window.orderBy(F.desc("_degree"))) - F.col("n")
    room = counts.where("_degree IS NOT NULL").withColumn("room", F.col("most") - worse).select(F.col("_degree").alias("_of"), "n", "room")
    met = judged.join(F.broadcast(room), F.col("_degree") == F.col("_of"), "left")
    partly = (F.col("room") > 0) & (F.col("room") < F.col("n"))
    place = F.row_number().over(Window.partitionBy("_degree").orderBy(key))
    cut = met.where(partly).select(F.col(key).alias("_key"), place.alias("_place"))
    out = met.join(cut, F.col(key) == F.col("_key"), "left")
    taken = (F.col("room") >= F.col("n")) | (F.coalesce("_place", F.lit(1 << 62)) <= F.col("room"))
    return out.withColumn("weight", F.when(F.coalesce(taken, F.lit(False)), weight).otherwise(1.0)).drop("_degree", "_of", "n", "room", "_key", "_place")
