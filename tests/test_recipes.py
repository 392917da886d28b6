"""Shared fits, trees and hard examples against plain numpy."""

import random

import numpy as np
import pytest

from tidemark.operators import recipes as R

FEATURES = ("a", "b", "c")


def frame(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)) * [1.0, 5.0, 0.1] + [0, 3, -1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.0, -0.3, 4.0] + 5)))).astype(float)
    ret = np.where(y == 1, 0.02, -0.02) + rng.standard_normal(n) * 0.02
    return x, y, ret


@pytest.fixture(scope="module")
def rows(spark):
    x, y, ret = frame()
    data = [(i, *map(float, v), float(t), float(r), i < 600, i % 2 == 0, 1.0 + i % 3) for i, (v, t, r) in enumerate(zip(x, y, ret))]
    data.append((900, None, 3.0, -1.0, 1.0, 0.0, True, True, 1.0))
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double, ret double, early boolean, even boolean, w double").repartition(5).cache()


def newton(x, y, w, l2):
    x = np.column_stack([x, np.ones(len(x))])
    at, penalty = np.zeros(x.shape[1]), np.diag([l2] * (x.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ at))
        at -= np.linalg.solve((x.T * (w * p * (1 - p))) @ x / w.sum() + penalty, x.T @ (w * (p - y)) / w.sum() + penalty @ at)
    return at


def test_each_fit_equals_a_single_one_and_jobs_do_not_grow(spark, rows):
    x, y, _ = frame()
    grid = [R.Recipe(f"{l2}-{rows_}-{weight}-{len(features)}", features, "y", l2, rows_, weight, scaler) for l2 in (0.001, 0.1) for rows_ in (None, "early", "even") for weight in (None, "w") for features in (FEATURES, ("a", "c")) for scaler in ("standard", "none")]
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    fits = R.fit_many(rows, grid)
    many = jobs() - before
    R.fit_many(rows, grid[:1])
    assert many <= 2 * (jobs() - before - many) + 6
    index = np.arange(900)
    for f in fits:
        r = f.recipe
        keep = {None: index >= 0, "early": index < 600, "even": index % 2 == 0}[r.rows]
        part = x[keep][:, [FEATURES.index(c) for c in r.features]]
        centre, scale = (part.mean(axis=0), part.std(axis=0)) if r.scaler == "standard" else (0.0, 1.0)
        w = (1.0 + index % 3)[keep] if r.weight else np.ones(keep.sum())
        got = np.append(f.weights, f.intercept)
        # The row with a null feature counts for the other features' scale only.
        want = newton((part - f.centre) / f.scale, y[keep], w, r.l2)
        assert np.allclose(got, want, atol=1e-6) and np.allclose(f.centre, centre, rtol=0.02, atol=0.02) and np.allclose(f.scale, scale, rtol=0.02)
        weights, intercept = f.raw()
        assert np.allclose(part @ [weights[c] for c in r.features] + intercept, (part - f.centre) / f.scale @ f.weights + f.intercept)


def test_fits_without_rows_or_with_constant_features(spark, rows):
    none = R.fit_many(rows.where("id < 0"), [R.Recipe("none", ("a",), "y")])[0]
    assert none.weights.tolist() == [0.0] and none.intercept == 0.0
    flat = rows.selectExpr("*", "1.0D as one")
    fit = R.fit_many(flat, [R.Recipe("flat", ("a", "one"), "y", 0.0)])[0]
    assert np.isfinite([*fit.weights, fit.intercept]).all()
    robust = R.fit_many(rows, [R.Recipe("robust", ("b",), "y", scaler="robust")])[0]
    b = frame()[0][:, 1]
    assert abs(robust.centre[0] - np.median(b)) < 0.1 and abs(robust.scale[0] - np.subtract(*np.quantile(b, [0.75, 0.25]))) < 0.1


@pytest.mark.parametrize("share", [0.01, 0.15, 0.9])
def test_hard_examples_are_the_worst_mistakes(spark, share):
    rng = random.Random(4)
    data = [(k, rng.choice([0.1, 0.3, 0.55, 0.7, 0.71]), rng.choice(["big_loss", "big_gain", "flat"])) for k in range(500)]
    got = {r["id"] for r in R.hard_examples(spark.createDataFrame(data, "id long, p double, bucket string"), "p", 0.5, "bucket", "id", share).where("weight > 1").collect()}
    wrong = [(-int((p if p >= 0.5 else 1 - p) * 10_000 + 1e-9), k) for k, p, b in data if (p >= 0.5 and b == "big_loss") or (p < 0.5 and b == "big_gain")]
    assert got == {k for _, k in sorted(wrong)[: int(500 * share)]}
