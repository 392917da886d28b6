"""Fitted models against plain numpy, and joins and states on one hot key."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import asof as A
from tidemark.operators import modeling as L
from tidemark.plans import model_queries as Q


def test_logistic_fit_equals_newton(spark, sf_dir):
    data, _ = L.standardised(Q.labelled(spark, sf_dir).where("bar_date < date '1999-01-01'"), L.FEATURES)
    coefficients, intercept = L.fit_logistic(data, L.FEATURES, "up", l2=0.001)
    pdf = data.select(*L.FEATURES, "up").toPandas()
    x = np.column_stack([pdf[L.FEATURES].to_numpy(float), np.ones(len(pdf))])
    y, w = pdf["up"].to_numpy(float), np.zeros(x.shape[1])
    penalty = np.diag([0.001] * len(L.FEATURES) + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + penalty, x.T @ (p - y) / len(y) + penalty @ w)
    assert np.allclose([*coefficients.values(), intercept], w, atol=2e-3)


def test_train_score_and_contributions(spark, sf_dir):
    out = Q.train_and_score(spark, sf_dir).toPandas()
    assert len(out) and out["p"].between(0, 1).all() and out["calibrated"].between(0, 1).all()
    share = Q.contribution_shares(spark, sf_dir).toPandas()
    rows, scale, coefficients, _ = Q.fitted(spark, sf_dir)
    pdf = rows.select(*L.FEATURES).toPandas()
    parts = np.column_stack([(pdf[c] - scale[c][0]) / scale[c][1] * w for c, w in coefficients.items()])
    top = np.array(list(coefficients))[parts.argmax(axis=1)][parts.max(axis=1) > 0]
    assert {r.feature: r.rows for r in share.itertuples()} == {f: int((top == f).sum()) for f in set(top)}


def test_asof_joins_on_one_hot_key_are_spread(spark):
    n, days = 20_000, 600 / 86400
    left = spark.range(n).select(F.lit("S").alias("symbol"), (F.col("id") * 2).alias("at"))
    right = spark.range(n).select(F.lit("S").alias("symbol"), (F.col("id") * 2 + 1).alias("at"), F.col("id").alias("v")).where("id % 1000 < 10 OR id > 15000").drop("id")
    times = np.array(sorted(r["at"] for r in right.select("at").collect()))
    for join, side in ((A.backward_asof, -1), (A.forward_asof, 0)):
        met = join(left, right, "symbol", "at", "at", ["v"], days)
        got = {r["at"]: r["met"]["_at"] if r["met"] else None for r in met.collect()}
        for at in range(0, 2 * n, 34):
            k = np.searchsorted(times, at, "right") - 1 if side else np.searchsorted(times, at)
            assert got[at] == (times[k] if 0 <= k < len(times) else None)
        parts = met.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert max(r["count"] for r in parts) < 0.6 * n
    ties = spark.createDataFrame([("S", 5), ("S", 7), (None, 7)], "symbol string, at long")
    some = spark.createDataFrame([("S", 5, 1), ("S", 6, 2), (None, 1, 9)], "symbol string, at long, v long")
    got = {(r["symbol"], r["at"]): r["met"]["v"] if r["met"] else None for r in A.backward_asof(ties, some, "symbol", "at", "at", ["v"], days).collect()}
    assert got == {("S", 5): 1, ("S", 7): 2, (None, 7): 9}


def test_averages_equal_the_recurrence(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for symbol, n, lead in (("A", 900, 0), ("B", 300, 70), ("C", 1, 0), ("D", 5, 5), (None, 40, 3)):
        days = np.sort(rng.choice(3000, n, replace=False))
        x = [None if k < lead else float(v) for k, v in enumerate(100 + rng.standard_normal(n).cumsum())]
        e = {span: None for span in (1, 2, 12, 200)}
        for day, v in zip(days.tolist(), x):
            e = {span: v if before is None else before if v is None else before + 2 / (span + 1) * (v - before) for span, before in e.items()}
            rows.append((symbol, day * 86400, v))
            want[symbol, day * 86400] = dict(e)
    df = spark.createDataFrame(rows, "symbol string, at long, x double").repartition(5)
    for days in (128, 900):
        got = W.with_ema(df, {**{f"e{s}": ("x", s) for s in (1, 2, 12, 200)}, "again": ("e12", 1)}, at="at", days=days).collect()
        assert len(got) == len(rows)
        for r in got:
            for span, v in want[r["symbol"], r["at"]].items():
                assert (r[f"e{span}"] is None) == (v is None) and (v is None or abs(r[f"e{span}"] - v) < 1e-8)
            assert r["again"] == r["e12"]


def test_interpolated_percentiles(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 9, 101), rng.standard_normal(40)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", None)], "g string, v double")
    got = {r["g"]: r for r in L.interpolated(df, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q99": 0.99}).collect()}
    assert np.allclose([got["a"][c] for c in ("q1", "q5", "q99")], np.quantile(x, [0.1, 0.5, 0.99]))
    assert got["b"]["q5"] == 1.0


def test_plateau_and_pareto(spark):
    grid = spark.createDataFrame([(0, 1.0), (1, 1.9), (2, 2.0), (3, 1.95), (4, 0.5), (5, 1.99)], "step int, u double")
    assert tuple(L.plateau(grid, "step", "u", 0.2).first()) == (2, 3, 2.0)
    models = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 0.0, 3.0), ("d", 2.0, 1.0)], "m string, x double, y double")
    assert {r["m"] for r in L.undominated(models, "m", ["x", "y"]).collect()} == {"b", "c", "d"}


def test_averages_in_place_equal_the_recurrence(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for symbol, n, lead in (("A", 1500, 0), ("B", 300, 70), ("C", 1, 0), ("D", 5, 5), (None, 40, 3)):
        x = [None if k < lead or rng.random() < 0.1 else float(v) for k, v in enumerate(100 + rng.standard_normal(n).cumsum())]
        e = {span: None for span in (1, 2, 12, 26, 200)}
        for at, v in enumerate(x):
            e = {span: v if before is None else before if v is None else before + 2 / (span + 1) * (v - before) for span, before in e.items()}
            rows.append((symbol, at, v))
            want[symbol, at] = dict(e)
    df = spark.createDataFrame(rows, "symbol string, at long, x double").repartition(5)
    got = W.with_ema_in_place(df, {**{f"e{s}": ("x", s) for s in (1, 2, 12, 26, 200)}, "again": ("e12", 1)}, at="at").collect()
    assert len(got) == len(rows)
    for r in got:
        for span, v in want[r["symbol"], r["at"]].items():
            assert (r[f"e{span}"] is None) == (v is None) and (v is None or abs(r[f"e{span}"] - v) < 1e-8)
        assert r["again"] == r["e12"]


def test_features_shuffle_bars_twice_and_labels_are_written_once(spark, sf_dir):
    plan = Q.features(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 2  # bars, then their windows
    assert "Scan parquet" in Q.labelled(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().replace("FileScan", "Scan")
    assert "Window" not in Q.labelled(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_guardrails_read_their_sums_once(spark, sf_dir):
    plan = Q.guardrails(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    once = Q.threshold_utilities(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation") == once.count("Relation")
    assert [tuple(r) for r in Q.guardrails(spark, sf_dir).where("step = 8").select("gain", "passes").collect()] == [(0.0, False)]
