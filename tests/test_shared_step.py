"""The step that queries of the shared features have in common: one shuffle and sort, averages by Arrow batches."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import modeling as L
from tidemark.operators import recipes as R
from tidemark.plans import model_queries as Q
from tidemark.plans import suite_queries


def test_bars_and_windows_of_a_symbol_share_one_shuffle(spark, sf_dir):
    plan = Q.features(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert plan.count("MapInArrow") == 1 and plan.count("+- Sort [symbol") == 1
    assert "MapInArrow" not in Q.features(spark, sf_dir, ["ret_1", "ret_20"])._jdf.queryExecution().executedPlan().toString()


def test_averages_go_on_from_batch_to_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rng, kept = np.random.default_rng(8), spark.conf.get(name)
    rows = pd.DataFrame([(s, at, None if rng.random() < 0.05 else float(rng.normal(100, 5))) for s, n in (("A", 100), ("B", 1), ("C", 41)) for at in range(n)], columns=["symbol", "at", "x"])
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "symbol string, at long, x double").repartition(3)
    spark.conf.set(name, 7)
    try:
        got = W.with_ema_in_place(df, {"fast": ("x", 3), "slow": ("x", 8), "signal": (("fast", "slow"), 4)}, at="at", skip={"signal": 5}, rolling={"mean": ("x", 10, "mean"), "spread": ("x", 10, "deviation")}).toPandas()
    finally:
        spark.conf.set(name, kept)
    got = got.sort_values(["symbol", "at"]).reset_index(drop=True)
    for _, part in got.groupby("symbol"):
        x = part["x"]
        fast, slow = (x.ewm(span=s, adjust=False, ignore_na=True).mean() for s in (3, 8))
        line = (fast - slow).where(np.arange(len(part)) >= 5)
        want = {"fast": fast, "slow": slow, "signal": line.ewm(span=4, adjust=False, ignore_na=True).mean(), "mean": x.rolling(10).mean(), "spread": x.rolling(10).std(ddof=0)}
        for c, v in want.items():
            assert np.allclose(part[c], v, atol=1e-9, equal_nan=True), c


def test_columns_asked_for_alone_equal_those_of_all(spark, sf_dir):
    every = Q.features(spark, sf_dir).toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True)
    for columns in (["relative_5"], ["macd_hist"], ["volatility_20", "risk_on"]):
        some = Q.features(spark, sf_dir, columns).toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True)
        assert list(some.columns) == ["symbol", "bar_date", "close_px", *columns]
        pd.testing.assert_frame_equal(some, every[list(some.columns)])
    assert list(every.columns)[3:] == L.FEATURES


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (2.25,), (-2.25,), (None,), (-0.01,)], "x double")
    assert [r[0] for r in df.select(W.rounded("x", 1)).collect()] == [0.5, -0.5, 2.3, -2.3, None, 0.0]


def test_a_start_near_the_end_saves_steps_and_changes_no_fit(spark, monkeypatch):
    x, z = F.randn(1), F.randn(2)
    rows = spark.range(100_000).select("id", x.alias("a"), (z * 5 + 3).alias("b"), (F.col("id") % 3 > 0).alias("most"))
    rows = rows.withColumn("y", (F.rand(3) < 1 / (1 + F.exp(-(F.col("a") - 0.3 * F.col("b"))))).cast("double")).cache()
    grid = [R.Recipe("all", ("a", "b"), "y", 0.01), R.Recipe("most", ("a", "b"), "y", 0.01, "most", None, "none")]
    near = R.fit_many(rows, grid)
    monkeypatch.setattr(R, "NEAR_LEAST", 1 << 40)
    for f, g in zip(near, R.fit_many(rows, grid)):
        assert f.steps < g.steps
        assert np.allclose([*f.weights, f.intercept], [*g.weights, g.intercept], atol=1e-10)


def test_a_suite_scores_its_rows_twice_only(spark, sf_dir):
    """Once for days, once for rankings; the frontier of models used to do it again."""
    plan = suite_queries.suite(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildRight, Cross" not in plan and "event_date" not in plan
