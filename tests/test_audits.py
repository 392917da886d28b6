"""Chains of declarations, widening reads and the cache of splits."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage as N
from tidemark.operators import servability as V
from tidemark.sources import caches as C
from tidemark.sources.files import stored

SHAPE = "feature string, inputs array<string>, time_semantics string, upstream_model_version string, available boolean, depends_on_output boolean, required boolean, source string, training_builder string, serving_builder string, transformation string, fill_policy string"


def declared(name, inputs=(), semantics="at_prediction", upstream="v9", available=True, output=False, required=True, source="log"):
    return (name, list(inputs), semantics, upstream, available, output, required, source, "t", "s", "x", "f")


def test_chains_of_three_declarations(spark):
    rows = [
        declared("price"), declared("late", semantics="T+5 close"), declared("outcome", semantics="Realized_Outcome"), declared("blind", source=" "), declared("gone", available=None), declared("extra", required=False),
        declared("a1", ["price"]), declared("a2", ["a1", "extra"]), declared("a3", ["a2"]),
        declared("b1", ["outcome"]), declared("b2", ["b1", "price"]), declared("b3", ["b2", "late"]),
        declared("c1", ["undeclared"]), declared("c2", ["c1"], output=True), declared("c3", ["c2"]),
        declared("x", ["y"]), declared("y", ["x", "blind"]),  # a cycle
        declared("feature_probability_up", upstream="V3"), declared("d1", ["feature_probability_up"]),
    ]
    got = {r["feature"]: (r["classification"], r["inherited"]) for r in V.audit(spark.createDataFrame(rows, SHAPE), "v3", stored).collect()}
    own = {"price": 4, "late": 0, "outcome": 1, "blind": 3, "gone": 3, "extra": 5, "feature_probability_up": 2}
    passed_on = {"a1": (4, False), "a2": (4, False), "a3": (4, False), "b1": (1, True), "b2": (1, True), "b3": (0, True), "c1": (3, True), "c2": (2, False), "c3": (2, True), "x": (3, True), "y": (3, True), "d1": (2, True)}
    assert got == {k: (V.VERDICTS[v], False) for k, v in own.items()} | {k: (V.VERDICTS[v], i) for k, (v, i) in passed_on.items()}


def test_widening_opens_new_files_only(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(400).select("id", F.format_string("2024-%02d", F.floor(F.col("id") / 40) + 1).alias("month"), (F.col("id") < 200).alias("good")).write.partitionBy("month").parquet(path)
    rows = spark.read.parquet(path)
    w = C.read_widening(rows, "month", F.col("good"), enough=50, first=1)
    assert (w.parts, w.usable, w.capped) == (8, 120, False) and w.rows.count() == 320
    read = {r["f"] for r in w.rows.select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f.split("month=")[1][:7] for f in read} == {f"2024-{m:02d}" for m in range(3, 11)}
    scan = w.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "2024-03" in scan
    short = C.read_widening(rows, "month", F.col("good"), enough=50, cap=3)
    assert (short.parts, short.usable, short.capped) == (3, 0, True)
    assert C.read_widening(rows.limit(0), "month", F.col("good")).parts == 0


def test_split_cache(spark, tmp_path):
    shape = "ticker string, execution_date date, adjustment_type string, split_from double, split_to double, id string"
    day = datetime.date(2024, 1, 2)
    frame = lambda *rows: spark.createDataFrame([(t, day, kind, a, b, i) for t, kind, a, b, i in rows], shape)
    universe = spark.createDataFrame([("AAA",), ("bbb",)], "symbol string")
    cache = C.split_cache(str(tmp_path / "cache"))
    m = C.write_splits(cache, frame((" aaa ", "Forward_Split", 1.0, 2.0, "1"), ("SPY", "reverse_split", 5.0, 1.0, "2"), ("ZZZ", "spin_off", 1.0, 1.0, "3")), universe, "r1", 1).first()
    assert (m["splits"], m["symbols"], m["unsupported"], m["malformed"]) == (2, 2, 0, 0) and len(m["fingerprint"]) == 64
    C.write_splits(cache, frame(("AAA", "forward_split", 1.0, 3.0, "1")), universe, "r2", 2)
    for bad in (("BBB", "spin_off", 1.0, 2.0, "4"), ("BBB", "forward_split", 0.0, 2.0, "4"), ("BBB", None, 1.0, 2.0, "4")):
        with pytest.raises(ValueError):
            C.write_splits(cache, frame(bad, ("BBB", "forward_split", 1.0, 9.0, "5")), universe, "r3", 3)
    got = {(r["ticker"], r["id"], r["split_to"]) for r in cache.read(spark).collect()}
    assert got == {("AAA", "1", 3.0), ("SPY", "2", 1.0)}


def test_fingerprints_do_not_depend_on_layout(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("k"), (F.col("id") % 1700).cast("string")).alias("key"))
    of = lambda df: {r["g"]: (r["n"], r["fingerprint"]) for r in N.fingerprints(df, ["g"], F.col("key")).collect()}
    first = of(rows)
    assert first == of(rows.orderBy(F.rand(1)).repartition(7)) and len({f for _, f in first.values()}) == 3
    assert first != of(rows.where("key <> 'k3'")) and of(rows.unionByName(rows.limit(1)))[0] != first[0]


def test_ages_of_half_a_second_go_to_the_even_one(spark, tmp_path):
    from tidemark.plans.all_queries import QUERIES

    rows = [(1, "2024-01-01 00:00:00", 7, "click"), (2, "2024-01-01 00:00:14.5", 7, "click"), (3, "2023-12-31 23:59:59", 7, "view")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["event_id"]: r["age"] for r in QUERIES["scl29_staleness"](spark, str(tmp_path)).collect()} == {1: 14, 2: 0, 3: 16}


def test_a_close_at_its_mean_is_not_above_it(spark):
    from tidemark.functions import advice

    rows = spark.createDataFrame([(1, 104.37, 104.36999999999998), (2, 104.37, 104.36), (3, 104.37, None)], "k int, close double, mean double")
    none = F.lit(None).cast("double")
    got = {r[0]: r[1] for r in rows.select("k", advice.technical_score(none, none, F.col("close"), F.col("mean"), none)).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 0.0}
