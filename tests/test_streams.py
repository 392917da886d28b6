"""States that cross batches, against plain loops."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import folding
from tidemark.streaming import ordering as S
from tidemark.streaming.keyed_table import KeyedTable, run_upserts

BASE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
TICKS = "symbol string, type string, event_ts timestamp, event_id long, sequence long, price double"


def _batches(spark, frames, tmp_path):
    """A stream that brings one frame in each trigger."""
    at = str(tmp_path / uuid.uuid4().hex)
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(at)


def _moment(seconds):
    return BASE + datetime.timedelta(seconds=seconds)


def test_order_state_crosses_batches(spark, tmp_path):
    rows = [("S", "T", BASE, k, s, None) for k, s in enumerate([1, 2, 2, 5, 4, 6])] + [("S", "T", BASE, 5, 9, None), ("S", "T", BASE, 7, 7, None)]
    stream = _batches(spark, [spark.createDataFrame([r], TICKS) for r in rows], tmp_path)
    got = S.classify_stream(stream, str(tmp_path)).collect()
    want = [(0, 1, "first"), (1, 2, "ok"), (2, 2, "duplicate"), (3, 5, "gap"), (4, 4, "late"), (5, 6, "ok"), (5, 9, "duplicate"), (7, 7, "ok")]
    assert sorted((r["event_id"], r["sequence"], r["status"]) for r in got) == sorted(want)


def test_times_decide_without_sequences(spark):
    ticks = [(5, 1, None, 1.0), (5, 2, None, 1.0), (5, 3, None, 2.0), (6, 4, 10, 2.0), (6, 5, None, 2.0), (7, 5, 11, 3.0), (8, 6, 9, 3.0), (9, 6, 12, 3.0), (9, None, 12, 3.0), (9, None, None, 3.5)]
    rows = [("S", "T", _moment(s), i, q, p) for s, i, q, p in ticks]
    got = S.classify_batch(spark.createDataFrame(rows, TICKS)).collect()
    # Ties of time go by id, missing ids first.
    order = sorted(ticks, key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] is not None, t[2] or 0))
    last, want = None, []
    for at, event_id, sequence, price in order:
        if last is None:
            status = "first"
        elif event_id is not None and event_id == last[1]:
            status = "duplicate"
        elif sequence is not None and last[2] is not None:
            status = "duplicate" if sequence == last[2] else "late" if sequence < last[2] else "gap" if sequence > last[2] + 1 else "ok"
        else:
            status = "late" if at < last[0] else "duplicate" if (at, price) == (last[0], last[3]) else "ok"
        if status in ("first", "ok", "gap"):
            last = (at, event_id, sequence, price)
        want.append((event_id, sequence, status))
    assert sorted(map(str, want)) == sorted(str((r["event_id"], r["sequence"], r["status"])) for r in got)
    assert {w[2] for w in want} >= {"first", "duplicate", "late", "ok"}


@pytest.mark.parametrize("triggers", [1, 3])
def test_many_ticks_of_one_key_in_a_trigger(spark, tmp_path, triggers):
    """More than an Arrow batch holds, dealt over files out of order."""
    rng = random.Random(3)
    rows = [("S", "T", _moment(k), k, k + 1, float(k)) for k in range(30_000)]
    frames = []
    for k in range(triggers):
        part = rows[k * len(rows) // triggers : (k + 1) * len(rows) // triggers]
        rng.shuffle(part)
        frames.append(spark.createDataFrame(part, TICKS))
    got = S.classify_stream(_batches(spark, frames, tmp_path), str(tmp_path)).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"first": 1, "ok": 29_999}


def test_a_trigger_that_is_run_again_changes_nothing(spark, tmp_path, monkeypatch):
    ticks = [spark.createDataFrame([("S", "T", _moment(k), k, k + 1, 1.0) for k in range(3 * n, 3 * n + 3)], TICKS) for n in range(2)]
    real, broken = folding.folded, []

    def fails_once(machine, rows, memories=None):
        out = real(machine, rows, memories)
        if memories is not None and not broken:
            broken.append(True)
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(folding, "folded", fails_once)
    stream, folder = _batches(spark, ticks, tmp_path), str(tmp_path)
    monkeypatch.setattr(folding.uuid, "uuid4", lambda: type("U", (), {"hex": "same"}))
    with pytest.raises(Exception, match="lost"):
        S.classify_stream(stream, folder)
    assert sorted(r["status"] for r in S.classify_stream(stream, folder).collect()) == ["first", *["ok"] * 5]


ALERTS = "user_id long, symbol string, event_id long, at double, type string, price double, threshold double, spread_bps double, session string, after_hours_allowed boolean, recommendation_state string, concentration_crossed boolean, invalidation_reason string"


def _alerts_by_a_loop(ticks, debounce=15, cooldown=300, hysteresis=0.5):
    """The rules one by one, with variables of their own."""
    price_before = spread_before = waiting = waiting_since = last_rule = last_advice = last_time = None
    out = []
    for _, _, event_id, at, kind, price, threshold, spread, session, allowed, advice, concentrated, invalid in ticks:
        if session != "regular" and session is not None and not allowed:
            out.append((event_id, False, "after_hours_disabled"))
            continue
        low, high = threshold - threshold * hysteresis / 100, threshold + threshold * hysteresis / 100
        if invalid:
            rule = "snapshot_invalidated"
        elif kind == "AM":
            rule = "minute_bar_closed"
        elif concentrated:
            rule = "suitability_boundary_crossed"
        elif price is not None and price >= high and ((price_before is not None and price_before < low) or waiting == "price_threshold_crossed"):
            rule = "price_threshold_crossed"
        elif spread is not None and spread_before is not None and abs(spread - spread_before) >= 25:
            rule = "liquidity_changed"
        else:
            rule = None
        price_before = price if price is not None else price_before
        spread_before = spread if spread is not None else spread_before
        if rule is None:
            waiting = waiting_since = None
            out.append((event_id, False, "no_controlled_boundary"))
        elif waiting != rule:
            waiting, waiting_since = rule, at
            out.append((event_id, False, "debouncing"))
        elif at - waiting_since < debounce:
            out.append((event_id, False, "debouncing"))
        elif last_time is not None and at - last_time < cooldown:
            out.append((event_id, False, "cooldown"))
        elif last_rule == rule and last_advice == advice:
            out.append((event_id, False, "duplicate"))
        else:
            last_rule, last_advice, last_time, waiting, waiting_since = rule, advice, at, None, None
            out.append((event_id, True, rule))
    return out


def _price_ticks(seed, n):
    rng, at, out = random.Random(seed), 0.0, []
    for k in range(n):
        at += rng.choice([1.0, 5.0, 20.0, 400.0])
        out.append((1, "S", k, at, rng.choice("TTTQ") if rng.random() < 0.8 else "AM", rng.choice([None, 49.0, 49.9, 50.1, 51.0, 52.0]), 50.0, rng.choice([None, 0.0, 30.0, 31.0]), rng.choice(["regular"] * 6 + ["pre", "closed", None]), rng.random() < 0.5, rng.choice("ab"), rng.random() < 0.1, "x" if rng.random() < 0.1 else None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alert_stream_equals_a_loop(spark, tmp_path, seed):
    ticks = _price_ticks(seed, 400)
    stream = _batches(spark, [spark.createDataFrame(ticks[k : k + 150], ALERTS) for k in range(0, 400, 150)], tmp_path)
    got = [(r["event_id"], r["fired"], r["reason"]) for r in S.alert_stream(stream, str(tmp_path)).collect()]
    want = _alerts_by_a_loop(ticks)
    assert sorted(got) == sorted(want)
    assert {w[2] for w in want} >= {"debouncing", "cooldown", "no_controlled_boundary", "after_hours_disabled", "minute_bar_closed"}


def test_alerts_switched_off(spark):
    rows = spark.createDataFrame(_price_ticks(1, 20), ALERTS)
    out = folding.said(folding.folded(S.alert_machine(enabled=False), rows)).collect()
    assert {(r["fired"], r["reason"]) for r in out} == {(False, "emergency_disabled")}


def test_gap_windows_and_recovery_requests(spark):
    rng = random.Random(1)
    rows = [("A", float(rng.randrange(1000)), k) for k in range(40)]
    df = spark.createDataFrame(rows, "symbol string, s double, event_id long").withColumn("event_ts", F.timestamp_seconds("s"))
    got = S.queued_gaps(df, "30 seconds").agg(F.sum("gaps").alias("n"), F.count(F.lit(1)).alias("w")).first()
    assert (got["n"], got["w"]) == (40, len({int(s // 30) for _, s, _ in rows}))
    queued, last = [], None
    for _, s, k in sorted(rows, key=lambda r: r[1:]):
        if last is None or s - last >= 30:
            queued.append(k)
            last = s
    out = folding.said(folding.folded(S.recovery_requests(30.0), df.drop("s"))).where("queued").collect()
    assert sorted(r["event_id"] for r in out) == sorted(queued)


def test_latest_values_vanish_across_triggers(spark, tmp_path):
    shape = "symbol string, type string, event_id long, price double, at double, expires double"
    rows = [("A", "T", 1, 10.0, 0.0, 120.0), ("B", "T", 2, 20.0, 60.0, 180.0), ("A", "T", 3, 11.0, 50.0, 170.0), ("A", "T", 4, 9.0, 40.0, 160.0), ("C", "Q", 5, 1.0, 175.0, 295.0)]
    latest = S.latest_table(str(tmp_path))
    stream = _batches(spark, [spark.createDataFrame([r], shape) for r in rows], tmp_path)
    run_upserts(stream, latest, "at")
    at = lambda clock: {(r["symbol"], r["event_id"]) for r in latest.read(spark, clock).collect()}
    # A's newest is of second 50 although that of second 40 came after it.
    assert at(100.0) == {("A", 3), ("B", 2), ("C", 5)} and at(169.0) == {("A", 3), ("B", 2), ("C", 5)}
    assert at(170.0) == {("B", 2), ("C", 5)} and at(180.0) == {("C", 5)} and at(295.0) == set()
    assert {r["symbol"] for r in latest.read(spark).collect()} == {"B", "C"}


def test_demand_vanishes_after_ninety_seconds(spark, tmp_path):
    shape = "source string, symbols array<string>, event_id long, at double, expires double"
    rows = [("web", ["A", "B"], 1, 0.0, 90.0), ("job", ["C"], 2, 30.0, 120.0), ("web", ["B"], 3, 60.0, 150.0)]
    demand = S.demand_table(str(tmp_path))
    run_upserts(_batches(spark, [spark.createDataFrame([r], shape) for r in rows], tmp_path), demand, "at")
    at = lambda clock: {(r["source"], *r["symbols"]) for r in demand.read(spark, clock).collect()}
    assert at(90.0) == {("job", "C"), ("web", "B")} and at(120.0) == {("web", "B")} and at(150.0) == set()


def test_two_writers_and_a_broken_one_leave_one_state(spark, tmp_path):
    shape = "k string, version long, v string"
    frame = lambda *rows: spark.createDataFrame(rows, shape)
    states = []
    for order in ((0, 1), (1, 0)):
        t = KeyedTable(f"{tmp_path}/{order[0]}", ("k",), ("version", "v"))
        writes = [(frame(("a", 1, "x"), ("b", 5, "x")), "one"), (frame(("a", 2, "y"), ("b", 4, "y"), ("c", 1, "y")), "two")]
        for i in order:
            t.write(*writes[i])
        t.write_part(frame(("a", 9, "broken"), ("d", 9, "broken")), "three")  # no record follows
        t.write(*writes[0])  # the same write once more
        states.append(sorted(tuple(r) for r in t.read(spark).collect()))
    assert states[0] == states[1] == [("a", 2, "y"), ("b", 5, "x"), ("c", 1, "y")]


def test_ticks_by_windows_equal_the_machine(spark, tmp_path):
    r, rows, day = random.Random(3), [], datetime.datetime(2024, 1, 1)
    for i in range(900):
        symbol = r.choice(["A", "B", "C", None])
        repeated = i - 1 if symbol == "B" and i % 50 == 0 else i
        rows.append((symbol, "T", day + datetime.timedelta(days=r.randrange(700)), repeated, None if symbol == "C" and i % 40 == 0 else r.randrange(150) if i % 3 else i, float(i)))
    ticks = spark.createDataFrame(rows, "symbol string, type string, event_ts timestamp, event_id long, sequence long, price double").repartition(3)
    shown = lambda df: sorted(map(str, df.collect()))
    first, later = ticks.where("event_id < 500"), ticks.where("event_id >= 500")
    for n, (batch, memories) in enumerate([(first, None), (later, S.folded(S.ORDER, first).where("memory IS NOT NULL"))]):
        rest, held, done = S._by_windows(batch, memories, f"{tmp_path}/{n}")
        assert done.count() and rest.count() and shown(S.folded(S.ORDER, rest, held).unionByName(done)) == shown(S.folded(S.ORDER, batch, memories))


def test_a_replayed_range_is_one_trigger_of_several_files(spark, tmp_path):
    ticks = spark.range(40).selectExpr("id", "CASE WHEN id < 3 THEN 0 ELSE id END AS at")
    seen = {}
    S.replay(spark, ticks, str(tmp_path), triggers=3, by="at").writeStream.foreachBatch(lambda df, n: seen.update({n: [r["id"] for r in df.collect()]})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sorted(sum(seen.values(), [])) == list(range(40))
    assert max(seen[0]) < min(seen[1]) and max(seen[1]) < min(seen[2])
    files = [f for f in tmp_path.glob("ticks-*/*.parquet")]
    assert len(files) == 3 * spark.sparkContext.defaultParallelism
