"""Snapshots, feature names, reports on splits, validation, hygiene, drivers and cards against small loops by hand."""

import datetime
import json
import random

from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import diagnostics as G
from tidemark.operators import snapshots as S
from tidemark.operators import split_reports as R
from tidemark.operators import validation as V
from tidemark.plans.all_queries import QUERIES
from tidemark.sources.files import stored

DAY = datetime.date(2024, 1, 1)


def later(n):
    return DAY + datetime.timedelta(days=n)


def test_interval_totals_equal_a_loop(spark):
    r = random.Random(3)
    left = [(i, r.choice("abc"), r.randrange(0, 5000)) for i in range(300)]
    right = [(r.choice("ab"), r.randrange(0, 5000) // 7 * 7, r.choice([1, 2, -3, None])) for _ in range(900)] + [("a", 700, 5)] * 400 + [(None, 3, 1), ("a", None, 1)]
    spans = {"short": 60, "long": 1001}
    a, b = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, u long, v long")
    got = {row["id"]: (row["v_short"], row["v_long"]) for row in A.interval_totals(a, b, "k", "t", "u", ["id"], ["v"], spans, days=300 / 86400).collect()}
    want = {i: tuple(sum(v or 0 for k2, u, v in right if k2 == k and u is not None and t - s < u <= t) for s in spans.values()) for i, k, t in left}
    assert got == want
    assert A.interval_totals(a, b.limit(0), "k", "t", "u", ["id"], ["v"], spans).agg(F.sum("v_long")).first()[0] == 0


def test_totals_run_across_stretches(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), (F.col("id") * 86400).alias("t"), F.lit(1).alias("v"))
    run = A.running_totals(rows, "k", "t", ["v"], days=10).collect()
    assert sorted((r["t"] // 86400 + 1, r["v"]) for r in run) == [(i, i) for i in range(1, 1001)]


def test_snapshot(spark):
    bars = spark.createDataFrame([("A", later(i), 100.0 + i, 10.0) for i in range(40)] + [("B", later(i), 50.0 - i % 3, 0.0) for i in range(30)], "symbol string, bar_date date, close_px double, volume double")
    midnight = int(datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc).timestamp())
    news = spark.createDataFrame([("A", midnight, 1.0, 1.0), ("A", midnight - 86400, 0.75, -1.0), ("A", midnight - 86401, 0.75, 1 / 3), ("A", midnight - 259201, 1.0, 1.0), ("A", None, 1.0, 1.0)], "symbol string, published_ts long, weight double, tone double")
    s = S.training_snapshot(bars, news).collect()
    assert [(r["symbol"], r["bar_date"]) for r in s] == sorted((r["symbol"], r["bar_date"]) for r in s) and len(s) == 70
    row = next(r for r in s if r["symbol"] == "A" and r["bar_date"] == later(9))
    assert row["news_headline_count_24h"] == 2 and row["news_momentum_24h"] == 0.0 and row["news_momentum_72h"] == 0.1111
    assert row["news_source_score_72h"] == 0.8333 and row["news_sentiment_score"] == 0.2
    assert row["rsi_14"] is None and next(r for r in s if r["symbol"] == "A" and r["bar_date"] == later(20))["rsi_14"] is None  # no loss at all
    assert s[0]["macd_hist"] == 0.0 and s[39]["forward_return_5d"] is None and s[39]["label_up_5d"] == 0.0 and s[0]["label_up_5d"] == 1.0
    assert all(r["vol_ratio_20d"] is None for r in s if r["symbol"] == "B")
    assert S.training_snapshot(bars.limit(0), news).count() == 0


def test_snapshot_shuffles_its_bars_once_and_orders_by_the_same_shuffle(spark, sf_dir):
    """One shuffle makes bars of lines, one brings bars and news together; news used to be met by joins, and all columns sorted at the end."""
    plan = QUERIES["src10_training_snapshot"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 2 and plan.count("Exchange rangepartitioning(symbol") == 1
    assert plan.count("Exchange hashpartitioning") == 2  # bars of lines, news by day
    assert plan.count("Join") == 1  # with the number of suppliers


def test_news_between_two_midnights_are_added_up_before_they_meet_bars(spark):
    bars = spark.createDataFrame([("A", later(n), 100.0, 1.0) for n in range(9)], "symbol string, bar_date date, close_px double, volume double")
    start = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp())
    news = spark.range(20_000).select(F.lit("A").alias("symbol"), (F.lit(start) + F.col("id") * 20).alias("published_ts"), F.lit(1.0).alias("weight"), F.lit(0.5).alias("tone"))
    s = S.news_columns(bars, news).orderBy("bar_date").collect()
    want = [sum(1 for i in range(20_000) if 0 <= n * 86400 - i * 20 <= 86400) for n in range(9)]
    assert [r["news_headline_count_24h"] for r in s] == want and want[1] == 4321
    assert "HashAggregate" in S.news_columns(bars, news)._jdf.queryExecution().executedPlan().toString()


def test_snapshot_in_several_ranges_of_symbols_equals_a_loop(spark):
    r, name = random.Random(5), "spark.sql.adaptive.coalescePartitions.enabled"
    bars = [(f"S{i}", later(n), r.randrange(90, 110) + 0.5, float(r.randrange(1, 9))) for i in range(40) for n in range(i % 7 + 1)] + [("S3", None, 1.0, 1.0), (None, later(1), 1.0, 1.0)]
    start = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp())
    news = [(r.choice(["S5", f"S{r.randrange(40)}", "none", None]), start + r.randrange(-5, 7 * 4 + 1) * 21600, 0.75, r.choice([0.5, -1.0, None])) for _ in range(900)] + [("S5", None, 1.0, 1.0)]
    r.shuffle(bars)
    kept = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        s = S.training_snapshot(spark.createDataFrame(bars, "symbol string, bar_date date, close_px double, volume double").repartition(5), spark.createDataFrame(news, "symbol string, published_ts long, weight double, tone double"))
        got = s.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(name, kept)
    dated = sorted(b for b in bars if b[0] and b[1])
    assert [(x["symbol"], x["bar_date"], x["close_px"], x["volume"]) for x in got] == dated and len({x["part"] for x in got}) > 1
    before = {}
    for x in got:
        at = start + (x["bar_date"] - DAY).days * 86400
        tones = {h: [t or 0.0 for k, u, _, t in news if k == x["symbol"] and u is not None and 0 <= at - u <= h * 3600] for h in (24, 72)}
        mean = {h: sum(t) / len(t) if t else 0.0 for h, t in tones.items()}
        assert x["news_headline_count_24h"] == len(tones[24]) and x["news_source_score_72h"] == (0.75 if tones[72] else 0.0)
        assert abs(x["news_momentum_24h"] - mean[24]) < 6e-5 and abs(x["news_momentum_72h"] - mean[72]) < 6e-5 and abs(x["news_sentiment_score"] - mean[72]) < 6e-5
        assert x["return_1d"] == (x["close_px"] / before[x["symbol"]] - 1 if x["symbol"] in before else None)
        before[x["symbol"]] = x["close_px"]


def test_feature_names(spark):
    good, bad = ["feature_rsi_14", "feature_Beta", "feature_return_1d_lagged"], ["rsi", "feature_return_5d", "feature_rec_return", "feature_forward_return", "feature_color", "feature_days_since_last_signal", "Feature_label_rsi"]
    assert [c for c in good + bad if S.is_market_feature(c)] == good
    frame = spark.createDataFrame([("1.5", None, float("nan"), True), ("x", None, float("nan"), None), ("inf", None, float("nan"), False)], "feature_rsi_14 string, feature_beta double, feature_sma double, feature_trend boolean")
    assert {r["feature"]: r["n"] for r in S.market_features(frame).collect()} == {"feature_rsi_14": 2, "feature_trend": 2}
    assert S.market_features(frame.select("feature_beta").withColumnRenamed("feature_beta", "x")).count() == 0
    names = spark.createDataFrame([("feature_rsi_14",), ("feature_vwap",), ("feature_REC_buy",), (None,)], "c string")
    assert [r[0] for r in names.select(S.contract_breach(F.col("c"))).collect()] == [None, "unlisted", "forbidden", None]


def test_split_reports(spark, tmp_path):
    bars = spark.createDataFrame([("A", later(i), 100.0 if i < 30 else 25.0) for i in range(60)], "symbol string, bar_date date, close_px double")
    splits = spark.createDataFrame([("A", later(30), "forward_split", 1.0, 4.0, "s1"), ("B", later(3), "forward_split", 1.0, 2.0, "s2")], "ticker string, execution_date date, adjustment_type string, split_from double, split_to double, id string")
    decisions = spark.createDataFrame([(i, "A", later(i)) for i in range(60)] + [(99, "A", later(-5)), (100, "Z", later(4))], "seq long, symbol string, event_date date")
    rows = R.training_rows(decisions, R.windows(bars, splits)).cache()
    assert rows.count() == 60
    shown = {(r["version"], r["field"]): r for r in R.distributions(rows).collect()}
    raw, clean = shown["before", "feature_return_1d_lagged"], shown["after", "feature_return_1d_lagged"]
    assert (raw["n"], raw["least"], raw["most"]) == (59, -0.75, 0.0) and abs(clean["least"]) < 1e-9 and abs(clean["most"]) < 1e-9
    assert shown["before", "return_5d"]["n"] == 55 and len(shown) == 14
    audit = {r["id"]: (r["affected_feature_rows"], r["affected_label_rows"]) for r in R.audit(rows, splits).collect()}
    assert audit == {"s1": (20, 5), "s2": (0, 0)}  # windows (i - 20, i] and (i, i + 5]
    wrong = R.training_rows(decisions, R.windows(bars, splits.withColumn("split_to", F.col("split_to") * 4)))
    odd = R.suspicious(wrong, splits).where("version = 'after'").collect()
    assert {(r["seq"], r["field"], r["split_ids"], r["known_split"]) for r in odd if r["field"] == "feature_return_1d_lagged"} == {(30, "feature_return_1d_lagged", "s1", True)}
    R.write_reports(rows, splits, str(tmp_path))
    written = [json.loads(line) for f in (tmp_path / "split_audit").glob("*.json") for line in f.read_text().splitlines()]
    assert {w["id"] for w in written} == {"s1", "s2"}


ROW = "version string, symbol string, ts long, seq long, action string, ret double, probability double, cost_bps double, adverse double, source_mode string, profile string, is_stale boolean, is_degraded boolean, base_action string"


def test_validation_against_a_loop(spark):
    r = random.Random(5)
    actions = ["BUY", " strong buy", "SELL", "HOLD OFF FOR NOW", "HOLD", None]
    rows = [("b", r.choice("xy"), i * 40000, i, r.choice(actions), r.choice([None, float("nan"), 0.0, r.uniform(-0.1, 0.1)]), r.choice([None, r.random(), 100 * r.random(), 250.0, -0.5]), r.choice([None, 5.0]), r.choice([None, -0.01 * r.random()]), r.choice([None, "", "live", "Delayed_FALLBACK"]), r.choice([None, "p"]), r.choice([None, True, False]), r.choice([None, True, False]), r.choice([None, "", "buy", "SELL"])) for i in range(500)]
    m = V.summary(spark.createDataFrame(rows, ROW), ["version"]).first()
    seen, last, t, c = [], {}, 0, 0
    for row in rows:
        action, ret = (row[4] or "").strip().upper(), row[5]
        if action not in ("BUY", "STRONG BUY", "SELL", "HOLD OFF FOR NOW") or ret is None or ret != ret:
            continue
        if row[1] in last:
            t, c = t + 1, c + (last[row[1]] != action)
        last[row[1]] = action
        wait = action in ("SELL", "HOLD OFF FOR NOW")
        p = row[6]
        p = None if p is None else max(0.0, min(1.0, p / 100 if p > 1 else p))
        seen.append((row, wait, -ret if wait else ret, p, ret > 0))
    mean = lambda v: round(sum(v) / len(v), 6)
    scored = [(p, up) for _, _, _, p, up in seen if p is not None]
    assert m["evaluated_rows"] == len(seen) and m["calibration_rows"] == len(scored)
    assert abs(m["brier_score"] - mean([(p - up) ** 2 for p, up in scored])) < 2e-6
    bins = {}
    for p, up in scored:
        bins.setdefault(min(9, int(p * 10)), []).append((p, up))
    assert abs(m["calibration_error"] - sum(abs(sum(p for p, _ in b) - sum(u for _, u in b)) for b in bins.values()) / len(scored)) < 2e-6
    assert abs(m["avg_net_return"] - mean([d - (row[7] or 0) / 10000 for row, _, d, _, _ in seen])) < 2e-6
    assert m["recommendation_churn_rate"] == round(c / t, 6)
    assert m["stale_data_rate"] == mean([bool(row[11]) for row, *_ in seen])
    assert m["fallback_rate"] == mean([bool(row[12]) or "fallback" in (row[9] or "").lower() for row, *_ in seen])
    assert m["profile_override_rate"] == mean([bool(row[13]) and row[13].upper() != row[4].strip().upper() for row, *_ in seen])
    assert m["sell_recall"] == round(sum(w and not up for _, w, _, _, up in seen) / sum(not up for *_, up in seen), 6)


def test_gates_without_a_baseline(spark):
    rows = [("new", "x", i * 86400, i, "BUY", 0.01, 0.9, None, -0.02, "live", "p", False, False, None) for i in range(40)]
    frame = spark.createDataFrame(rows, ROW)
    ready = V.report(frame, "version", "new", "old", {"review": True}, stored).collect()
    assert [r["name"] for r in ready if r["section"] == "recommendation"] == ["promote"]
    assert [r["severity"] for r in ready if r["name"] == "adverse_excursion_regression"] == ["warning"]
    held = V.report(frame.limit(10), "version", "new", "old", {"review": False}, stored).collect()
    assert {r["name"] for r in held if r["passed"] is False} == {"minimum_evaluated_rows", "review"}
    nothing = V.report(frame.limit(0), "version", "new", "old", {"review": True}, stored).collect()
    assert [r["name"] for r in nothing] == ["hold_shadow"]


def test_hygiene(spark):
    clean = [("clean", p, later(p * 40 + i), "A") for p in range(4) for i in range(10)]
    rows = clean + [("touching", p, later(p * 12 + i), "A") for p in range(4) for i in range(10)] + [("short", p, d, s) for _, p, d, s in clean if p != 2] + [("mixed", p, d, s) for _, p, d, s in clean] + [("mixed", 1, later(3), "B"), ("mixed", 1, later(4), "A")]
    kept = [("clean", "w", 1.0, 1.0), ("touching", "w", 1.0, 1.1), ("short", "w", 1.0, None)]
    got = {r["split"]: r for r in V.hygiene(spark.createDataFrame(rows, "split string, period int, event_date date, symbol string"), spark.createDataFrame(kept, "split string, name string, stated double, rerun double")).collect()}
    flags = {k: (r["split_ok"], r["purge_ok"], r["reproduced"]) for k, r in got.items()}
    assert flags == {"clean": (True, True, True), "touching": (True, False, False), "short": (False, False, False), "mixed": (False, False, False)}
    assert got["clean"]["issues"] == "" and (got["mixed"]["shared_days"], got["mixed"]["shared_pairs"], got["mixed"]["short_gaps"]) == (1, 1, 1)


def test_drivers_and_cards(spark):
    artifact = {"a": (1.0, 2.0, 0.5), "b": (0.0, 0.0, -1.0), "c": (3.0, 1.0, 0.2)}
    rows = spark.createDataFrame([(3.0, 0.25, None), (float("nan"), 0.0, float("inf"))], "a double, b double, c double")
    first, empty = (r[0] for r in G.with_score(rows, artifact, 0.0, "p").select(G.drivers(artifact, 2)).collect())
    assert [(x["rank"], x["feature"], x["contribution"]) for x in first] == [(1, "a", 0.5), (2, "b", -0.25)]
    assert [(x["feature"], x["value"], x["contribution"]) for x in empty] == [("a", 1.0, 0.0), ("b", 0.0, 0.0)]
    quotes = spark.createDataFrame([("A", 110.0, 10.0, None, 60.0), ("B", 110.0, None, 100.0, None), ("C", 110.0, 10.0, None, 345601.0), ("D", None, 10.0, 5.0, 1.0), ("E", 7.0, -100.0, None, 345600.0)], "symbol string, price double, change_percent double, previous_close double, age double")
    closes = spark.createDataFrame([("A", later(i), float(i)) for i in range(20)], "symbol string, at date, close double")
    cards = {r["symbol"]: r for r in G.index_cards(quotes, closes).collect()}
    assert (cards["A"]["previous_close"], cards["A"]["change"], cards["A"]["series"]) == (100.0, 10.0, [float(i) for i in range(5, 20)])
    assert (cards["B"]["change_percent"], cards["B"]["series"]) == (10.0, [])
    assert [cards[s]["unavailable_reason"] for s in "CDE"] == ["quote_older_than_96h", "missing_current_value", None] and cards["E"]["previous_close"] is None


def test_comparison_scope(spark):
    rows = [("a", "x" if i % 2 else "X", None if i % 3 else "e", later(i), 1.0, "2") for i in range(10)] + [("b", None, "e", later(0), None if i < 3 else 1.0, "nan") for i in range(10)]
    frame = spark.createDataFrame(rows, "g string, symbol string, endpoint string, event_date date, p double, q string")
    got = {r["g"]: r for r in V.comparison_scope(frame, "g", ["p"], ["p", "q"], {"target": True}, 10).collect()}
    assert (got["a"]["n"], got["a"]["symbols"], got["a"]["endpoints"], got["a"]["evidence"], got["a"]["reasons"]) == (10, 1, 2, True, "")
    assert got["b"]["reasons"] == "production features filled; candidate features incomplete" and not got["b"]["like_with_like"]
    other = {r["g"]: r for r in V.comparison_scope(frame, "g", ["p"], ["gone"], {"target": False}, 11).collect()}
    assert other["a"]["reasons"] == "too few rows; production features filled; target differs" and other["a"]["scope"] == "narrow_diagnostic"
    shares = {(r["g"], r["feature"]): r["availability_rate"] for r in V.coverage(frame, "g", ["p", "q", "gone"]).collect()}
    assert shares == {("a", "p"): 1.0, ("a", "q"): 1.0, ("a", "gone"): 0.0, ("b", "p"): 0.7, ("b", "q"): 0.0, ("b", "gone"): 0.0}
    assert V.comparison_scope(frame.limit(0), "g", ["p"], ["q"], {}).count() == 0


def test_decisions_beside_bars_equal_training_rows(spark):
    bars = spark.createDataFrame([("A", later(i), 100.0 if i < 30 else 25.0) for i in range(60)], "symbol string, bar_date date, close_px double")
    splits = spark.createDataFrame([("A", later(30), "forward_split", 1.0, 4.0, "s1"), ("B", later(3), "forward_split", 1.0, 2.0, "s2")], "ticker string, execution_date date, adjustment_type string, split_from double, split_to double, id string")
    decisions = spark.createDataFrame([(i, "A", later(i)) for i in range(60)] + [(98, "A", later(7)), (99, "A", later(-5)), (100, "Z", later(4))], "seq long, symbol string, event_date date")
    rows, beside = R.training_rows(decisions, R.windows(bars, splits)), R.decided_rows(decisions, bars, splits)
    assert beside.columns == rows.columns and sorted(map(str, beside.collect())) == sorted(map(str, rows.collect()))
    moved = [line for line in beside._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert moved and not any("_macd" in line for line in moved)
