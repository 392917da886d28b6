"""Queries of aggregates, rankings, set operations and temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import windows as W
from ..operators import evaluation as E
from ..sources import market as M
from .join_queries import _EXPOSURE, _FORWARD, _OUTCOME, outcomes
from .registry import query

_O = M.with_views("bars", "decisions", more=_FORWARD + f", x AS (SELECT *, e1 / entry - 1 AS r1, e5 / entry - 1 AS r5, {_EXPOSURE} AS side FROM o), y AS (SELECT *, {_OUTCOME.replace('r ', 'r5 ')} AS outcome FROM x)")
_SCORED = M.with_views("bars", "decisions", more=_FORWARD + ", s AS (SELECT *, e5 / entry - 1 AS r5, CASE WHEN e5 / entry - 1 > 0 THEN 1e0 ELSE 0e0 END AS up FROM o WHERE probability_up IS NOT NULL AND e5 IS NOT NULL)")


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with returns, side and outcome."""
    o = outcomes(spark, d, [1, 5])
    return o.withColumns({"outcome": D.outcome(F.col("action"), F.col("ret_5")), "side": D.exposure(F.col("action"))})


def scored(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d, [5]).where("probability_up is not null and ret_5 is not null").withColumn("up", (F.col("ret_5") > 0).cast("double"))


@query("agg01_outcome_summary", _O + """SELECT count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'incorrect') AS incorrect, count(*) FILTER (outcome = 'neutral') AS neutral,
  count(*) FILTER (outcome = 'skipped') AS skipped, round(count(*) FILTER (outcome = 'correct') / nullif(count(*) FILTER (outcome IN ('correct', 'incorrect')), 0)::DOUBLE, 6) AS accuracy, round(avg(r1), 6) AS mean_1, round(avg(r5), 6) AS mean_5 FROM y""")  # fmt: skip
def outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    n = lambda *v: F.count(F.when(F.col("outcome").isin(*v), 1))
    return judged(spark, d).agg(*[n(v).alias(v) for v in ("correct", "incorrect", "neutral", "skipped")], F.round(n("correct") / n("correct", "incorrect"), 6).alias("accuracy"), F.round(F.avg("ret_1"), 6).alias("mean_1"), F.round(F.avg("ret_5"), 6).alias("mean_5"))


@query("agg02_by_action", _O + """, a(action) AS (VALUES ('STRONG BUY'), ('BUY'), ('HOLD'), ('HOLD OFF FOR NOW'), ('SELL'), ('REDUCE'))
SELECT a.action, count(y.r5) AS evaluated, round(avg(y.r5), 6) AS mean_5, round(avg(y.r5 * y.side), 6) + 0 AS paper_5 FROM a LEFT JOIN y ON y.action = a.action GROUP BY a.action""")  # fmt: skip
def by_action(spark: SparkSession, d: str) -> DataFrame:
    actions = spark.createDataFrame([(a,) for a in ("STRONG BUY", "BUY", "HOLD", "HOLD OFF FOR NOW", "SELL", "REDUCE")], "action string")
    g = judged(spark, d).groupBy("action").agg(F.count("ret_5").alias("evaluated"), F.round(F.avg("ret_5"), 6).alias("mean_5"), (F.round(F.avg(F.col("ret_5") * F.col("side")), 6) + 0).alias("paper_5"))
    return actions.join(g, "action", "left").select("action", F.coalesce("evaluated", F.lit(0)).alias("evaluated"), "mean_5", "paper_5")


@query("agg04_sources", M.with_views("decisions") + "SELECT decision_source, endpoint, count(*) AS n, max(ts) AS latest FROM decisions GROUP BY 1, 2")
def sources(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).groupBy("decision_source", "endpoint").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query("agg06_brier", _SCORED + "SELECT count(*) AS n, round(avg((probability_up - up) * (probability_up - up)), 6) AS brier FROM s")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(E.brier(F.col("probability_up"), F.col("up")), 6).alias("brier"))


_BINS = "bins AS (SELECT CAST(least(floor(probability_up * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(probability_up) AS mean_p, avg(up) AS mean_y FROM s GROUP BY 1)"


@query("agg07_calibration_error", _SCORED + f", {_BINS} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece FROM bins")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return E.expected_calibration_error(E.calibration_bins(scored(spark, d), "probability_up", "up")).select("n", F.round("ece", 6).alias("ece"))


@query("agg08_calibration_bins", _SCORED + f", {_BINS} SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(mean_y - mean_p, 6) AS delta FROM bins")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    b = E.calibration_bins(scored(spark, d), "probability_up", "up")
    return b.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"), F.round(F.col("mean_y") - F.col("mean_p"), 6).alias("delta"))


@query("agg09_segments", _SCORED + """SELECT segment, value, count(*) AS n, round(avg((probability_up - up) * (probability_up - up)), 6) AS brier, round(avg(probability_up), 6) AS mean_p, round(avg(up), 6) AS mean_y
FROM s, (VALUES ('endpoint'), ('decision_source'), ('model_version'), ('action')) AS k(segment), LATERAL (SELECT CASE segment WHEN 'endpoint' THEN endpoint WHEN 'decision_source' THEN decision_source WHEN 'model_version' THEN model_version ELSE action END AS value) GROUP BY 1, 2""")  # fmt: skip
def segments(spark: SparkSession, d: str) -> DataFrame:
    names = ["endpoint", "decision_source", "model_version", "action"]
    rows = scored(spark, d).select("probability_up", "up", F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.col(n).alias("value")) for n in names])).alias("k"))
    p, y = F.col("probability_up"), F.col("up")
    return rows.groupBy("k.segment", "k.value").agg(F.count(F.lit(1)).alias("n"), F.round(E.brier(p, y), 6).alias("brier"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("mean_y"))


@query("agg13_lower_percentiles", M.with_views("bars") + """SELECT symbol, min(volume) AS lo, max(volume) AS hi, list_sort(list(volume))[CAST(floor((count(*) - 1) * 0.5e0) AS BIGINT) + 1] AS p50,
  list_sort(list(volume))[CAST(floor((count(*) - 1) * 0.99e0) AS BIGINT) + 1] AS p99 FROM bars GROUP BY symbol""")  # fmt: skip
def lower_percentiles(spark: SparkSession, d: str) -> DataFrame:
    b = M.bars(spark, d)
    p = E.nearest_rank(b, ["symbol"], "volume", {"p50": 0.5, "p99": 0.99})
    return b.groupBy("symbol").agg(F.min("volume").alias("lo"), F.max("volume").alias("hi")).join(p, "symbol")


@query("agg14_feature_profile", M.with_views("bars") + """, m AS (SELECT quantile_cont(volume, 0.5) AS med FROM bars)
SELECT count(volume) AS n, round(avg(volume), 6) AS mean, round((SELECT med FROM m), 6) AS median, round(stddev_pop(volume), 6) AS std, round(quantile_cont(abs(volume - (SELECT med FROM m)), 0.5), 6) AS mad, round(quantile_cont(volume, 0.9), 6) AS p90 FROM bars""")  # fmt: skip
def feature_profile(spark: SparkSession, d: str) -> DataFrame:
    b = M.bars(spark, d)
    median = b.agg(F.percentile("volume", 0.5).alias("med"))
    r = b.crossJoin(F.broadcast(median))  # one row
    return r.agg(F.count("volume").alias("n"), F.round(F.avg("volume"), 6).alias("mean"), F.round(F.first("med"), 6).alias("median"), F.round(F.stddev_pop("volume"), 6).alias("std"), F.round(F.percentile(F.abs(F.col("volume") - F.col("med")), 0.5), 6).alias("mad"), F.round(F.percentile("volume", 0.9), 6).alias("p90"))


@query("agg16_bucket_economics", _SCORED + """SELECT CASE WHEN r5 < -0.03 THEN 'big_loss' WHEN r5 < -0.005 THEN 'loss' WHEN r5 <= 0.005 THEN 'flat' WHEN r5 <= 0.03 THEN 'gain' ELSE 'big_gain' END AS bucket,
  count(*) AS n, CAST(sum(up) AS BIGINT) AS positives, round(avg(probability_up), 6) AS mean_p, round(avg(r5), 6) AS mean_r FROM s GROUP BY 1""")  # fmt: skip
def bucket_economics(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy(D.return_bucket(F.col("ret_5")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("up").cast("long").alias("positives"), F.round(F.avg("probability_up"), 6).alias("mean_p"), F.round(F.avg("ret_5"), 6).alias("mean_r"))


@query("agg17_concentration", _SCORED + """, c AS (SELECT symbol, count(*) AS n, sum(abs(r5)) AS a FROM s WHERE probability_up >= 0.6 GROUP BY symbol)
SELECT round(max(n) / sum(n)::DOUBLE, 6) AS largest_share, round(max(a) / sum(a), 6) AS largest_move_share, round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 6) AS herfindahl FROM c""")  # fmt: skip
def concentration(spark: SparkSession, d: str) -> DataFrame:
    c = scored(spark, d).where("probability_up >= 0.6").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("ret_5")).alias("a"))
    n = F.col("n")
    return c.agg(F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"), F.round(F.max("a") / F.sum("a"), 6).alias("largest_move_share"), F.round(F.sum(n * n) / (F.sum("n") * F.sum("n")), 6).alias("herfindahl"))


@query("agg19_duplicates", M.with_views("decisions") + ", g AS (SELECT symbol, event_date, endpoint, decision_source, count(*) AS n FROM decisions GROUP BY 1, 2, 3, 4) SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n) * sum(n) / sum(n * n)::DOUBLE, 6) AS effective FROM g")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    g = M.decisions(spark, d).groupBy("symbol", "event_date", "endpoint", "decision_source").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum(n - 1).alias("duplicates"), F.round(F.sum("n") * F.sum("n") / F.sum(n * n), 6).alias("effective"))


@query("agg24_cohort_excess", _SCORED + """, c AS (SELECT event_date, avg(r5) AS universe, avg(r5) FILTER (probability_up >= 0.6) AS picked FROM s GROUP BY event_date)
SELECT event_date, round(universe, 6) AS universe, round(picked, 6) AS gross, round(picked - 0.002, 6) AS net, round(picked - 0.002 - universe, 6) AS excess FROM c""")  # fmt: skip
def cohort_excess(spark: SparkSession, d: str) -> DataFrame:
    c = scored(spark, d).groupBy("event_date").agg(F.avg("ret_5").alias("u"), F.avg(F.when(F.col("probability_up") >= 0.6, F.col("ret_5"))).alias("p"))
    return c.select("event_date", F.round("u", 6).alias("universe"), F.round("p", 6).alias("gross"), F.round(F.col("p") - 0.002, 6).alias("net"), F.round(F.col("p") - 0.002 - F.col("u"), 6).alias("excess"))


_EDGES = [102.0, 104.0, 106.0, 108.0]
_CUT = " + ".join(f"CASE WHEN close_px > {e}e0 THEN 1 ELSE 0 END" for e in _EDGES)


@query("agg27_stability_index", M.with_views("bars") + f""", b AS (SELECT {_CUT} AS bin, count(*) FILTER (bar_date < DATE '1998-01-01') AS a, count(*) FILTER (bar_date >= DATE '1998-01-01') AS c FROM bars GROUP BY 1),
k AS (SELECT g.bin, greatest(coalesce(a, 0), 0.5e0) AS a, greatest(coalesce(c, 0), 0.5e0) AS c FROM (SELECT unnest(range(5)) AS bin) g LEFT JOIN b USING (bin)), t AS (SELECT a / sum(a) OVER () AS p, c / sum(c) OVER () AS q FROM k)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM t""")  # fmt: skip
def stability_index(spark: SparkSession, d: str) -> DataFrame:
    b = M.bars(spark, d)
    cut = F.lit("1998-01-01").cast("date")
    return E.stability_index(b.where(F.col("bar_date") < cut), b.where(F.col("bar_date") >= cut), "close_px", _EDGES).select(F.round("psi", 6).alias("psi"))


@query("agg30_stream_lag", M.with_views("ticks") + """, l AS (SELECT type, k % 97 AS lag_ms FROM ticks) SELECT type, count(*) AS n, quantile_disc(lag_ms, 0.5) AS p50, quantile_disc(lag_ms, 0.95) AS p95, quantile_disc(lag_ms, 0.99) AS p99 FROM l GROUP BY type""")
def stream_lag(spark: SparkSession, d: str) -> DataFrame:
    lag = M.ticks(spark, d).select("type", F.pmod("k", F.lit(97)).alias("lag_ms"))
    p = E.nearest_rank(lag, ["type"], "lag_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, upper=True)
    return lag.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(p, "type")


@query("agg31_request_log", """WITH r AS (SELECT event_type AS endpoint, value AS ms, CASE WHEN k % 20 = 0 THEN 429 WHEN k % 33 = 0 THEN 500 ELSE 200 END AS status FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))
SELECT endpoint, count(*) AS n, count(*) FILTER (status >= 500) AS failures, count(*) FILTER (status = 429) AS throttles, round(min(ms), 6) AS lo, round(avg(ms), 6) AS mean, round(max(ms), 6) AS hi FROM r GROUP BY endpoint""")  # fmt: skip
def request_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    status = F.when(F.pmod(k, F.lit(20)) == 0, 429).when(F.pmod(k, F.lit(33)) == 0, 500).otherwise(200)
    r = M.table(spark, d, "events").select(F.col("event_type").alias("endpoint"), F.col("value").alias("ms"), status.alias("status"))
    return r.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") >= 500, 1)).alias("failures"), F.count(F.when(F.col("status") == 429, 1)).alias("throttles"), F.round(F.min("ms"), 6).alias("lo"), F.round(F.avg("ms"), 6).alias("mean"), F.round(F.max("ms"), 6).alias("hi"))


@query("agg38_periods", M.with_views("bars") + "SELECT CAST(year(bar_date) AS INTEGER) AS period, min(bar_date) AS first_day, max(bar_date) AS last_day, count(*) AS n, round(avg(close_px), 6) AS mean_close FROM bars GROUP BY 1")
def periods(spark: SparkSession, d: str) -> DataFrame:
    return M.bars(spark, d).groupBy(F.year("bar_date").alias("period")).agg(F.min("bar_date").alias("first_day"), F.max("bar_date").alias("last_day"), F.count(F.lit(1)).alias("n"), F.round(F.avg("close_px"), 6).alias("mean_close"))


@query("top01_latest_unique", M.with_views("decisions", more="u AS (SELECT max(ts) AS ts, max(seq) AS seq, event_date, symbol, endpoint, decision_source, action, model_version FROM decisions GROUP BY event_date, symbol, endpoint, decision_source, action, model_version)") + "SELECT * FROM u ORDER BY ts DESC, seq DESC LIMIT 100")
def latest_unique(spark: SparkSession, d: str) -> DataFrame:
    keys = ["event_date", "symbol", "endpoint", "decision_source", "action", "model_version"]
    u = M.decisions(spark, d).groupBy(*keys).agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
    return u.orderBy(F.desc("ts"), F.desc("seq")).limit(100).select("ts", "seq", *keys)


@query("top02_daily_top_k", _SCORED + """, t AS (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY probability_up DESC, symbol, seq) AS k FROM s)
SELECT event_date, count(*) AS n, round(avg(r5), 6) AS mean_r, round(avg(up), 6) AS precision_up FROM t WHERE k <= 3 GROUP BY event_date""")  # fmt: skip
def daily_top_k(spark: SparkSession, d: str) -> DataFrame:
    t = E.top_k(scored(spark, d), ["event_date"], [F.desc("probability_up"), F.col("symbol"), F.col("seq")], 3)
    return t.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret_5"), 6).alias("mean_r"), F.round(F.avg("up"), 6).alias("precision_up"))


@query("top15_last_bars", M.with_views("bars", more="r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS k FROM bars)") + "SELECT symbol, bar_date, close_px, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 10")
def last_bars(spark: SparkSession, d: str) -> DataFrame:
    return E.top_k(M.bars(spark, d), ["symbol"], [F.desc("bar_date")], 10).select("symbol", "bar_date", "close_px", "rank")


@query("set01_exact_duplicates", M.with_views("decisions", more="two AS (SELECT symbol, event_date, action, 1 AS pos FROM decisions)") + "SELECT symbol, event_date, action, count(*) - 1 AS dropped FROM two GROUP BY 1, 2, 3")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).groupBy("symbol", "event_date", "action").agg((F.count(F.lit(1)) - 1).alias("dropped"))


_BREAK = "h AS (SELECT symbol, bar_date, close_px >= max(high_px) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS broke FROM bars)"


def breakouts(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol().rowsBetween(-20, -1)
    return M.bars(spark, d).select("symbol", "bar_date", (F.col("close_px") >= F.max("high_px").over(w)).alias("broke"))


@query("set03_new_breakouts", M.with_views("bars", more=_BREAK) + "SELECT symbol FROM h WHERE broke AND bar_date >= DATE '1998-06-01' EXCEPT SELECT symbol FROM h WHERE broke AND bar_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def new_breakouts(spark: SparkSession, d: str) -> DataFrame:
    b = breakouts(spark, d).where("broke")
    now, before = b.where("bar_date >= date'1998-06-01'"), b.where("bar_date between date'1998-03-01' and date'1998-03-31'")
    return now.select("symbol").distinct().join(before.select("symbol"), "symbol", "left_anti")


@query("set05_shared_dates", M.with_views("bars", "decisions") + "SELECT event_date AS shared FROM decisions INTERSECT SELECT bar_date FROM bars")
def shared_dates(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).select(F.col("event_date").alias("shared")).distinct().join(M.bars(spark, d).select(F.col("bar_date").alias("shared")), "shared", "left_semi")


_SPLIT = """d AS (SELECT event_date, row_number() OVER (ORDER BY event_date) AS day_no, count(*) OVER () AS days FROM (SELECT DISTINCT event_date FROM decisions)),
b AS (SELECT min(event_date) AS boundary FROM d WHERE day_no = CAST(floor(days * 0.7e0) AS BIGINT) + 1)"""


@query("spt02_purge_embargo", M.with_views("decisions", more=_SPLIT) + """SELECT seq, CASE WHEN event_date < boundary - 5 THEN 'train' WHEN event_date < boundary THEN 'purged' WHEN event_date < boundary + 3 THEN 'embargoed' ELSE 'test' END AS part FROM decisions, b""")
def purge_embargo(spark: SparkSession, d: str) -> DataFrame:
    return E.purged_split(M.decisions(spark, d), "event_date", 0.7, 5, 3).select("seq", "part")


@query("spt05_date_shares", M.with_views("decisions", more=_SPLIT) + "SELECT seq, CASE WHEN day_no <= floor(days * 0.6e0) THEN 'train' WHEN day_no <= floor(days * 0.8e0) THEN 'validation' ELSE 'test' END AS part FROM decisions JOIN d USING (event_date)")
def date_shares(spark: SparkSession, d: str) -> DataFrame:
    r = E.date_ranks(M.decisions(spark, d), "event_date")
    part = F.when(F.col("day_no") <= F.floor(F.col("days") * 0.6), "train").when(F.col("day_no") <= F.floor(F.col("days") * 0.8), "validation").otherwise("test")
    return r.select("seq", part.alias("part"))


@query("spt06_expanding_folds", M.with_views("decisions", more=_SPLIT) + """SELECT f.fold, count(*) FILTER (day_no <= floor(days * a)) AS train, count(*) FILTER (day_no > floor(days * a) AND day_no <= floor(days * (a + 0.1e0))) AS validation,
  count(*) FILTER (day_no > floor(days * (a + 0.1e0)) AND day_no <= floor(days * (a + 0.2e0))) AS test FROM decisions JOIN d USING (event_date), (VALUES (1, 0.45e0), (2, 0.6e0), (3, 0.7e0)) AS f(fold, a) GROUP BY f.fold""")  # fmt: skip
def expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    r = E.date_ranks(M.decisions(spark, d), "event_date")
    folds = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(a).alias("a")) for k, a in ((1, 0.45), (2, 0.6), (3, 0.7))]))
    r = r.select("day_no", "days", folds.alias("f")).select("day_no", "f.fold", *[F.floor(F.col("days") * (F.col("f.a") + x)).alias(n) for n, x in (("c0", 0.0), ("c1", 0.1), ("c2", 0.2))])
    between = lambda lo, hi: F.count(F.when((F.col("day_no") > lo) & (F.col("day_no") <= hi), 1))
    return r.groupBy("fold").agg(between(F.lit(0), F.col("c0")).alias("train"), between(F.col("c0"), F.col("c1")).alias("validation"), between(F.col("c1"), F.col("c2")).alias("test"))
