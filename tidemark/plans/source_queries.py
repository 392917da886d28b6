"""Round trips of readers and sinks, further filters, aggregates and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources import files as S
from ..sources import market as M
from .evaluation_queries import _O, _SCORED, judged, scored
from .registry import query


def _new(spark: SparkSession, name: str) -> str:
    base = S.work_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_BARS = M.with_views("bars") + "SELECT symbol, bar_date, open_px, high_px, low_px, close_px, volume FROM bars"


@query("src01_bar_files", _BARS)
def bar_files(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as JSON lines and CSV by year, and read again."""
    path, bars = _new(spark, "bars"), M.bars(spark, d)
    bars.where("year(bar_date) < 1998").write.option("compression", "gzip").json(f"{path}/a")
    bars.where("year(bar_date) >= 1998").write.option("header", True).csv(f"{path}/b")
    return S.read_bar_files(spark, path)


@query("src02_last_file_wins", M.with_views("bars") + "SELECT symbol, bar_date, round(close_px + 1, 6) AS close_px FROM bars WHERE bar_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def last_file_wins(spark: SparkSession, d: str) -> DataFrame:
    path, bars = _new(spark, "bars"), M.bars(spark, d)
    bars.write.json(f"{path}/a")
    first = spark.read.schema(bars.schema).json(f"{path}/a")  # the bars are made once
    first.withColumn("close_px", F.col("close_px") + 1).write.json(f"{path}/b")
    return S.read_bar_files(spark, path, start="1996-01-01", end="1996-12-31").select("symbol", "bar_date", F.round("close_px", 6).alias("close_px"))


@query("src03_decision_log", M.with_views("decisions") + "SELECT seq, ts, symbol, action, probability_up FROM decisions ORDER BY ts DESC, seq DESC LIMIT 500")
def decision_log(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "decisions")
    M.decisions(spark, d).write.json(path)
    return S.latest_events(S.read_json_rows(spark, path, S.DECISION), 500).select("seq", "ts", "symbol", "action", "probability_up")


@query("src06_strict_splits", M.with_views("splits") + "SELECT ticker, execution_date, adjustment_type, split_from, split_to, id FROM splits")
def strict_splits(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "splits")
    M.splits(spark, d).write.json(path)
    return S.read_splits_strict(spark, path)


@query("src07_provider_bars", M.with_views("bars") + "SELECT *, (high_px + low_px) / 2 AS vwap, CAST(volume AS BIGINT) AS trades FROM bars WHERE volume <> 7")
def provider_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars as a provider's nested JSON, a document for each symbol and year, flattened again."""
    ms = F.unix_millis(F.col("bar_date").cast("timestamp"))
    r = F.struct(F.col("open_px").alias("o"), F.col("high_px").alias("h"), F.col("low_px").alias("l"), F.col("close_px").alias("c"), F.col("volume").alias("v"), ((F.col("high_px") + F.col("low_px")) / 2).alias("vw"), F.when(F.col("volume") != 7, F.col("volume").cast("bigint")).alias("n"), ms.alias("t"))
    packed = M.bars(spark, d).groupBy("symbol", F.year("bar_date")).agg(F.to_json(F.struct(F.col("symbol").alias("ticker"), F.collect_list(r).alias("results"))).alias("value"))
    return S.provider_bars(packed)


@query("snk03_partition_tree", M.with_views("decisions") + "SELECT endpoint, CAST(year(event_date) AS INTEGER) AS event_year, count(*) AS rows FROM decisions GROUP BY 1, 2")
def partition_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = M.decisions(spark, d).withColumn("event_year", F.year("event_date"))
    return S.write_partition_tree(rows, _new(spark, "tree"), ["endpoint", "event_year"])


@query("snk05_union_columns", M.with_views("decisions", "splits") + "SELECT symbol, seq, action, NULL::DOUBLE AS split_to FROM decisions UNION ALL SELECT ticker, NULL, NULL, split_to FROM splits")
def union_columns(spark: SparkSession, d: str) -> DataFrame:
    a = M.decisions(spark, d).select("seq", "symbol", "action")
    b = M.splits(spark, d).select(F.col("ticker").alias("symbol"), "split_to")
    return S.union_columns([a, b], ["symbol", "seq"])


@query("flt02_eligible", M.with_views("decisions") + "SELECT seq FROM decisions WHERE model_version LIKE '%5d' AND probability_up IS NOT NULL AND endpoint <> 'quick_ask' AND symbol <> ''")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).where("model_version like '%5d' and probability_up is not null and endpoint <> 'quick_ask' and symbol <> ''").select("seq")


@query("flt03_mature", M.with_views("decisions", more="n AS (SELECT max(ts) AS now_ts FROM decisions)") + "SELECT seq FROM decisions, n WHERE now_ts - ts >= 7 * 86400")
def mature(spark: SparkSession, d: str) -> DataFrame:
    dec = M.decisions(spark, d)
    now = dec.agg(F.max("ts").alias("now_ts"))
    return dec.crossJoin(F.broadcast(now)).where("now_ts - ts >= 7 * 86400").select("seq")  # one row


@query("flt08_with_outcome", _O + "SELECT seq FROM y WHERE r5 IS NOT NULL AND outcome IN ('correct', 'incorrect')")
def with_outcome(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).where("ret_5 is not null and outcome in ('correct', 'incorrect')").select("seq")


@query("agg10_scanned_fitted", _O + "SELECT endpoint, count(*) AS scanned, count(*) FILTER (probability_up IS NOT NULL) AS eligible, count(*) FILTER (probability_up IS NOT NULL AND r5 IS NOT NULL) AS fitted FROM y GROUP BY endpoint")
def scanned_fitted(spark: SparkSession, d: str) -> DataFrame:
    p, r = F.col("probability_up").isNotNull(), F.col("ret_5").isNotNull()
    return judged(spark, d).groupBy("endpoint").agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(p, 1)).alias("eligible"), F.count(F.when(p & r, 1)).alias("fitted"))


@query("agg18_utility", _SCORED + """SELECT round(avg(CASE WHEN (probability_up >= 0.5) = (up = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(r5) FILTER (probability_up >= 0.5), 6) AS selected_return,
  round(avg(least(r5, 0)) FILTER (probability_up >= 0.5), 6) AS downside, round(count(*) FILTER (probability_up >= 0.5 AND r5 > 0.03) / count(*) FILTER (r5 > 0.03)::DOUBLE, 6) AS capture FROM s""")  # fmt: skip
def utility(spark: SparkSession, d: str) -> DataFrame:
    hit, r = F.col("probability_up") >= 0.5, F.col("ret_5")
    return scored(spark, d).agg(
        F.round(F.avg((hit == (F.col("up") == 1)).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(F.when(hit, r)), 6).alias("selected_return"),
        F.round(F.avg(F.when(hit, F.least(r, F.lit(0.0)))), 6).alias("downside"),
        F.round(F.count(F.when(hit & (r > 0.03), 1)) / F.count(F.when(r > 0.03, 1)), 6).alias("capture"),
    )


@query("agg21_fill_rates", M.with_views("decisions") + "SELECT 'probability_up' AS feature, count(probability_up) AS present, round(count(probability_up) / count(*)::DOUBLE, 6) AS rate FROM decisions UNION ALL SELECT 'action', count(action), round(count(action) / count(*)::DOUBLE, 6) FROM decisions")
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.struct(F.lit(c).alias("feature"), F.count(c).alias("present"), F.round(F.count(c) / F.count(F.lit(1)), 6).alias("rate"))
    return M.decisions(spark, d).agg(F.array(one("probability_up"), one("action")).alias("f")).select(F.explode("f").alias("f")).select("f.*")


@query("agg22_feature_leak", _SCORED + "SELECT round(corr(probability_up, r5), 6) AS pearson, round(avg(CASE WHEN abs(probability_up - r5) < 1e-9 THEN 1e0 ELSE 0e0 END), 6) AS equal_share, count(*) AS pairs FROM s")
def feature_leak(spark: SparkSession, d: str) -> DataFrame:
    same = (F.abs(F.col("probability_up") - F.col("ret_5")) < 1e-9).cast("double")
    return scored(spark, d).agg(F.round(F.corr("probability_up", "ret_5"), 6).alias("pearson"), F.round(F.avg(same), 6).alias("equal_share"), F.count(F.lit(1)).alias("pairs"))


@query("agg23_collapsed", _SCORED + "SELECT event_date, symbol, round(avg(probability_up), 6) AS mean_p, round(avg(r5), 6) AS mean_r, count(*) AS variants, avg(CASE WHEN probability_up >= 0.5 THEN 1e0 ELSE 0e0 END) >= 0.5 AS predicted_up FROM s GROUP BY 1, 2")
def collapsed(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("event_date", "symbol").agg(F.round(F.avg("probability_up"), 6).alias("mean_p"), F.round(F.avg("ret_5"), 6).alias("mean_r"), F.count(F.lit(1)).alias("variants"), (F.avg((F.col("probability_up") >= 0.5).cast("double")) >= 0.5).alias("predicted_up"))


@query("agg29_sector_values", M.with_views("positions", "sectors") + "SELECT coalesce(sector, 'UNKNOWN') AS sector, round(sum(shares * buy_price), 4) AS value, count(*) AS n FROM positions LEFT JOIN sectors USING (symbol) GROUP BY 1")
def sector_values(spark: SparkSession, d: str) -> DataFrame:
    p = M.positions(spark, d).join(M.sectors(spark, d), "symbol", "left")
    return p.groupBy(F.coalesce("sector", F.lit("UNKNOWN")).alias("sector")).agg(F.round(F.sum(F.col("shares") * F.col("buy_price")), 4).alias("value"), F.count(F.lit(1)).alias("n"))


@query("agg33_top_counts", M.with_views("decisions", more="c AS (SELECT symbol, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, symbol) AS k FROM decisions GROUP BY symbol)") + "SELECT symbol, n FROM c WHERE k <= 10")
def top_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(10)


@query("agg35_failures", M.with_views("ticks") + "SELECT symbol, count(*) FILTER (k % 33 = 0) AS failures, max(event_id) FILTER (k % 33 = 0) AS last_failure, count(*) FILTER (k % 33 = 0) >= 2 AS rejected FROM ticks GROUP BY symbol")
def failures(spark: SparkSession, d: str) -> DataFrame:
    bad = F.pmod("k", F.lit(33)) == 0
    return M.ticks(spark, d).groupBy("symbol").agg(F.count(F.when(bad, 1)).alias("failures"), F.max(F.when(bad, F.col("event_id"))).alias("last_failure"), (F.count(F.when(bad, 1)) >= 2).alias("rejected"))


@query("top03_daily_portfolio", _SCORED + """, t AS (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY probability_up DESC, symbol, seq) AS k FROM s),
g AS (SELECT event_date, sum(0.1e0 * greatest(-0.5e0, least(0.5e0, r5))) AS ret FROM t WHERE k <= 5 GROUP BY event_date)
SELECT event_date, round(ret, 6) AS ret, round(exp(sum(ln(1 + ret)) OVER (ORDER BY event_date)), 6) AS equity FROM g""")  # fmt: skip
def daily_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Five best of each day at a tenth each; the equity runs over one row per day."""
    t = E.top_k(scored(spark, d), ["event_date"], [F.desc("probability_up"), F.col("symbol"), F.col("seq")], 5)
    g = t.groupBy("event_date").agg(F.sum(0.1 * F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("ret_5")))).alias("ret"))
    w = Window.partitionBy(F.lit(0)).orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("event_date", F.round("ret", 6).alias("ret"), F.round(F.exp(F.sum(F.log(1 + F.col("ret"))).over(w)), 6).alias("equity"))


@query("set07_set_differences", M.with_views("ticks", "positions") + "SELECT symbol, 'missing' AS side FROM (SELECT DISTINCT 'U' || user_id AS symbol FROM positions EXCEPT SELECT symbol FROM ticks) UNION ALL SELECT symbol, 'extra' FROM (SELECT symbol FROM ticks EXCEPT SELECT 'U' || user_id FROM positions)")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    want = M.positions(spark, d).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol")).distinct()
    have = M.ticks(spark, d).select("symbol").distinct()
    return want.join(have, "symbol", "left_anti").withColumn("side", F.lit("missing")).unionByName(have.join(want, "symbol", "left_anti").withColumn("side", F.lit("extra")))


@query("spt08_window_consistency", _SCORED + ", q AS (SELECT *, ntile(3) OVER (ORDER BY event_date, seq) AS part FROM s) SELECT CAST(part AS INTEGER) AS part, count(*) AS n, round(avg(CASE WHEN (probability_up >= 0.5) = (up = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM q GROUP BY part")
def window_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Three equal row windows in time: rows are counted per day, so no window ranks all rows in one task."""
    s = scored(spark, d)
    w = Window.partitionBy(F.lit(0)).orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)
    days = s.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    days = days.select("event_date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("event_date").orderBy("seq")) - 1
    big = F.pmod("total", F.lit(3))
    size = F.floor(F.col("total") / 3)
    r = s.join(F.broadcast(days), "event_date").withColumn("at", at)  # one row per day
    edge = big * (size + 1)
    part = F.when(F.col("at") < edge, F.floor(F.col("at") / (size + 1)) + 1).otherwise(big + F.floor((F.col("at") - edge) / size) + 1)
    hit = (F.col("probability_up") >= 0.5) == (F.col("up") == 1)
    return r.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


@query("evl08_gates", _SCORED + """, m AS (SELECT avg((probability_up - up) * (probability_up - up)) AS brier, avg(r5) FILTER (probability_up >= 0.5) AS ret, count(DISTINCT event_date) AS days FROM s)
SELECT gate, round(value, 6) AS value, lim, ok FROM (SELECT 'brier' AS gate, brier AS value, 0.3e0 AS lim, brier <= 0.3e0 AS ok FROM m UNION ALL SELECT 'return', ret, 0e0, ret >= 0e0 FROM m UNION ALL SELECT 'days', days::DOUBLE, 20e0, days >= 20 FROM m)""")  # fmt: skip
def gates(spark: SparkSession, d: str) -> DataFrame:
    m = scored(spark, d).agg(E.brier(F.col("probability_up"), F.col("up")).alias("brier"), F.avg(F.when(F.col("probability_up") >= 0.5, F.col("ret_5"))).alias("ret"), F.count_distinct("event_date").cast("double").alias("days"))
    row = lambda gate, c, lim, ok: F.struct(F.lit(gate).alias("gate"), F.round(F.col(c), 6).alias("value"), F.lit(lim).alias("lim"), ok.alias("ok"))
    return m.select(F.explode(F.array(row("brier", "brier", 0.3, F.col("brier") <= 0.3), row("return", "ret", 0.0, F.col("ret") >= 0), row("days", "days", 20.0, F.col("days") >= 20))).alias("g")).select("g.*")
