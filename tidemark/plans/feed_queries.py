"""Queries of raw provider feeds: nested snapshots, stream frames, late ticks, gap requests and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import market as M
from ..streaming import ordering as S
from ..streaming.folding import run_folded
from ..streaming.keyed_table import run_upserts
from .decision_queries import _folder
from .registry import query

_T = "t AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS BIGINT) AS us, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def _base(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))


def raw_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames as text: objects, arrays of two, status messages and broken ones."""
    symbol = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    kind = F.element_at(F.array(F.lit("T"), F.lit("Q"), F.lit("AM")), (F.col("k") % 3 + 1).cast("int"))
    body = F.to_json(F.struct(kind.alias("ev"), symbol.alias("sym"), F.floor(F.col("us") / 1000).alias("e"), (F.col("us") * 1000).alias("t"), F.col("k").alias("q"), F.col("value").alias("p"), F.col("value").alias("c"), F.col("value").alias("bp"), F.when(F.col("k") % 5 != 0, F.col("value") + (F.col("k") % 4 - 1)).alias("ap"), F.col("value").alias("o"), F.col("value").alias("h"), F.col("value").alias("l"), F.when(F.col("k") % 7 != 0, 1.0).alias("v")))
    text = F.when(F.col("k") % 11 == 0, '{"ev":"status","status":"ok"}').when(F.col("k") % 13 == 0, '{"ev":"T","sym":"*"').when(F.col("k") % 2 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return _base(spark, d).select("event_id", text.alias("value"))


_PRICE = "CASE kind3 WHEN 'Q' THEN CASE WHEN k % 5 <> 0 AND value + (k % 4 - 1) >= value THEN value + (k % 4 - 1) / 2e0 END ELSE value END"


@query("src09_stream_frames", "WITH " + _T + f""", f AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'status' WHEN k % 13 = 0 THEN 'bad' ELSE 'event' END AS kind, CASE k % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'Q' ELSE 'AM' END AS kind3 FROM t)
SELECT event_id, kind, CASE WHEN kind = 'event' THEN kind3 END AS event_type, CASE WHEN kind = 'event' THEN 'U' || user_id END AS symbol, CASE WHEN kind = 'event' THEN round({_PRICE}, 6) END AS price,
  CASE WHEN kind <> 'event' THEN '' ELSE concat_ws(',', CASE WHEN kind3 = 'AM' AND k % 7 = 0 THEN 'partial_aggregate' END, CASE WHEN kind3 = 'Q' AND k % 5 <> 0 AND k % 4 = 0 THEN 'crossed_market' END, CASE WHEN kind3 = 'Q' AND k % 5 = 0 THEN 'incomplete_nbbo' END) END AS flags FROM f""")  # fmt: skip
def stream_frames(spark: SparkSession, d: str) -> DataFrame:
    p = S.parsed_frames(raw_frames(spark, d))
    event = F.col("kind") == "event"
    return p.select("event_id", "kind", *[F.when(event, F.col(c)).alias(c) for c in ("event_type", "symbol")], F.when(event, F.round("price", 6)).alias("price"), F.when(event, F.col("flags")).otherwise("").alias("flags"))


@query("src08_nested_snapshot", "WITH " + _T + """, s AS (SELECT event_id, k, value AS v, CASE WHEN k % 4 <> 0 THEN value END AS trade, CASE WHEN k % 5 <> 0 THEN value END AS bid, CASE WHEN k % 5 <> 0 THEN value + (k % 3 - 1) END AS ask, k % 30 AS age FROM t),
m AS (SELECT *, CASE WHEN bid > 0 AND ask >= bid THEN (bid + ask) / 2 END AS mid FROM s),
c AS (SELECT *, CASE WHEN trade > 0 AND age <= 15 THEN 'last_trade' WHEN mid > 0 AND (bid IS NULL OR age <= 15) THEN 'nbbo_midpoint' END AS fresh, CASE WHEN trade > 0 THEN 'last_trade' WHEN mid > 0 THEN 'nbbo_midpoint' WHEN v > 0 THEN 'day_close' END AS stale FROM m)
SELECT event_id, coalesce(fresh, stale) AS price_source, round(CASE coalesce(fresh, stale) WHEN 'last_trade' THEN trade WHEN 'nbbo_midpoint' THEN mid WHEN 'day_close' THEN v END, 6) AS price,
  concat_ws(',', CASE WHEN k % 4 = 0 AND k % 5 = 0 THEN 'missing_event_timestamp' END, CASE WHEN ask < bid THEN 'crossed_market' END, CASE WHEN bid IS NULL OR ask IS NULL THEN 'incomplete_nbbo' END, CASE WHEN fresh IS NULL AND stale IS NOT NULL THEN 'stale_price_fallback' END) AS flags FROM c""")  # fmt: skip
def nested_snapshot(spark: SparkSession, d: str) -> DataFrame:
    b = _base(spark, d)
    at = (F.col("us") - F.col("k") % 30 * 1000000) * 1000
    trade = F.when(F.col("k") % 4 != 0, F.struct(F.col("value").alias("p"), at.alias("t")))
    quote = F.when(F.col("k") % 5 != 0, F.create_map(F.lit("p"), F.col("value"), F.lit("P"), F.col("value") + (F.col("k") % 3 - 1), F.lit("t"), at.cast("double")))
    text = F.to_json(F.struct(F.struct(quote.alias("lastQuote"), trade.alias("lastTrade"), F.struct(F.col("value").alias("c")).alias("day")).alias("ticker")))
    q = S.flat_quotes(b.select("event_id", text.alias("text"), (F.col("us") / 1e6).alias("received")), "text", limit=15.5)
    return q.select("event_id", "price_source", F.round("price", 6).alias("price"), "flags")


@query("str12_late_dropped", M.with_views("ticks", more="l AS (SELECT *, max(sequence) OVER (PARTITION BY symbol, type ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ticks)") + "SELECT symbol, type, count(*) AS kept FROM l WHERE b IS NULL OR sequence > b GROUP BY 1, 2")
def late_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Ticks through the streaming state, late and repeated ones dropped, counted."""
    folder = _folder(spark)
    t = M.ticks(spark, d).select("symbol", "type", "event_ts", "event_id", "sequence")
    kept = S.on_time(S.classify_stream(S.replay(spark, t, folder), folder))
    return kept.groupBy("symbol", "type").agg(F.count(F.lit(1)).alias("kept"))


@query("str05_gap_requests", M.with_views("ticks", more="l AS (SELECT *, lag(sequence) OVER (PARTITION BY symbol, type ORDER BY event_ts, event_id) AS b FROM ticks), g AS (SELECT * FROM l WHERE sequence > b + 1)") + "SELECT symbol, min(event_ts) AS first_gap, count(*) AS gaps FROM g GROUP BY symbol, floor(epoch(event_ts) / 86400)")
def gap_requests(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("sequence").over(Window.partitionBy("symbol", "type").orderBy("event_ts", "event_id"))
    return S.queued_gaps(M.ticks(spark, d).withColumn("b", before).where("sequence > b + 1"), "1 day")


#: Two of three lines are ticks of one symbol; their sequences go up and down over time.
_HOT = """t AS (SELECT CASE WHEN l_orderkey % 3 <> 2 THEN 'HOT' ELSE 'S' || l_suppkey END AS symbol, 'T' AS type, CAST(l_shipdate AS DATE) AS day, l_orderkey * 8 + l_linenumber AS sequence,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice, l_quantity) AS r FROM lineitem),
k AS (SELECT symbol, type, day, sequence * 64 + r AS event_id, sequence FROM t),
l AS (SELECT *, max(sequence) OVER (PARTITION BY symbol, type ORDER BY day, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k)"""


@query("str01_hot_symbol", "WITH " + _HOT + " SELECT symbol, event_id, CAST(sequence AS BIGINT) AS sequence, CASE WHEN b IS NULL THEN 'first' WHEN sequence = b THEN 'duplicate' WHEN sequence < b THEN 'late' WHEN sequence > b + 1 THEN 'gap' ELSE 'ok' END AS status FROM l")
def hot_symbol(spark: SparkSession, d: str) -> DataFrame:
    """A symbol with two thirds of all ticks, many more in a trigger than an Arrow batch holds."""
    li = M.table(spark, d, "lineitem")
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_extendedprice", "l_quantity"))
    sequence = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    symbol = F.when(F.col("l_orderkey") % 3 != 2, "HOT").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    ticks = li.select(symbol.alias("symbol"), F.lit("T").alias("type"), F.to_date("l_shipdate").cast("timestamp").alias("event_ts"), sequence.alias("sequence"), (sequence * 64 + copy).alias("event_id"))
    folder = _folder(spark)
    return S.classify_stream(S.replay(spark, ticks, folder, triggers=3), folder).drop("type")


@query("str01_without_sequence", "WITH RECURSIVE " + M.SQL["ticks"] + """,
n AS (SELECT symbol, type, event_id, CAST(floor(epoch(event_ts) / 86400) AS BIGINT) AS day, CASE WHEN k % 3 <> 0 THEN sequence END AS sequence, floor(price / 40) AS price,
  row_number() OVER (PARTITION BY symbol, type ORDER BY CAST(floor(epoch(event_ts) / 86400) AS BIGINT), event_id) AS i FROM ticks),
s AS (SELECT *, 'first' AS status, day AS last_day, event_id AS last_id, sequence AS last_sequence, price AS last_price FROM n WHERE i = 1
  UNION ALL SELECT o.*, CASE WHEN o.status IN ('duplicate', 'late') THEN s.last_day ELSE o.day END, CASE WHEN o.status IN ('duplicate', 'late') THEN s.last_id ELSE o.event_id END,
    CASE WHEN o.status IN ('duplicate', 'late') THEN s.last_sequence ELSE o.sequence END, CASE WHEN o.status IN ('duplicate', 'late') THEN s.last_price ELSE o.price END
  FROM s JOIN LATERAL (SELECT n.*, CASE WHEN n.sequence IS NOT NULL AND s.last_sequence IS NOT NULL THEN
      CASE WHEN n.sequence = s.last_sequence THEN 'duplicate' WHEN n.sequence < s.last_sequence THEN 'late' WHEN n.sequence > s.last_sequence + 1 THEN 'gap' ELSE 'ok' END
    WHEN n.day < s.last_day THEN 'late' WHEN n.day = s.last_day AND n.price = s.last_price THEN 'duplicate' ELSE 'ok' END AS status
    FROM n WHERE n.symbol = s.symbol AND n.type = s.type AND n.i = s.i + 1) o ON true)
SELECT symbol, type, event_id, CAST(sequence AS BIGINT) AS sequence, status FROM s""")
def without_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Every third tick comes without a sequence, times by the day: there the rule of times and prices decides."""
    t = M.ticks(spark, d)
    t = t.select("symbol", "type", F.date_trunc("day", F.col("event_ts").cast("timestamp")).alias("event_ts"), "event_id", F.when(F.col("k") % 3 != 0, F.col("sequence")).alias("sequence"), F.floor(F.col("price") / 40).cast("double").alias("price"))
    folder = _folder(spark)
    return S.classify_stream(S.replay(spark, t, folder, triggers=2), folder)


@query("str05_recovery_queue", "WITH RECURSIVE " + M.SQL["ticks"] + """, l AS (SELECT *, max(sequence) OVER (PARTITION BY symbol, type ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ticks),
g AS (SELECT symbol, event_id, CAST(epoch_us(event_ts) AS BIGINT) AS us, row_number() OVER (PARTITION BY symbol ORDER BY event_ts, event_id) AS i FROM l WHERE sequence > b + 1),
s AS (SELECT *, true AS queued, us AS last FROM g WHERE i = 1 UNION ALL SELECT g.*, g.us - s.last >= 172800000000, CASE WHEN g.us - s.last >= 172800000000 THEN g.us ELSE s.last END FROM s JOIN g ON g.symbol = s.symbol AND g.i = s.i + 1)
SELECT symbol, event_id, queued FROM s""")
def recovery_queue(spark: SparkSession, d: str) -> DataFrame:
    """Gaps that ask for a symbol to be read again, one request in two days of a symbol."""
    t = M.ticks(spark, d)
    gaps = S.classify_sequenced(t).where("status = 'gap'").select("symbol", "type", "event_id").join(t.select("type", "symbol", "event_id", F.col("event_ts").cast("timestamp").alias("event_ts")), ["symbol", "type", "event_id"])
    folder = _folder(spark)
    return run_folded(S.recovery_requests(172800.0), S.replay(spark, gaps.select("symbol", "event_ts", "event_id"), folder, triggers=2), folder).drop("event_ts")


@query("str02_latest_ttl", M.with_views("ticks", more="x AS (SELECT symbol, type, arg_max(event_id, row(event_ts, event_id)) AS event_id, max(event_ts) AS newest FROM ticks GROUP BY 1, 2)") + "SELECT symbol, type, event_id FROM x WHERE epoch_us(newest) + 86400000000 > (SELECT max(epoch_us(event_ts)) FROM ticks)")
def latest_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Newest ticks that live on for a day, after a stream in four triggers."""
    at = F.unix_micros(F.col("event_ts").cast("timestamp")) / 1e6
    t = M.ticks(spark, d).select("symbol", "type", "event_id", "price", at.alias("at"), (at + 86400).alias("expires"))
    folder = _folder(spark)
    latest = S.latest_table(folder)
    run_upserts(S.replay(spark, t, folder, triggers=4, by="at"), latest, "at")
    return latest.read(spark).select("symbol", "type", "event_id")


@query("str06_demand_ttl", M.with_views("ticks", more="d AS (SELECT 'P' || (CAST(substring(symbol, 2) AS BIGINT) % 40) AS source, symbol, event_id, epoch_us(event_ts) AS us FROM ticks), m AS (SELECT source, arg_max(symbol, row(us, event_id)) AS symbol, max(us) AS us FROM d GROUP BY 1)") + "SELECT source, symbol FROM m WHERE us + 21600000000 > (SELECT max(us) FROM m)")
def demand_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Symbols asked for by each source's last registration, for six hours."""
    at = F.unix_micros(F.col("event_ts").cast("timestamp")) / 1e6
    source = F.concat(F.lit("P"), (F.substring("symbol", 2, 20).cast("long") % 40).cast("string"))
    t = M.ticks(spark, d).select(source.alias("source"), F.array("symbol").alias("symbols"), "event_id", at.alias("at"), (at + 21600).alias("expires"))
    folder = _folder(spark)
    demand = S.demand_table(folder)
    run_upserts(S.replay(spark, t, folder, triggers=3, by="at"), demand, "at")
    return demand.read(spark).select("source", F.explode("symbols").alias("symbol"))


_ALERTS = M.SQL["ticks"] + """,
q AS (SELECT symbol, event_id, type, price, epoch_us(event_ts) / 1e6 AS at, 50e0 AS threshold, CAST(k * 7 % 60 AS DOUBLE) AS spread, CASE WHEN hour(event_ts) < 4 THEN 'closed' WHEN hour(event_ts) < 9 THEN 'pre' WHEN hour(event_ts) < 16 THEN 'regular' WHEN hour(event_ts) < 20 THEN 'after' ELSE 'closed' END AS session,
  CAST(substring(symbol, 2) AS BIGINT) % 2 = 0 AS allowed, CAST(k % 2 AS VARCHAR) AS advice, k % 9 = 0 AS concentrated, k % 23 = 0 AS invalid, row_number() OVER (PARTITION BY symbol ORDER BY event_ts, event_id) AS i FROM ticks),
f AS (SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS reason, false AS fired, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS VARCHAR) AS pending, CAST(NULL AS DOUBLE) AS since, CAST(NULL AS VARCHAR) AS rule0, CAST(NULL AS VARCHAR) AS advice0, CAST(NULL AS DOUBLE) AS at0 FROM (SELECT DISTINCT symbol FROM q)
  UNION ALL SELECT o.symbol, o.i, o.event_id, o.reason, o.reason = coalesce(o.rule, ''), CASE WHEN o.reason = 'after_hours_disabled' THEN f.p ELSE o.price END, CASE WHEN o.reason = 'after_hours_disabled' THEN f.s ELSE o.spread END,
    CASE WHEN o.reason = 'after_hours_disabled' THEN f.pending WHEN o.reason = coalesce(o.rule, '') THEN NULL ELSE o.rule END, CASE WHEN o.reason = 'after_hours_disabled' THEN f.since WHEN o.rule IS NULL OR o.reason = o.rule THEN NULL WHEN f.pending IS DISTINCT FROM o.rule THEN o.at ELSE f.since END,
    CASE WHEN o.reason = coalesce(o.rule, '') THEN o.rule ELSE f.rule0 END, CASE WHEN o.reason = coalesce(o.rule, '') THEN o.advice ELSE f.advice0 END, CASE WHEN o.reason = coalesce(o.rule, '') THEN o.at ELSE f.at0 END
  FROM f JOIN LATERAL (SELECT r.*, CASE WHEN r.session <> 'regular' AND NOT r.allowed THEN 'after_hours_disabled' WHEN r.rule IS NULL THEN 'no_controlled_boundary' WHEN f.pending IS DISTINCT FROM r.rule OR r.at - f.since < 15 THEN 'debouncing'
      WHEN r.at - f.at0 < 86400 THEN 'cooldown' WHEN f.rule0 = r.rule AND f.advice0 = r.advice THEN 'duplicate' ELSE r.rule END AS reason
    FROM (SELECT q.*, CASE WHEN invalid THEN 'snapshot_invalidated' WHEN type = 'AM' THEN 'minute_bar_closed' WHEN concentrated THEN 'suitability_boundary_crossed'
        WHEN price >= threshold * 1.005e0 AND (f.p < threshold * 0.995e0 OR f.pending = 'price_threshold_crossed') THEN 'price_threshold_crossed' WHEN abs(spread - f.s) >= 25 THEN 'liquidity_changed' END AS rule
      FROM q WHERE q.symbol = f.symbol AND q.i = f.i + 1) r) o ON true)"""


@query("str08_alerts", "WITH RECURSIVE " + _ALERTS + " SELECT symbol, event_id, fired, reason FROM f WHERE i > 0")
def alerts(spark: SparkSession, d: str) -> DataFrame:
    """The alert machine over a stream of all ticks; each user watches their own symbol, one alert a day."""
    t = M.ticks(spark, d)
    hour = F.hour(F.col("event_ts").cast("timestamp"))
    user = F.substring("symbol", 2, 20).cast("long")
    ticks = t.select(
        user.alias("user_id"), "symbol", "event_id", "type", "price", (F.unix_micros(F.col("event_ts").cast("timestamp")) / 1e6).alias("at"), F.lit(50.0).alias("threshold"), (F.col("k") * 7 % 60).cast("double").alias("spread_bps"),
        F.when(hour < 4, "closed").when(hour < 9, "pre").when(hour < 16, "regular").when(hour < 20, "after").otherwise("closed").alias("session"), (user % 2 == 0).alias("after_hours_allowed"),
        (F.col("k") % 2).cast("string").alias("recommendation_state"), (F.col("k") % 9 == 0).alias("concentration_crossed"), F.when(F.col("k") % 23 == 0, "refresh").alias("invalidation_reason"),
    )
    folder = _folder(spark)
    return S.alert_stream(S.replay(spark, ticks, folder, triggers=3, by="at"), folder, cooldown=86400.0).drop("user_id")
