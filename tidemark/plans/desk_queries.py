"""Queries of advice for positions, ledgers, alerts, ranked lists, set operations, further aggregates and temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import advice as A
from ..functions import decisions as D
from ..functions import windows as W
from ..operators import evaluation as E
from ..operators import lineage as N
from ..sources import market as M
from .decision_queries import _SIG, signals
from .evaluation_queries import _O, _SCORED, _SPLIT, judged, scored
from .model_queries import _FEATURES, features
from .registry import query

_LAST = "q AS (SELECT symbol, arg_max(close_px, bar_date) AS price, arg_max(close_px, bar_date) / arg_min(close_px, bar_date) - 1 AS change FROM bars GROUP BY symbol)"


def last_prices(spark: SparkSession, d: str) -> DataFrame:
    return M.bars(spark, d).groupBy("symbol").agg(F.max_by("close_px", "bar_date").alias("price"), (F.max_by("close_px", "bar_date") / F.min_by("close_px", "bar_date") - 1).alias("change"))


#: Technical and news inputs of a position, derived from its number alike in both engines; some are missing.
_INPUTS = {
    "rsi": "CASE WHEN position_id % 5 <> 0 THEN 20e0 + position_id % 60 END",
    "macd": "CASE WHEN position_id % 7 <> 0 THEN (position_id % 9 - 4) / 10e0 END",
    "sentiment": "CASE WHEN position_id % 3 <> 0 THEN (position_id % 10) / 10e0 END",
    "trend": "CASE WHEN position_id % 2 = 0 THEN 'bearish' ELSE 'bullish' END",
    "base": "CASE position_id % 4 WHEN 0 THEN 'SELL' WHEN 1 THEN 'BUY' WHEN 2 THEN 'HOLD' ELSE 'WAIT' END",
}
_ADVICE = M.with_views("bars", "positions", more=_LAST + ", p AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _INPUTS.items()) + """, CASE WHEN position_id % 11 <> 0 THEN price END AS now FROM positions LEFT JOIN q USING (symbol)),
r AS (SELECT *, coalesce(rsi, 50e0) AS rs, coalesce(macd, 0e0) AS mc, coalesce(sentiment, 0.5e0) AS se, (now - buy_price) / buy_price * 100 AS pnl FROM p),
f AS (SELECT *, rs >= 70 OR mc < 0 OR se <= 0.35e0 AS risky FROM r),
v AS (SELECT position_id, round(pnl, 4) AS pnl_percent, CASE WHEN now IS NULL THEN 'HOLD' WHEN now <= buy_price * 0.95e0 OR (rs <= 35 AND mc > 0 AND se >= 0.55e0) THEN 'BUY' WHEN pnl >= 8 AND (risky OR base = 'SELL') THEN 'SELL'
  WHEN pnl < 0 THEN CASE WHEN se <= 0.25e0 AND trend = 'bearish' AND rs >= 45 THEN 'SELL' ELSE 'HOLD' END WHEN pnl BETWEEN -5 AND 15 AND NOT risky THEN 'HOLD' WHEN base NOT IN ('BUY', 'HOLD', 'SELL') THEN 'HOLD' ELSE base END AS advice,
  concat_ws(',', CASE WHEN rs >= 70 THEN 'overbought' END, CASE WHEN mc < 0 THEN 'momentum_down' END, CASE WHEN se <= 0.35e0 THEN 'negative_news' END) AS risk_flags, 5 + CASE WHEN se > 0.6e0 THEN 1.5e0 WHEN se < 0.4e0 THEN -1e0 ELSE 0e0 END AS confidence FROM f)""")  # fmt: skip


def advised(spark: SparkSession, d: str) -> DataFrame:
    p = M.positions(spark, d).join(last_prices(spark, d), "symbol", "left").select("*", *[F.expr(e).alias(n) for n, e in _INPUTS.items()]).withColumn("now", F.expr("CASE WHEN position_id % 11 <> 0 THEN price END"))
    advice, pnl, flags, confidence = A.position_advice(F.col("now"), F.col("buy_price"), F.col("rsi"), F.col("macd"), F.col("sentiment"), F.col("trend"), F.col("base"))
    return p.select("position_id", "user_id", "symbol", F.round(pnl, 4).alias("pnl_percent"), advice.alias("advice"), F.concat_ws(",", flags).alias("risk_flags"), confidence.alias("confidence"))


@query("dec02_position_advice", _ADVICE + "SELECT * FROM v")
def position_advice(spark: SparkSession, d: str) -> DataFrame:
    return advised(spark, d).drop("user_id", "symbol")


@query("dec07_rule_decision", _ADVICE + "SELECT position_id, CASE WHEN rsi <= 35 AND sentiment >= 0.7e0 THEN 'STRONG BUY' WHEN base = 'BUY' OR (rsi < 55 AND sentiment >= 0.6e0 AND (macd IS NULL OR macd >= 0)) THEN 'BUY' ELSE 'HOLD OFF FOR NOW' END AS call FROM f")
def rule_decision(spark: SparkSession, d: str) -> DataFrame:
    p = M.positions(spark, d).select("*", *[F.expr(e).alias(n) for n, e in _INPUTS.items()])
    return p.select("position_id", A.rule_call(F.col("base"), F.col("rsi"), F.col("macd"), F.col("sentiment"), F.col("sentiment") >= 0.6).alias("call"))


@query("dec08_fallback_action", _ADVICE + """SELECT position_id, CASE WHEN rsi IS NULL AND macd IS NULL THEN 'HOLD' WHEN rsi >= 72 AND (macd IS NULL OR macd < 0) THEN 'HOLD' WHEN rsi <= 35 AND (macd IS NULL OR macd >= 0) THEN 'BUY'
  WHEN rsi < 58 AND macd >= 0 AND (change IS NULL OR change > -0.03e0) THEN 'BUY' ELSE 'HOLD' END AS action FROM f""")  # fmt: skip
def fallback_action(spark: SparkSession, d: str) -> DataFrame:
    p = M.positions(spark, d).join(last_prices(spark, d), "symbol", "left").select("*", *[F.expr(e).alias(n) for n, e in _INPUTS.items()])
    return p.select("position_id", A.recent_action(F.col("rsi"), F.col("macd"), F.col("change") * 100).alias("action"))


@query("dec11_quote_signal", M.with_views("bars", more=_LAST) + "SELECT symbol, CASE WHEN change >= 0.05e0 THEN 'BUY' WHEN change <= -0.05e0 THEN 'SELL' ELSE 'HOLD' END AS action, round(greatest(0e0, least(10e0, 5 + change * 50)), 2) AS score FROM q")
def quote_signal(spark: SparkSession, d: str) -> DataFrame:
    action, score = A.quote_signal(F.col("change") * 100)
    return last_prices(spark, d).select("symbol", action.alias("action"), score.alias("score"))


_TRADES = """t AS (SELECT o_custkey % 100 AS user_id, 'S' || (o_orderkey % 5) AS symbol, row_number() OVER (PARTITION BY o_custkey % 100, o_orderkey % 5 ORDER BY o_orderdate, o_orderkey) AS n, o_orderkey AS trade_id,
  CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * (1 + o_orderkey % 7) AS shares, 90e0 + (o_orderkey * 31) % 200 / 10e0 AS price FROM orders)"""


def trades(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "symbol").orderBy("o_orderdate", "o_orderkey")
    o = M.table(spark, d, "orders").select("o_orderdate", "o_orderkey", F.pmod("o_custkey", F.lit(100)).alias("user_id"), F.concat(F.lit("S"), (F.col("o_orderkey") % 5).cast("string")).alias("symbol"), F.col("o_orderkey").alias("trade_id"),
        (F.when(F.expr("o_orderkey % 3 = 0"), -1).otherwise(1) * (1 + F.col("o_orderkey") % 7)).alias("shares"), (90.0 + (F.col("o_orderkey") * 31) % 200 / 10.0).alias("price"))
    return o.withColumn("n", F.row_number().over(w))


@query("dec12_realised_profit", "WITH RECURSIVE " + _TRADES + """, l(user_id, symbol, n, held, cost, realised) AS (SELECT user_id, symbol, n, greatest(shares, 0)::DOUBLE, CASE WHEN shares > 0 THEN price ELSE 0e0 END, 0e0 FROM t WHERE n = 1
  UNION ALL SELECT t.user_id, t.symbol, t.n, greatest(0e0, held + shares), CASE WHEN shares > 0 THEN (held * cost + shares * price) / (held + shares) ELSE cost END, realised + CASE WHEN shares < 0 THEN least(held, -shares) * (price - cost) ELSE 0e0 END FROM l JOIN t ON t.user_id = l.user_id AND t.symbol = l.symbol AND t.n = l.n + 1)
SELECT user_id, symbol, arg_max(held, n) AS held, round(arg_max(cost, n), 4) AS average_cost, round(max_by(realised, n), 4) AS realised FROM l GROUP BY 1, 2""")  # fmt: skip
def realised_profit(spark: SparkSession, d: str) -> DataFrame:
    """Shares, average cost and realised amount after all trades of a user in a symbol: a fold over these in order."""
    rows = trades(spark, d).groupBy("user_id", "symbol").agg(F.sort_array(F.collect_list(F.struct("n", "shares", "price"))).alias("ts"))
    return rows.withColumn("l", A.ledger(F.col("ts"))).select("user_id", "symbol", F.col("l.held").alias("held"), F.round("l.cost", 4).alias("average_cost"), F.round("l.realised", 4).alias("realised"))


@query("dec13_position_totals", M.with_views("bars", "positions", more=_LAST) + "SELECT user_id, round(sum(coalesce(price, buy_price) * coalesce(shares, 1e0)), 4) AS value, count(*) FILTER (price IS NULL) AS unpriced FROM positions LEFT JOIN q USING (symbol) GROUP BY user_id")
def position_totals(spark: SparkSession, d: str) -> DataFrame:
    p = M.positions(spark, d).join(last_prices(spark, d), "symbol", "left")
    return p.groupBy("user_id").agg(F.round(F.sum(F.coalesce("price", "buy_price") * F.coalesce("shares", F.lit(1.0))), 4).alias("value"), F.count(F.when(F.col("price").isNull(), 1)).alias("unpriced"))


_BEFORE = "b AS (SELECT user_id, arg_max(value, row(ts, event_id)) AS score, arg_max(event_type, row(ts, event_id)) AS advice FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), a AS (SELECT user_id, arg_max(value, row(ts, event_id)) AS score, arg_max(event_type, row(ts, event_id)) AS advice FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)"


def states(spark: SparkSession, d: str) -> DataFrame:
    """Last score and advice of each user before a day and from it on."""
    e, key, cut = M.table(spark, d, "events"), F.struct("ts", "event_id"), F.lit("2024-01-15").cast("timestamp")
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, key))
    before, after = F.col("ts").cast("timestamp") < cut, F.col("ts").cast("timestamp") >= cut
    return e.groupBy("user_id").agg(last("value", before).alias("score_0"), last("event_type", before).alias("advice_0"), last("value", after).alias("score_1"), last("event_type", after).alias("advice_1"))


@query("str09_alert_diff", "WITH " + _BEFORE + " SELECT a.user_id, a.advice IS DISTINCT FROM b.advice AS advice_changed, coalesce(b.score <= 8 AND a.score > 8, false) AS crossed, b.user_id IS NULL AS is_new FROM a LEFT JOIN b USING (user_id)")
def alert_diff(spark: SparkSession, d: str) -> DataFrame:
    s = states(spark, d).where("advice_1 is not null")
    return s.select("user_id", (~F.col("advice_1").eqNullSafe(F.col("advice_0"))).alias("advice_changed"), F.coalesce((F.col("score_0") <= 8) & (F.col("score_1") > 8), F.lit(False)).alias("crossed"), F.col("advice_0").isNull().alias("is_new"))


@query("str10_score_crossing", "WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id FROM l WHERE before <= 8 AND value > 8")
def score_crossing(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return M.table(spark, d, "events").withColumn("before", before).where("before <= 8 and value > 8").select("user_id", "event_id")


@query("str06_demand_registry", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, count(*) AS demand FROM events, m WHERE ts > now - INTERVAL 2 DAY GROUP BY 1")
def demand_registry(spark: SparkSession, d: str) -> DataFrame:
    e = M.table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).where("ts > now - interval 2 days").groupBy("user_id").agg(F.count(F.lit(1)).alias("demand"))  # one row


@query("top11_subscriptions", "WITH m AS (SELECT max(ts) AS now FROM events), g AS (SELECT user_id, count(*) AS demand FROM events, m WHERE ts > now - INTERVAL 2 DAY GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY demand DESC, user_id) AS k FROM g) SELECT user_id, demand, CASE WHEN k <= 5 THEN 'quote' WHEN k <= 12 THEN 'trade' ELSE 'overflow' END AS plan FROM k")
def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """Ranks are found among the users of most demand only; all others are overflow."""
    g = demand_registry(spark, d)
    top = g.orderBy(F.desc("demand"), "user_id").limit(12)
    top = top.select("user_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("demand"), "user_id")).alias("k"))
    return g.join(F.broadcast(top), "user_id", "left").select("user_id", "demand", F.when(F.col("k") <= 5, "quote").when(F.col("k") <= 12, "trade").otherwise("overflow").alias("plan"))  # twelve rows


@query("str03_stale_symbols", M.with_views("ticks", more="l AS (SELECT *, lag(sequence) OVER (PARTITION BY symbol, type ORDER BY event_ts, event_id) AS b FROM ticks), g AS (SELECT DISTINCT symbol FROM l WHERE sequence > b + 1)") + "SELECT DISTINCT symbol, type, symbol IN (SELECT symbol FROM g) AS stale FROM ticks")
def stale_symbols(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ordering import classify_sequenced

    c = classify_sequenced(M.ticks(spark, d)).groupBy("symbol", "type").agg(F.max((F.col("status") == "gap").cast("int")).alias("gap"))
    return c.select("symbol", "type", (F.max("gap").over(Window.partitionBy("symbol")) == 1).alias("stale"))


@query("str04_coalesced_updates", M.with_views("ticks") + "SELECT symbol, type, CAST(floor(epoch(event_ts)) AS BIGINT) // 3600 AS hour, arg_max(event_id, row(event_ts, event_id)) AS event_id, count(*) - 1 AS coalesced FROM ticks GROUP BY 1, 2, 3")
def coalesced_updates(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor(F.unix_seconds(F.col("event_ts").cast("timestamp")) / 3600).alias("hour")
    return M.ticks(spark, d).groupBy("symbol", "type", hour).agg(F.max_by("event_id", F.struct("event_ts", "event_id")).alias("event_id"), (F.count(F.lit(1)) - 1).alias("coalesced"))


@query("str07_price_choice", M.with_views("ticks", more="v AS (SELECT symbol, type, max(event_ts) AS seen, arg_max(price, row(event_ts, event_id)) AS price FROM ticks WHERE price IS NOT NULL GROUP BY 1, 2), n AS (SELECT symbol, arg_max(type, row(seen, type)) AS type, arg_max(price, row(seen, type)) AS price, max(seen) AS seen FROM v GROUP BY 1), m AS (SELECT max(event_ts) AS now FROM ticks)")
    + "SELECT symbol, type, round(price, 6) AS price, now - seen > INTERVAL 6 HOUR AS stale FROM n, m")
def price_choice(spark: SparkSession, d: str) -> DataFrame:
    t = M.ticks(spark, d)
    newest = t.where("price is not null").groupBy("symbol", "type").agg(F.max("event_ts").alias("at"), F.max_by("price", F.struct("event_ts", "event_id")).alias("price"))
    n = newest.groupBy("symbol").agg(F.max(F.struct("at", "type", "price")).alias("v"))
    return n.crossJoin(F.broadcast(t.agg(F.max("event_ts").alias("now")))).select("symbol", "v.type", F.round("v.price", 6).alias("price"), F.expr("now - v.at > interval 6 hours").alias("stale"))  # one row


@query("jon15_user_alerts", _ADVICE.rstrip() + ", " + _BEFORE + " SELECT v.position_id, v.advice, p.user_id, (b.advice = 'click') AS was_click FROM v JOIN positions p USING (position_id) LEFT JOIN b ON b.user_id = p.user_id WHERE v.advice <> 'HOLD'")
def user_alerts(spark: SparkSession, d: str) -> DataFrame:
    s = states(spark, d).where("advice_0 is not null").select("user_id", (F.col("advice_0") == "click").alias("was_click"))
    return advised(spark, d).where("advice <> 'HOLD'").join(s, "user_id", "left").select("position_id", "advice", "user_id", "was_click")


@query("jon16_price_difference", M.with_views("ticks", more="v AS (SELECT symbol, arg_max(price, row(event_ts, event_id)) FILTER (type = 'T') AS stream, arg_max(price, row(event_ts, event_id)) FILTER (type = 'Q') AS snapshot FROM ticks GROUP BY 1)") + "SELECT symbol, round((stream / snapshot - 1) * 10000, 2) AS bps, abs(stream / snapshot - 1) * 10000 > 50 AS beyond FROM v WHERE stream IS NOT NULL AND snapshot > 0")
def price_difference(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct("event_ts", "event_id")
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("price")), F.when(F.col("type") == kind, key))
    v = M.ticks(spark, d).groupBy("symbol").agg(last("T").alias("stream"), last("Q").alias("snapshot")).where("stream is not null and snapshot > 0")
    bps = (F.col("stream") / F.col("snapshot") - 1) * 10000
    return v.select("symbol", F.round(bps, 2).alias("bps"), (F.abs(bps) > 50).alias("beyond"))


@query("win25_session_breakout", M.with_views("ticks", more="g AS (SELECT symbol, CAST(event_ts AS DATE) AS day, arg_min(price, row(event_ts, event_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, row(event_ts, event_id)) AS c, count(*) AS n FROM ticks GROUP BY 1, 2), w AS (SELECT *, max(h) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS high_6 FROM g)")
    + "SELECT symbol, day, round(c / nullif(o, 0) - 1, 6) AS change, round(c / nullif(h, 0) - 1, 6) AS pullback, round(c / nullif(l, 0) - 1, 6) AS bounce, coalesce(c >= high_6 * 0.98e0, false) AS near_high, coalesce(c > o AND c >= h * 0.9e0 AND c >= high_6 * 0.98e0, false) AS qualifies FROM w")
def session_breakout(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct("event_ts", "event_id")
    g = M.ticks(spark, d).groupBy("symbol", F.to_date("event_ts").alias("day")).agg(F.min_by("price", key).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", key).alias("c"))
    w = g.withColumn("high_6", F.max("h").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(-6, -1)))
    ratio = lambda b: F.round(W.safe_ratio(F.col("c"), F.col(b)) - 1, 6)
    near = F.col("c") >= F.col("high_6") * 0.98
    return w.select("symbol", "day", ratio("o").alias("change"), ratio("h").alias("pullback"), ratio("l").alias("bounce"), F.coalesce(near, F.lit(False)).alias("near_high"), F.coalesce((F.col("c") > F.col("o")) & (F.col("c") >= F.col("h") * 0.9) & near, F.lit(False)).alias("qualifies"))


@query("win17_series_features", _FEATURES + " SELECT symbol, bar_date, round(ret_1, 5) AS ret_1, round(ret_5, 5) AS ret_5, round(rsi_14, 5) AS rsi, round(macd_hist, 5) AS macd_hist, round(volume_ratio, 5) AS volume_ratio FROM x WHERE ret_5 IS NOT NULL AND rsi_14 IS NOT NULL AND macd_hist IS NOT NULL AND volume_ratio IS NOT NULL")
def series_features(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d, ["ret_1", "ret_5", "rsi_14", "macd_hist", "volume_ratio"]).na.drop(subset=["ret_5", "rsi_14", "macd_hist", "volume_ratio"])
    return f.select("symbol", "bar_date", *[W.rounded(c, 5).alias(n) for n, c in (("ret_1", "ret_1"), ("ret_5", "ret_5"), ("rsi", "rsi_14"), ("macd_hist", "macd_hist"), ("volume_ratio", "volume_ratio"))])


@query("agg03_outcome_rows", _O.replace("lead(close_px, 10) OVER w AS e10", "lead(close_px, 10) OVER w AS e10, lead(close_px, 20) OVER w AS e20").replace("e1, e5, e10 FROM", "e1, e5, e10, e20 FROM")
    + "SELECT seq, entry_date, round(r1, 6) AS ret_1, round(r5, 6) AS ret_5, round(e10 / entry - 1, 6) AS ret_10, round(e20 / entry - 1, 6) AS ret_20, round(r5 * side, 6) + 0 AS paper_5, outcome FROM y")
def outcome_rows(spark: SparkSession, d: str) -> DataFrame:
    from .join_queries import outcomes

    o = outcomes(spark, d, [1, 5, 10, 20])
    return o.select("seq", "entry_date", *[F.round(f"ret_{n}", 6).alias(f"ret_{n}") for n in (1, 5, 10, 20)], (F.round(F.col("ret_5") * D.exposure(F.col("action")), 6) + 0).alias("paper_5"), D.outcome(F.col("action"), F.col("ret_5")).alias("outcome"))


_POS, _NEG = "action IN ('STRONG BUY', 'BUY')", "action IN ('SELL', 'HOLD OFF FOR NOW')"


@query("agg05_validation_summary", _O + f"""SELECT count(*) AS n, round(count(*) FILTER ({_POS} AND r5 > 0) / count(*) FILTER ({_POS})::DOUBLE, 6) AS buy_precision, round(count(*) FILTER ({_POS} AND r5 > 0) / count(*) FILTER (r5 > 0)::DOUBLE, 6) AS buy_recall,
  round(count(*) FILTER ({_NEG} AND r5 <= 0) / count(*) FILTER ({_NEG})::DOUBLE, 6) AS sell_precision, round(count(*) FILTER ({_NEG} AND r5 <= 0) / count(*) FILTER (r5 <= 0)::DOUBLE, 6) AS sell_recall,
  round(avg(CASE WHEN {_NEG} THEN -r5 ELSE r5 END), 6) AS mean_directional, round(avg(CASE WHEN {_NEG} THEN -r5 ELSE r5 END - 0.0005e0), 6) AS mean_net, round(min(CASE WHEN {_NEG} THEN -r5 ELSE r5 END), 6) AS worst,
  round(avg((probability_up - CASE WHEN r5 > 0 THEN 1 ELSE 0 END) ** 2), 6) AS brier FROM y WHERE r5 IS NOT NULL AND ({_POS} OR {_NEG})""")  # fmt: skip
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("ret_5")
    y = judged(spark, d).where(f"ret_5 is not null and ({_POS} or {_NEG})").withColumn("directional", F.when(F.expr(_NEG), -r).otherwise(r))
    share = lambda a, b: F.round(F.count(F.when(F.expr(a), 1)) / F.count(F.when(F.expr(b), 1)), 6)
    return y.agg(
        F.count(F.lit(1)).alias("n"), share(f"{_POS} and ret_5 > 0", _POS).alias("buy_precision"), share(f"{_POS} and ret_5 > 0", "ret_5 > 0").alias("buy_recall"), share(f"{_NEG} and ret_5 <= 0", _NEG).alias("sell_precision"), share(f"{_NEG} and ret_5 <= 0", "ret_5 <= 0").alias("sell_recall"),
        F.round(F.avg("directional"), 6).alias("mean_directional"), F.round(F.avg(F.col("directional") - 0.0005), 6).alias("mean_net"), F.round(F.min("directional"), 6).alias("worst"), F.round(E.brier(F.col("probability_up"), (r > 0).cast("double")), 6).alias("brier"),
    )


@query("agg15_extreme_rows", M.with_views("bars", more="r AS (SELECT symbol, bar_date, close_px / lag(close_px) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)), k AS (SELECT ret, row_number() OVER (ORDER BY ret) AS k, count(*) OVER () AS n FROM r WHERE ret IS NOT NULL), q AS (SELECT min(ret) FILTER (k >= floor((n - 1) * 0.01e0) + 1) AS lo, min(ret) FILTER (k >= floor((n - 1) * 0.99e0) + 1) AS hi FROM k)")
    + "SELECT symbol, bar_date, round(ret, 6) AS ret, CASE WHEN ret <= (SELECT lo FROM q) THEN 'low' ELSE 'high' END AS tail FROM r WHERE ret <= (SELECT lo FROM q) OR ret >= (SELECT hi FROM q)")
def extreme_rows(spark: SparkSession, d: str) -> DataFrame:
    r = M.bars(spark, d).select("symbol", "bar_date", W.lagged_return("close_px", 1, W.by_symbol()).alias("ret"))
    q = E.nearest_rank(r, [], "ret", {"lo": 0.01, "hi": 0.99})
    return r.crossJoin(F.broadcast(q)).where("ret <= lo or ret >= hi").select("symbol", "bar_date", F.round("ret", 6).alias("ret"), F.when(F.col("ret") <= F.col("lo"), "low").otherwise("high").alias("tail"))  # one row


@query("agg20_holdout_identity", M.with_views("decisions", more=N.fingerprint_sql("decisions", "event_date", "symbol || ':' || endpoint", "fp")) + "SELECT event_date, identities, n - identities AS duplicates, fingerprint FROM fp JOIN (SELECT event_date, count(DISTINCT (symbol, endpoint)) AS identities FROM decisions GROUP BY 1) USING (event_date)")
def holdout_identity(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint for each day over its rows, whatever their layout."""
    rows = M.decisions(spark, d)
    known = rows.groupBy("event_date").agg(F.count_distinct("symbol", "endpoint").alias("identities"))
    f = N.fingerprints(rows, ["event_date"], F.concat_ws(":", "symbol", "endpoint")).join(known, "event_date")
    return f.select("event_date", "identities", (F.col("n") - F.col("identities")).alias("duplicates"), "fingerprint")


_LINEAGE = ("symbol || ':' || seq || ':' || action")


@query("evl18_lineage", M.with_views("decisions", more="a AS (SELECT * FROM decisions WHERE seq % 2 = 0), b AS (SELECT * FROM decisions WHERE model_version = 'v1-5d'), c AS (SELECT * FROM decisions WHERE seq % 2 = 0 AND seq % 97 <> 0), " + ", ".join(N.fingerprint_sql(x, "event_date", _LINEAGE, f"f{x}") for x in "abc"))
    + """SELECT event_date, coalesce(fa.n, 0) AS rows, concat_ws(',', CASE WHEN fa.n IS NULL THEN 'candidate_missing' END, CASE WHEN fb.n IS NULL THEN 'comparator_missing' WHEN fa.n IS NULL OR fa.fingerprint <> fb.fingerprint THEN 'comparator_differs' END,
  CASE WHEN fc.n IS NULL THEN 'holdout_missing' WHEN fa.n IS NULL OR fa.fingerprint <> fc.fingerprint THEN 'holdout_differs' END) AS issues, coalesce(fa.fingerprint = fb.fingerprint AND fa.fingerprint = fc.fingerprint, false) AS comparable FROM fa FULL JOIN fb USING (event_date) FULL JOIN fc USING (event_date)""")  # fmt: skip
def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Days on which candidate, comparator and holdout were built from the same decisions."""
    rows = M.decisions(spark, d)
    key = F.concat_ws(":", "symbol", F.col("seq").cast("string"), "action")
    of = lambda condition: N.fingerprints(rows.where(condition), ["event_date"], key)
    return N.compared(of("seq % 2 = 0"), {"comparator": of("model_version = 'v1-5d'"), "holdout": of("seq % 2 = 0 AND seq % 97 <> 0")}, "event_date")


@query("agg25_universe_benchmark", _SCORED.rstrip() + ", c AS (SELECT event_date, avg(r5) AS m FROM s GROUP BY 1) SELECT (SELECT round(avg(r5), 6) FROM s) AS universe_mean, round(avg(m), 6) AS cohort_mean, round(median(m), 6) AS cohort_median FROM c")
def universe_benchmark(spark: SparkSession, d: str) -> DataFrame:
    c = scored(spark, d).groupBy("event_date").agg(F.avg("ret_5").alias("m"), F.sum("ret_5").alias("s"), F.count("ret_5").alias("n"))
    return c.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("universe_mean"), F.round(F.avg("m"), 6).alias("cohort_mean"), F.round(F.median("m"), 6).alias("cohort_median"))


_NUM = ("ret_1", "ret_5", "rsi_14", "volume_ratio", "volatility_20")


@query("agg26_half_drift", _FEATURES + ", h AS (SELECT *, bar_date >= DATE '1998-06-01' AS late FROM x), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, late, {c} AS v FROM h" for c in _NUM) + ") SELECT feature, round(abs(avg(v) FILTER (late) - avg(v) FILTER (NOT late)) / nullif(stddev_pop(v) FILTER (NOT late), 0), 5) AS shift FROM u GROUP BY 1")
def half_drift(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("bar_date") >= F.lit("1998-06-01").cast("date")
    u = features(spark, d, _NUM).select(late.alias("late"), F.explode(F.create_map(*[x for c in _NUM for x in (F.lit(c), F.col(c))])).alias("feature", "v"))
    new, old = F.when(F.col("late"), F.col("v")), F.when(~F.col("late"), F.col("v"))
    return u.groupBy("feature").agg(F.round(F.abs(F.avg(new) - F.avg(old)) / F.nullif(F.stddev_pop(old), F.lit(0.0)), 5).alias("shift"))


@query("agg39_group_availability", _FEATURES + ", u AS (" + " UNION ALL ".join(f"SELECT '{g}' AS grp, {c} AS v FROM x" for g, c in (("returns", "ret_1"), ("returns", "ret_20"), ("momentum", "rsi_14"), ("momentum", "macd_hist"), ("market", "bench_ret_5"))) + ") SELECT grp, round(count(v) / count(*)::DOUBLE, 6) AS availability, count(v) / count(*)::DOUBLE >= 0.8e0 AS passed FROM u GROUP BY 1")
def group_availability(spark: SparkSession, d: str) -> DataFrame:
    pairs = (("returns", "ret_1"), ("returns", "ret_20"), ("momentum", "rsi_14"), ("momentum", "macd_hist"), ("market", "bench_ret_5"))
    u = features(spark, d, [c for _, c in pairs]).select(F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(c).alias("v")) for g, c in pairs])))
    share = F.count("v") / F.count(F.lit(1))
    return u.groupBy("grp").agg(F.round(share, 6).alias("availability"), (share >= 0.8).alias("passed"))


@query("agg28_threshold_support", _SCORED + "SELECT count(*) AS selected, count(DISTINCT event_date) AS dates, count(DISTINCT symbol) AS symbols, count(*) FILTER (r5 > 0.03e0) AS big_gains, round((SELECT max(n) FROM (SELECT count(*) AS n FROM s WHERE probability_up >= 0.6e0 GROUP BY symbol)) / count(*)::DOUBLE, 6) AS concentration FROM s WHERE probability_up >= 0.6e0")
def threshold_support(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("probability_up >= 0.6")
    by = s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ret_5") > 0.03, 1)).alias("g"))
    days = s.select("event_date").distinct().agg(F.count(F.lit(1)).alias("dates"))
    one = by.agg(F.sum("n").alias("selected"), F.count(F.lit(1)).alias("symbols"), F.sum("g").alias("big_gains"), F.max("n").alias("most"))
    return one.crossJoin(F.broadcast(days)).select("selected", "dates", "symbols", "big_gains", F.round(F.col("most") / F.col("selected"), 6).alias("concentration"))  # one row each


@query("agg32_dataset_checksum", M.with_views("decisions") + "SELECT count(*) AS n, CAST(sum(CAST('0x' || substring(md5(seq || ':' || symbol), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM decisions")
def dataset_checksum(spark: SparkSession, d: str) -> DataFrame:
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("seq").cast("string"), "symbol")), 1, 8), 16, 10).cast("bigint")
    return M.decisions(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("checksum"))


@query("agg36_policy_counters", _ADVICE + "SELECT flag, count(*) AS n, count(DISTINCT advice) AS advices FROM (SELECT unnest(string_split(risk_flags, ',')) AS flag, advice FROM v WHERE risk_flags <> '') GROUP BY 1")
def policy_counters(spark: SparkSession, d: str) -> DataFrame:
    f = advised(spark, d).where("risk_flags <> ''").select("advice", F.explode(F.split("risk_flags", ",")).alias("flag"))
    return f.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("advice").alias("advices"))


@query("agg37_call_log", "WITH k AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS calls, count(*) FILTER (k % 20 = 0) AS errors, count(*) FILTER (k % 3 = 0) AS hits, round(avg(value), 6) AS mean_latency, count(*) FILTER (k % 33 = 0) AS stale FROM k GROUP BY 1")
def call_log(spark: SparkSession, d: str) -> DataFrame:
    k = M.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
    n = lambda m: F.count(F.when(F.col("k") % m == 0, 1))
    return k.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), n(20).alias("errors"), n(3).alias("hits"), F.round(F.avg("value"), 6).alias("mean_latency"), n(33).alias("stale"))


@query("agg40_input_manifest", M.with_views("decisions") + "SELECT decision_source, count(*) AS n, count(DISTINCT symbol) AS symbols, min(event_date) AS first_day, max(event_date) AS last_day, count(probability_up) AS with_probability FROM decisions GROUP BY 1")
def input_manifest(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).groupBy("decision_source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"), F.count("probability_up").alias("with_probability"))


@query("top04_equal_weight", _SCORED + "SELECT event_date, round(sum(r5) * least(0.1e0, 1e0 / count(*)), 6) AS portfolio FROM s GROUP BY 1")
def equal_weight(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("event_date").agg(F.round(F.sum("ret_5") * F.least(F.lit(0.1), 1.0 / F.count(F.lit(1))), 6).alias("portfolio"))


@query("top08_investor_picks", M.with_views("positions", more="q AS (SELECT *, count(*) FILTER (buy_price <= 100) OVER (PARTITION BY user_id) AS good FROM positions), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY shares DESC, position_id) AS k FROM q WHERE good < 5 OR buy_price <= 100)") + "SELECT user_id, position_id, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 5")
def investor_picks(spark: SparkSession, d: str) -> DataFrame:
    good = F.count(F.when(F.col("buy_price") <= 100, 1)).over(Window.partitionBy("user_id"))
    pool = M.positions(spark, d).withColumn("good", good).where("good < 5 or buy_price <= 100")
    return E.top_k(pool, ["user_id"], [F.desc("shares"), F.col("position_id")], 5).select("user_id", "position_id", "rank")


@query("top10_candidate_ranks", _SCORED.rstrip() + ", v AS (SELECT model_version || '/' || endpoint AS model, avg(r5) AS a, -avg((probability_up - up) ** 2) AS b, -avg(CASE WHEN r5 < -0.03e0 THEN 1e0 ELSE 0e0 END) AS c, count(DISTINCT event_date) AS e, count(*) AS f FROM s GROUP BY 1) SELECT model, CAST(row_number() OVER (ORDER BY a > 0 DESC, round(a, 6) DESC, round(b, 6) DESC, round(c, 6) DESC, e DESC, model) AS INTEGER) AS rank FROM v")
def candidate_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Models by five measures; a table of models is small."""
    v = scored(spark, d).groupBy(F.concat_ws("/", "model_version", "endpoint").alias("model")).agg(F.avg("ret_5").alias("a"), (-E.brier(F.col("probability_up"), F.col("up"))).alias("b"), (-F.avg((F.col("ret_5") < -0.03).cast("double"))).alias("c"), F.count_distinct("event_date").alias("e"))
    order = [F.desc(F.col("a") > 0), F.desc(F.round("a", 6)), F.desc(F.round("b", 6)), F.desc(F.round("c", 6)), F.desc("e"), F.col("model")]
    return v.select("model", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))


@query("top12_hard_examples", _SCORED.rstrip() + ", m AS (SELECT seq, event_date, abs(r5) * abs(probability_up - up) AS severity FROM s WHERE (probability_up >= 0.5e0) <> (up = 1)), k AS (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY round(severity, 9) DESC, seq) AS k, (SELECT count(*) FROM s t WHERE t.event_date = m.event_date) AS n FROM m) SELECT seq, round(severity, 6) AS severity FROM k WHERE k <= greatest(1, floor(n * 0.2e0))")
def hard_examples(spark: SparkSession, d: str) -> DataFrame:
    """The worst mistakes of each day, at most a fifth of its rows."""
    s = scored(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("event_date")))
    m = s.where((F.col("probability_up") >= 0.5) != (F.col("up") == 1)).withColumn("severity", F.abs("ret_5") * F.abs(F.col("probability_up") - F.col("up")))
    k = m.withColumn("k", F.row_number().over(Window.partitionBy("event_date").orderBy(F.desc(F.round("severity", 9)), "seq")))
    return k.where("k <= greatest(1, floor(n * 0.2))").select("seq", F.round("severity", 6).alias("severity"))


@query("top13_watch_list", _SIG + ", l AS (SELECT symbol, arg_max(score, bar_date) AS score FROM s GROUP BY 1), w AS (SELECT 'S' || s_suppkey AS symbol, s_suppkey % 5 + 3.5e0 AS base FROM supplier WHERE s_suppkey % 2 = 0) SELECT w.symbol, round(coalesce(nullif(l.score, 0), w.base), 2) AS score FROM w LEFT JOIN l USING (symbol)")
def watch_list(spark: SparkSession, d: str) -> DataFrame:
    l = signals(spark, d).groupBy("symbol").agg(F.max_by("score", "bar_date").alias("score"))  # noqa: E741
    w = M.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), (F.col("s_suppkey") % 5 + 3.5).alias("base"))
    return w.join(l, "symbol", "left").select("symbol", F.round(F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), "base"), 2).alias("score"))


@query("top07_breakouts", _SIG + ", h AS (SELECT *, max(close_px) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS high_6 FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY bar_date ORDER BY score DESC, symbol) AS k FROM h WHERE close_px >= high_6 AND score >= 7.5e0) SELECT symbol, bar_date, score, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 20")
def breakouts(spark: SparkSession, d: str) -> DataFrame:
    h = signals(spark, d).withColumn("high_6", F.max("close_px").over(W.by_symbol().rowsBetween(-6, -1)))
    return E.top_k(h.where("close_px >= high_6 and score >= 7.5"), ["bar_date"], [F.desc("score"), F.col("symbol")], 20).select("symbol", "bar_date", "score", "rank")


@query("set02_merged_rows", M.with_views("decisions", more="u AS (SELECT * FROM decisions WHERE seq % 3 = 0 UNION ALL SELECT * FROM decisions WHERE seq % 2 = 0), g AS (SELECT event_date, symbol, endpoint, decision_source, action, model_version, max(ts) AS ts, max(seq) AS seq FROM u GROUP BY ALL)") + "SELECT * FROM g ORDER BY ts DESC, seq DESC LIMIT 200")
def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    x = M.decisions(spark, d)
    u = x.where("seq % 3 = 0").unionByName(x.where("seq % 2 = 0"))
    g = u.groupBy("event_date", "symbol", "endpoint", "decision_source", "action", "model_version").agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
    return g.orderBy(F.desc("ts"), F.desc("seq")).limit(200)


@query("set04_holding_changes", "WITH a AS (SELECT DISTINCT o_custkey % 100 AS user_id, 'S' || (o_orderkey % 50) AS symbol FROM orders WHERE o_orderdate < DATE '1996-01-01'), b AS (SELECT DISTINCT o_custkey % 100 AS user_id, 'S' || (o_orderkey % 50) AS symbol FROM orders WHERE o_orderdate >= DATE '1996-01-01') SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.symbol = b.symbol WHERE a.symbol IS NULL OR b.symbol IS NULL")
def holding_changes(spark: SparkSession, d: str) -> DataFrame:
    late = (F.to_date("o_orderdate") >= F.lit("1996-01-01").cast("date")).cast("int")
    held = M.table(spark, d, "orders").groupBy(F.pmod("o_custkey", F.lit(100)).alias("user_id"), F.concat(F.lit("S"), (F.col("o_orderkey") % 50).cast("string")).alias("symbol")).agg(F.min(late).alias("first"), F.max(late).alias("last"))
    return held.where("first = last").select("user_id", "symbol", F.when(F.col("first") == 1, "added").otherwise("removed").alias("change"))


@query("set06_fallback_union", M.with_views("news", more="p AS (SELECT symbol, lower(title) AS t, doc_id, CASE WHEN publisher IN ('src0', 'src1', 'src2') THEN 0 ELSE 1 END AS kind FROM news WHERE title IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY kind, doc_id) AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY kind, doc_id) AS k FROM f WHERE n = 1)") + "SELECT symbol, doc_id, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 3")
def fallback_union(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("publisher").isin("src0", "src1", "src2"), 0).otherwise(1)
    p = M.news(spark, d).where("title is not null").groupBy("symbol", F.lower("title").alias("t")).agg(F.min(F.struct(kind.alias("kind"), "doc_id")).alias("v")).select("symbol", "v.*")
    return E.top_k(p, ["symbol"], [F.col("kind"), F.col("doc_id")], 3).select("symbol", "doc_id", "rank")


@query("jon12_split_overlap", M.with_views("decisions", more="t AS (SELECT *, seq % 3 = 0 AS test FROM decisions), g AS (SELECT event_date, symbol, bool_or(test) AS a, bool_or(NOT test) AS b FROM t GROUP BY 1, 2), h AS (SELECT event_date, bool_or(a) AS a, bool_or(b) AS b FROM g GROUP BY 1)") + "SELECT (SELECT count(*) FROM h WHERE a AND b) AS dates, (SELECT count(*) FROM g WHERE a AND b) AS pairs")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = M.decisions(spark, d).withColumn("test", F.expr("seq % 3 = 0"))
    g = t.groupBy("event_date", "symbol").agg(F.max("test").alias("a"), F.max(~F.col("test")).alias("b"))
    h = g.groupBy("event_date").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.count(F.when(F.expr("a and b"), 1)).alias("pairs"))
    return h.agg(F.count(F.when(F.expr("a and b"), 1)).alias("dates"), F.sum("pairs").alias("pairs"))


@query("spt01_prefix_split", M.with_views("decisions", more="r AS (SELECT seq, row_number() OVER (ORDER BY ts, symbol, seq) AS k, count(*) OVER () AS n FROM decisions)") + "SELECT seq, k <= greatest(1, least(n - 1, floor(n * 0.8e0))) AS train FROM r")
def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by day first: counts of days give where each begins, so windows hold a day's rows only."""
    x = M.decisions(spark, d).withColumn("day", F.floor(F.col("ts") / 86400))
    days = x.groupBy("day").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    days = days.select("day", (F.sum("rows").over(w) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy(F.lit(0))).alias("n"))
    k = F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("ts", "symbol", "seq"))
    return x.join(F.broadcast(days), "day").select("seq", (k <= F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.8)))).alias("train"))  # one row a day


_PERIODS = M.with_views("decisions", more=_SPLIT.split("b AS (")[0].rstrip().rstrip(",") + """, c AS (SELECT max(days) AS n, CAST(least(greatest(floor(max(days) * 0.8e0), 21), max(days) - 7) AS BIGINT) AS dev FROM d),
e AS (SELECT n, dev, greatest(7, CAST(floor(dev * 0.15e0) AS BIGINT)) AS cal, greatest(7, CAST(floor(dev * 0.15e0) AS BIGINT)) AS thr FROM c),
p AS (SELECT event_date, day_no, CASE WHEN day_no > dev THEN 3 WHEN day_no > dev - thr THEN 2 WHEN day_no > dev - thr - cal THEN 1 ELSE 0 END AS period FROM d, e)""")


def periods(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with their period by whole days: fit, calibration, threshold and test, seven days each at least."""
    r = E.date_ranks(M.decisions(spark, d), "event_date")
    dev = F.least(F.greatest(F.floor(F.col("days") * 0.8), F.lit(21)), F.col("days") - 7)
    part = F.greatest(F.lit(7), F.floor(dev * 0.15))
    n = F.col("day_no")
    return r.withColumn("period", F.when(n > dev, 3).when(n > dev - part, 2).when(n > dev - part - part, 1).otherwise(0))


@query("spt04_periods", _PERIODS + "SELECT seq, CAST(period AS INTEGER) AS period FROM decisions JOIN p USING (event_date)")
def four_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods(spark, d).select("seq", "period")


@query("spt03_purged_periods", _PERIODS.rstrip() + ", q AS (SELECT period, min(event_date) AS start FROM p GROUP BY 1), z AS (SELECT p.event_date, p.period FROM p LEFT JOIN q a ON a.period = p.period LEFT JOIN q b ON b.period = p.period + 1 WHERE (p.period = 0 OR p.event_date >= a.start + 1) AND (b.start IS NULL OR p.event_date < b.start - 5)) SELECT seq, CAST(period AS INTEGER) AS period FROM decisions JOIN z USING (event_date)")
def purged_periods(spark: SparkSession, d: str) -> DataFrame:
    """At each boundary the last five days before it are purged and the first day after it is embargoed."""
    p = periods(spark, d)
    starts = p.groupBy("period").agg(F.min("event_date").alias("start"))
    own, after = starts, starts.select((F.col("period") - 1).alias("period"), F.col("start").alias("next_start"))
    x = p.join(F.broadcast(own), "period").join(F.broadcast(after), "period", "left")  # four rows
    return x.where((F.col("period") == 0) | (F.col("event_date") >= F.date_add("start", 1))).where(F.col("next_start").isNull() | (F.col("event_date") < F.date_sub("next_start", 5))).select("seq", "period")


@query("spt07_rolling_folds", M.with_views("decisions", more="c AS (SELECT count(*) AS n FROM decisions), z AS (SELECT n, greatest(1, n // 6) AS t FROM c), w AS (SELECT n, t, least(3, greatest(1, n // t - 2)) AS k FROM z), f AS (SELECT n, t, k, greatest(n - k * t, t * 2) AS first, unnest(range(k)) AS i FROM w)") + "SELECT i AS fold, CASE WHEN i < 2 THEN 0 ELSE greatest(0, first + i * t - t * 3) END AS train_start, first + i * t AS train_end, least(n, first + i * t + t) AS test_end FROM f WHERE n >= 6 AND first + i * t < least(n, first + i * t + t)")
def rolling_folds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    t = F.greatest(F.lit(1), F.floor(n / 6))
    c = M.decisions(spark, d).agg(F.count(F.lit(1)).alias("n")).where("n >= 6").withColumn("t", t)
    k = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / F.col("t")) - 2))
    f = c.withColumn("first", F.greatest(n - k * F.col("t"), F.col("t") * 2)).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)))
    end = F.col("first") + F.col("fold") * F.col("t")
    return f.select("fold", F.when(F.col("fold") < 2, 0).otherwise(F.greatest(F.lit(0), end - F.col("t") * 3)).alias("train_start"), end.alias("train_end"), F.least(n, end + F.col("t")).alias("test_end")).where("train_end < test_end")
