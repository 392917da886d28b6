"""Queries of decision tables, threshold search, scoring with given weights, and tick streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import advice as A
from ..functions import decisions as D
from ..functions import windows as W
from ..operators import evaluation as E
from ..sources import market as M
from ..sources.files import work_folder
from ..streaming import ordering as S
from .evaluation_queries import _SCORED, scored
from .registry import query
from .window_queries import _W, _f, _with_returns


def _folder(spark: SparkSession) -> str:
    return work_folder(spark)


_SIG = M.with_views("bars", more=f"""r AS (SELECT *, close_px / lag(close_px) OVER w - 1 AS ret, close_px - lag(close_px) OVER w AS delta FROM bars {_W}),
g AS (SELECT symbol, bar_date, close_px, CASE WHEN count(close_px) {_f(50)} = 50 THEN avg(close_px) {_f(50)} END AS sma50, volume / nullif(CASE WHEN count(volume) {_f(20)} = 20 THEN avg(volume) {_f(20)} END, 0) AS rv,
  CASE WHEN count(delta) {_f(14)} = 14 THEN CASE WHEN avg(greatest(-delta, 0e0)) {_f(14)} = 0 THEN 100e0 ELSE 100 - 100 / (1 + avg(greatest(delta, 0e0)) {_f(14)} / avg(greatest(-delta, 0e0)) {_f(14)}) END END AS rsi,
  close_px / lag(close_px, 5) OVER w - 1 AS momentum FROM r {_W}),
s AS (SELECT *, least(12e0, CASE WHEN momentum > 0 THEN 3e0 ELSE 0e0 END + CASE WHEN rsi > 55 THEN 1.5e0 ELSE 0e0 END + CASE WHEN close_px > sma50 THEN 2e0 ELSE 0e0 END + CASE WHEN rv > 1 THEN 1e0 ELSE 0e0 END + CASE WHEN rv < 0.5e0 THEN -1e0 ELSE 0e0 END) AS score FROM g)""")  # fmt: skip


def signals(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    g = _with_returns(spark, d).withColumns({
        "sma50": W.moving_average("close_px", 50, w), "rv": W.safe_ratio(F.col("volume"), W.moving_average("volume", 20, w)),
        "rsi": W.rsi("delta", 14, w), "momentum": W.lagged_return("close_px", 5, w),
    })
    return g.withColumn("score", A.technical_score(F.col("momentum"), F.col("rsi"), F.col("close_px"), F.col("sma50"), F.col("rv")))


@query("dec01_technical_score", _SIG + "SELECT symbol, bar_date, round(score, 2) AS score, CASE WHEN score >= 9 THEN 'STRONG BUY' WHEN score >= 6 THEN 'BUY' WHEN score >= 3 THEN 'HOLD' ELSE 'HOLD OFF FOR NOW' END AS verdict FROM s")
def technical_score(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("symbol", "bar_date", F.round("score", 2).alias("score"), A.verdict(F.col("score")).alias("verdict"))


@query("dec03_softened_buys", M.with_views("bars", "decisions", "sectors", more="q AS (SELECT symbol, arg_max(close_px, bar_date) AS price FROM bars GROUP BY symbol), n AS (SELECT symbol, count(*) AS n, sum(count(*)) OVER () AS t FROM decisions GROUP BY symbol), x AS (SELECT d.seq, d.action, q.price, n.n / n.t::DOUBLE AS pw, d.probability_up AS p FROM decisions d LEFT JOIN q USING (symbol) LEFT JOIN n USING (symbol)), r AS (SELECT *, concat_ws(',', CASE WHEN price < 105 THEN 'low_price' END, CASE WHEN pw > 0.2e0 THEN 'position_limit' END, CASE WHEN p < 0.4e0 THEN 'low_confidence' END) AS rules FROM x)")
    + "SELECT seq, CASE WHEN action IN ('STRONG BUY', 'BUY') AND rules <> '' THEN 'HOLD' ELSE action END AS final_action, rules FROM r")
def softened_buys(spark: SparkSession, d: str) -> DataFrame:
    price = M.bars(spark, d).groupBy("symbol").agg(F.max_by("close_px", "bar_date").alias("price"))
    dec = M.decisions(spark, d)
    n = dec.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    total = dec.agg(F.count(F.lit(1)).alias("t"))
    weight = n.crossJoin(F.broadcast(total)).select("symbol", (F.col("n") / F.col("t")).alias("pw"))  # one row
    x = dec.join(price, "symbol", "left").join(weight, "symbol", "left")
    action, rules = A.softened(F.col("action"), F.col("price"), F.col("pw"), F.lit(0.0), F.col("probability_up"))
    return x.select("seq", action.alias("final_action"), rules.alias("rules"))


@query("dec06_threshold_action", M.with_views("bars", "decisions", more="q AS (SELECT symbol, arg_max(close_px, bar_date) / arg_min(close_px, bar_date) - 1 AS gain FROM bars GROUP BY symbol)")
    + "SELECT seq, CASE WHEN probability_up <= 0.35e0 OR gain <= -0.15e0 THEN 'SELL' WHEN probability_up >= 0.6e0 THEN 'BUY' ELSE 'HOLD' END AS threshold_action FROM decisions LEFT JOIN q USING (symbol)")
def threshold_actions(spark: SparkSession, d: str) -> DataFrame:
    gain = M.bars(spark, d).groupBy("symbol").agg((F.max_by("close_px", "bar_date") / F.min_by("close_px", "bar_date") - 1).alias("gain"))
    x = M.decisions(spark, d).join(gain, "symbol", "left")
    return x.select("seq", A.threshold_action(F.col("probability_up"), F.col("gain")).alias("threshold_action"))


@query("dec16_position_values", M.with_views("bars", "positions", more="q AS (SELECT symbol, arg_max(close_px, bar_date) AS price FROM bars GROUP BY symbol)")
    + "SELECT position_id, round(shares * coalesce(price, buy_price), 4) AS value, round(shares * (coalesce(price, buy_price) - buy_price), 4) AS pnl, round(coalesce(price, buy_price) / buy_price - 1, 6) AS pnl_share FROM positions LEFT JOIN q USING (symbol)")
def position_values(spark: SparkSession, d: str) -> DataFrame:
    price = M.bars(spark, d).groupBy("symbol").agg(F.max_by("close_px", "bar_date").alias("price"))
    p = M.positions(spark, d).join(price, "symbol", "left").withColumn("price", F.coalesce("price", "buy_price"))
    return p.select("position_id", F.round(F.col("shares") * F.col("price"), 4).alias("value"), F.round(F.col("shares") * (F.col("price") - F.col("buy_price")), 4).alias("pnl"), F.round(F.col("price") / F.col("buy_price") - 1, 6).alias("pnl_share"))


@query("top06_momentum_screen", _SIG + ", t AS (SELECT symbol, bar_date, score, momentum, row_number() OVER (PARTITION BY bar_date ORDER BY score DESC, momentum DESC, symbol) AS k FROM s WHERE score >= 6 AND momentum IS NOT NULL) SELECT symbol, bar_date, round(score, 2) AS score, CAST(k AS INTEGER) AS rank FROM t WHERE k <= 20")
def momentum_screen(spark: SparkSession, d: str) -> DataFrame:
    t = E.top_k(signals(spark, d).where("score >= 6 and momentum is not null"), ["bar_date"], [F.desc("score"), F.desc("momentum"), F.col("symbol")], 20)
    return t.select("symbol", "bar_date", F.round("score", 2).alias("score"), "rank")


_GRID = "g AS (SELECT unnest(range(8)) * 0.05e0 + 0.4e0 AS threshold)"


@query("evl01_threshold_grid", _SCORED + f", {_GRID} SELECT round(threshold, 2) AS threshold, count(*) FILTER (probability_up >= threshold) AS selected, round(avg(r5) FILTER (probability_up >= threshold), 6) AS mean_r, round(avg(CASE WHEN (probability_up >= threshold) = (up = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM s, g GROUP BY threshold")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    out = []
    for k in range(8):
        t = k * 0.05 + 0.4
        hit = F.col("probability_up") >= t
        out.append(F.struct(F.round(F.lit(t), 2).alias("threshold"), F.count(F.when(hit, 1)).alias("selected"), F.round(F.avg(F.when(hit, F.col("ret_5"))), 6).alias("mean_r"), F.round(F.avg((hit == (F.col("up") == 1)).cast("double")), 6).alias("accuracy")))
    return s.agg(F.array(*out).alias("g")).select(F.explode("g").alias("g")).select("g.*")


@query("evl04_date_bootstrap", _SCORED + """, c AS (SELECT event_date, avg(r5) AS m, row_number() OVER (ORDER BY event_date) - 1 AS i, count(*) OVER () AS n FROM s GROUP BY event_date),
k AS (SELECT r, (7919 * r + 104729 * j + 13) % n AS pick FROM (SELECT unnest(range(50)) AS r), (SELECT i AS j, n FROM c)), boots AS (SELECT r, avg(m) AS mean FROM k JOIN c ON c.i = k.pick GROUP BY r)
SELECT CAST(r AS INTEGER) AS resample, round(mean, 6) AS mean FROM boots""")  # fmt: skip
def date_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Fifty resamples of days by integer hashes; the table of days is small, so its ranks need no partitions."""
    c = scored(spark, d).groupBy("event_date").agg(F.avg("ret_5").alias("m"))
    c = c.withColumns({"i": (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("event_date")) - 1).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    picks = c.select("n", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("r"))
    picks = picks.select("r", F.pmod(F.lit(7919) * F.col("r") + F.lit(104729) * F.col("j") + 13, F.col("n")).alias("i"))
    return picks.join(c.select("i", "m"), "i").groupBy(F.col("r").alias("resample")).agg(F.round(F.avg("m"), 6).alias("mean"))


@query("evl12_log_loss", _SCORED + ", p AS (SELECT greatest(1e-6, least(1 - 1e-6, probability_up)) AS p, up, decision_source FROM s) SELECT decision_source, count(*) AS n, round(-avg(up * ln(p) + (1 - up) * ln(1 - p)), 6) AS log_loss FROM p GROUP BY decision_source")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("probability_up")))
    y = F.col("up")
    return scored(spark, d).groupBy("decision_source").agg(F.count(F.lit(1)).alias("n"), F.round(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), 6).alias("log_loss"))


@query("ml02_linear_score", _SIG + "SELECT symbol, bar_date, round(1 / (1 + exp(-greatest(-35e0, least(35e0, 0.1e0 + 8 * momentum - 0.02e0 * (rsi - 50) + 0.3e0 * (rv - 1))))), 6) AS p FROM s WHERE momentum IS NOT NULL AND rsi IS NOT NULL AND rv IS NOT NULL")
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    """Batch scoring with given weights."""
    z = 0.1 + 8 * F.col("momentum") - 0.02 * (F.col("rsi") - 50) + 0.3 * (F.col("rv") - 1)
    return signals(spark, d).where("momentum is not null and rsi is not null and rv is not null").select("symbol", "bar_date", F.round(D.clipped_sigmoid(z), 6).alias("p"))


@query("ml07_calibrated", M.with_views("decisions", more="p AS (SELECT seq, greatest(1e-6, least(1 - 1e-6, probability_up)) AS p FROM decisions WHERE probability_up IS NOT NULL)") + "SELECT seq, round(1 / (1 + exp(-(0.8e0 * ln(p / (1 - p)) + 0.1e0))), 6) AS calibrated FROM p")
def calibrated(spark: SparkSession, d: str) -> DataFrame:
    z = 0.8 * D.clipped_logit(F.col("probability_up")) + 0.1
    return M.decisions(spark, d).where("probability_up is not null").select("seq", F.round(D.clipped_sigmoid(z), 6).alias("calibrated"))


_TICK_STATUS = M.with_views("ticks", more="l AS (SELECT *, lag(sequence) OVER (PARTITION BY symbol, type ORDER BY event_ts, event_id) AS b FROM ticks)") + "SELECT symbol, type, event_id, sequence, CASE WHEN b IS NULL THEN 'first' WHEN sequence = b THEN 'duplicate' WHEN sequence > b + 1 THEN 'gap' ELSE 'ok' END AS status FROM l"


@query("str01_ordered_stream", _TICK_STATUS)
def ordered_stream(spark: SparkSession, d: str) -> DataFrame:
    """Ordering state kept over a stream of all ticks."""
    folder = _folder(spark)
    ticks = M.ticks(spark, d).select("symbol", "type", F.col("event_ts").cast("timestamp").alias("event_ts"), "event_id", "sequence")
    return S.classify_stream(S.replay(spark, ticks, folder, triggers=3), folder)


@query("str01_ordered_batch", _TICK_STATUS)
def ordered_batch(spark: SparkSession, d: str) -> DataFrame:
    return S.classify_batch(M.ticks(spark, d))


@query("str02_latest_values", M.with_views("ticks") + "SELECT symbol, type, arg_max(event_id, row(event_ts, event_id)) AS event_id, arg_max(sequence, row(event_ts, event_id)) AS sequence, round(arg_max(price, row(event_ts, event_id)), 6) AS price FROM ticks GROUP BY 1, 2")
def latest_values(spark: SparkSession, d: str) -> DataFrame:
    t = M.ticks(spark, d)
    key = F.struct("event_ts", "event_id")
    return t.groupBy("symbol", "type").agg(F.max_by("event_id", key).alias("event_id"), F.max_by("sequence", key).alias("sequence"), F.round(F.max_by("price", key), 6).alias("price"))


@query("str11_stream_health", M.with_views("ticks", more="l AS (SELECT *, lag(sequence) OVER (PARTITION BY symbol, type ORDER BY event_ts, event_id) AS b FROM ticks)") + "SELECT type, count(*) AS n, count(*) FILTER (sequence > b + 1) AS gaps, count(*) FILTER (sequence = b) AS duplicates FROM l GROUP BY type")
def stream_health(spark: SparkSession, d: str) -> DataFrame:
    s = S.classify_sequenced(M.ticks(spark, d))
    return s.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "gap", 1)).alias("gaps"), F.count(F.when(F.col("status") == "duplicate", 1)).alias("duplicates"))
