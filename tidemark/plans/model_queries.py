"""Queries of the shared features, corporate actions of rows, quality gates, model fitting and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import windows as W
from ..operators import asof as A
from ..operators import evaluation as E
from ..operators import modeling as L
from ..sources import market as M
from ..sources.files import stored
from .evaluation_queries import _SCORED, scored
from .join_queries import _FORWARD, outcomes
from .registry import query
from .window_queries import _BENCH_RET, _INDEXED, _W, _ema_sql, _f, benchmark_features

_FEATURES = _INDEXED.replace("WITH RECURSIVE ", "WITH RECURSIVE " + M.SQL["bench"] + ",\n", 1) + ",\n" + _BENCH_RET + ",\n" + _ema_sql("b", "close_px", 12, "e12") + ",\n" + _ema_sql("b", "close_px", 26, "e26") + """,
m AS (SELECT b.symbol, b.bar_date, b.i - 25 AS i, e12.v - e26.v AS macd FROM b JOIN e12 ON b.symbol = e12.symbol AND b.i = e12.i JOIN e26 ON b.symbol = e26.symbol AND b.i = e26.i WHERE b.i >= 26),
""" + _ema_sql("m", "macd", 9, "sig") + f""",
d1 AS (SELECT *, close_px - lag(close_px) OVER w AS delta, close_px / lag(close_px) OVER w - 1 AS r FROM b {_W}),
f AS (SELECT d1.symbol, d1.bar_date, d1.close_px, d1.r AS ret_1, close_px / lag(close_px, 5) OVER w - 1 AS ret_5, close_px / lag(close_px, 20) OVER w - 1 AS ret_20,
  CASE WHEN count(delta) {_f(14)} = 14 THEN CASE WHEN avg(greatest(-delta, 0e0)) {_f(14)} = 0 THEN 100e0 ELSE 100 - 100 / (1 + avg(greatest(delta, 0e0)) {_f(14)} / avg(greatest(-delta, 0e0)) {_f(14)}) END END AS rsi_14,
  CASE WHEN d1.i >= 34 THEN m.macd - sig.v END AS macd_hist, volume / nullif(CASE WHEN count(volume) {_f(20)} = 20 THEN avg(volume) {_f(20)} END, 0) AS volume_ratio,
  close_px / CASE WHEN count(close_px) {_f(20)} = 20 THEN avg(close_px) {_f(20)} END - 1 AS vs_sma_20, CASE WHEN count(r) {_f(20)} = 20 THEN stddev_pop(r) {_f(20)} END AS volatility_20
  FROM d1 LEFT JOIN m ON m.symbol = d1.symbol AND m.bar_date = d1.bar_date LEFT JOIN sig ON sig.symbol = d1.symbol AND sig.i = d1.i - 25 WINDOW w AS (PARTITION BY d1.symbol ORDER BY d1.bar_date)),
x AS (SELECT f.*, s.bench_ret5 AS bench_ret_5, f.ret_5 - s.bench_ret5 AS relative_5, CASE WHEN s.bench_ret5 IS NOT NULL AND s.bench_sma20 IS NOT NULL THEN CAST(s.bench_ret5 > 0 AND s.bench_close >= s.bench_sma20 AS DOUBLE) END AS risk_on FROM f LEFT JOIN s USING (bar_date))"""
for _n in (13, 19):  # the frames of f are over d1, whose columns its joins repeat
    _FEATURES = _FEATURES.replace(f"OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN {_n}", f"OVER (PARTITION BY d1.symbol ORDER BY d1.bar_date ROWS BETWEEN {_n}")


def features(spark: SparkSession, d: str, columns: Sequence[str] = L.FEATURES) -> DataFrame:
    return L.shared_features(M.bars(spark, d, together=True), benchmark_features(spark, d), columns)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Bars with all features and the sign of the return over the next five bars, written once: a fit reads them several times."""
    bars = A.exits(M.bars(spark, d, together=True), [5]).where("symbol is not null and bar_date is not null")
    f = L.shared_features(bars, benchmark_features(spark, d), also=["exit_5"]).withColumn("ret_next", F.col("exit_5") / F.col("close_px") - 1)
    return stored(f.where("ret_next is not null").na.drop(subset=L.FEATURES).withColumn("up", (F.col("ret_next") > 0).cast("double")), "labelled-bars")


@query("win15_shared_features", _FEATURES + " SELECT symbol, bar_date, " + ", ".join(f"round({c}, 5) AS {c}" for c in L.FEATURES) + " FROM x")
def shared_features(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("symbol", "bar_date", *[W.rounded(c, 5).alias(c) for c in L.FEATURES])


@query("win13_beta", M.with_views("bars", "bench", more=f"""r AS (SELECT *, close_px / lag(close_px) OVER w - 1 AS ret FROM bars {_W}), q AS (SELECT bar_date, close_px / lag(close_px) OVER (ORDER BY bar_date) - 1 AS ret FROM bench),
a AS (SELECT symbol, bar_date, list(ret) {_f(20)} AS own, count(ret) {_f(20)} AS n FROM r), c AS (SELECT bar_date, list(ret) OVER (ORDER BY bar_date ROWS 19 PRECEDING) AS market, count(ret) OVER (ORDER BY bar_date ROWS 19 PRECEDING) AS k FROM q),
j AS (SELECT symbol, bar_date, unnest(own) AS x, unnest(market) AS y FROM a JOIN c USING (bar_date) WHERE n = 20 AND k = 20)""")
    + "SELECT symbol, bar_date, round(covar_pop(x, y) / var_pop(y), 5) AS beta_20 FROM j GROUP BY 1, 2 HAVING var_pop(y) > 0")
def beta(spark: SparkSession, d: str) -> DataFrame:
    """A symbol's last twenty returns against the benchmark's last twenty as of that day, place by place."""
    w = W.by_symbol()
    own = M.bars(spark, d).withColumn("r", W.lagged_return("close_px", 1, w)).select("symbol", "bar_date", F.collect_list("r").over(W.trailing(w, 20)).alias("own"))
    s = Window.partitionBy("series").orderBy("bar_date")  # one row for each day
    market = benchmark_features(spark, d).withColumn("series", F.lit(1)).select("bar_date", F.collect_list("bench_ret").over(W.trailing(s, 20)).alias("market"))
    both = own.join(market, "bar_date").where((F.size("own") == 20) & (F.size("market") == 20))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    both = both.withColumns({"mx": total(F.col("own")) / 20, "my": total(F.col("market")) / 20})
    both = both.withColumns({"cov": total(F.zip_with("own", "market", lambda x, y: (x - F.col("mx")) * (y - F.col("my")))), "var": total(F.transform("market", lambda y: (y - F.col("my")) * (y - F.col("my"))))})
    return both.where("var > 0").select("symbol", "bar_date", F.round(F.col("cov") / F.col("var"), 5).alias("beta_20"))


_SPAN = M.with_views("bars", "decisions", "splits", more=_FORWARD.replace("lead(close_px, 10) OVER w AS e10", "lead(close_px, 10) OVER w AS e10, lead(bar_date, 5) OVER w AS d5").replace("e1, e5, e10 FROM", "e1, e5, e10, d5 FROM"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with the day and close of entry and of the fifth bar after it."""
    w = W.by_symbol()
    bars = M.bars(spark, d).withColumns({"exit_5": F.lead("close_px", 5).over(w), "exit_date": F.lead("bar_date", 5).over(w)})
    met = A.forward_asof(M.decisions(spark, d), bars, "symbol", "event_date", "bar_date", ["close_px", "exit_5", "exit_date"])
    return met.select("seq", "symbol", F.col("met._at").alias("entry_date"), F.col("met.close_px").alias("entry"), F.col("met.exit_5").alias("exit"), F.col("met.exit_date").alias("exit_date")).where("exit is not null")


@query("cor06_split_adjusted_return", _SPAN.rstrip() + """, k AS (SELECT o.seq, coalesce(product(s.split_from / s.split_to), 1e0) AS f FROM o LEFT JOIN splits s ON s.ticker = o.symbol AND s.execution_date > o.entry_date AND s.execution_date <= o.d5 WHERE e5 IS NOT NULL GROUP BY o.seq)
SELECT seq, round(e5 / (entry * f) - 1, 6) AS ret FROM o JOIN k USING (seq)""")  # fmt: skip
def split_adjusted_return(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    s = A.with_factor(A.with_factor(s, M.splits(spark, d), "symbol", "entry_date", "before"), M.splits(spark, d), "symbol", "exit_date", "after")
    return s.select("seq", F.round(W.safe_ratio(F.col("exit"), F.col("entry") * F.col("after") / F.col("before")) - 1, 6).alias("ret"))


_PROVENANCE = _SPAN.rstrip() + ", p AS (SELECT o.seq, s.id FROM o JOIN splits s ON s.ticker = o.symbol AND s.execution_date > o.entry_date AND s.execution_date <= o.d5 WHERE e5 IS NOT NULL)"


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """seq, id: splits inside the label window of a decision. Few splits belong to a symbol, so the join is on it alone."""
    s, x = spans(spark, d), M.splits(spark, d)
    return s.join(x, (s["symbol"] == x["ticker"]) & (x["execution_date"] > s["entry_date"]) & (x["execution_date"] <= s["exit_date"])).select("seq", "id")


@query("cor07_split_provenance", _PROVENANCE + " SELECT o.seq, coalesce(string_agg(p.id, ',' ORDER BY p.id), '') AS split_ids FROM o LEFT JOIN p USING (seq) WHERE e5 IS NOT NULL GROUP BY o.seq")
def split_provenance(spark: SparkSession, d: str) -> DataFrame:
    ids = provenance(spark, d).groupBy("seq").agg(F.concat_ws(",", F.sort_array(F.collect_list("id"))).alias("split_ids"))
    return spans(spark, d).select("seq").join(ids, "seq", "left").select("seq", F.coalesce("split_ids", F.lit("")).alias("split_ids"))


@query("jon13_split_audit", _PROVENANCE + " SELECT s.id, s.ticker, count(p.seq) AS affected FROM splits s LEFT JOIN p USING (id) GROUP BY 1, 2")
def split_audit(spark: SparkSession, d: str) -> DataFrame:
    hit = provenance(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("affected"))
    return M.splits(spark, d).select("id", "ticker").join(hit, "id", "left").select("id", "ticker", F.coalesce("affected", F.lit(0)).cast("long").alias("affected"))


_LINE = "'{\"execution_date\":\"' || execution_date || '\",\"id\":\"' || id || '\",\"ticker\":\"' || ticker || '\"}'"


@query("cor03_split_hash", M.with_views("splits") + f"SELECT ticker, sha256(string_agg({_LINE}, chr(10) ORDER BY {_LINE})) AS source_hash FROM splits GROUP BY ticker")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash for each ticker's events, in the order of their JSON: a ticker has few."""
    line = F.to_json(F.struct(F.col("execution_date"), F.col("id"), F.col("ticker")))
    return M.splits(spark, d).groupBy("ticker").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("source_hash"))


_GATE = _SPAN.rstrip() + """, t AS (SELECT o.seq, o.symbol, o.event_date, CASE WHEN o.seq % 10 = 3 THEN NULL ELSE e5 / entry - 1 END AS label, CASE WHEN o.seq % 12 = 5 THEN NULL ELSE entry END AS feature,
  CASE WHEN o.seq % 9 = 4 THEN o.event_date - 5 WHEN o.seq % 9 = 5 THEN o.event_date + 1 ELSE o.event_date - 1 END AS market_date, probability_up FROM o),
u AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE seq % 20 = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY seq, symbol, event_date, label, feature, market_date, probability_up) AS k FROM u),
g AS (SELECT *, CASE WHEN k > 1 THEN 'duplicates' WHEN label IS NULL THEN 'missing_label' WHEN feature IS NULL THEN 'missing_required_features' WHEN market_date > event_date OR event_date - market_date > 3 THEN 'stale_market_asof_date' END AS reason FROM v)"""


def gated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(training rows with some that repeat, the same without repeats and with the first rule that drops them)."""
    all_ = outcomes(spark, d, [5]).select("seq", "symbol", "event_date", F.when(F.expr("seq % 10 <> 3"), F.col("ret_5")).alias("label"), F.when(F.expr("seq % 12 <> 5"), F.col("entry")).alias("feature"),
        F.expr("CASE WHEN seq % 9 = 4 THEN date_sub(event_date, 5) WHEN seq % 9 = 5 THEN date_add(event_date, 1) ELSE date_sub(event_date, 1) END").alias("market_date"), "probability_up")
    rows = all_.unionByName(all_.where("seq % 20 = 1"))
    late = F.datediff("event_date", "market_date")
    reason = F.when(F.col("label").isNull(), "missing_label").when(F.col("feature").isNull(), "missing_required_features").when((late < 0) | (late > 3), "stale_market_asof_date")
    return rows, rows.dropDuplicates().withColumn("reason", reason)


@query("flt01_quality_gate", _GATE + " SELECT seq, symbol, round(label, 6) AS label, probability_up IS NOT NULL AS has_probability FROM g WHERE reason IS NULL")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d)[1].where("reason is null").select("seq", "symbol", F.round("label", 6).alias("label"), F.col("probability_up").isNotNull().alias("has_probability"))


@query("flt01_drop_counts", _GATE + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM g GROUP BY 1")
def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, kept = gated(spark, d)
    twice = rows.groupBy(*rows.columns).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("duplicates").alias("reason"), "n")
    return kept.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).unionByName(twice)


@query("set01_exact_duplicates", _GATE + " SELECT count(*) FILTER (k = 1) AS kept, count(*) FILTER (k > 1) AS duplicates FROM g")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = gated(spark, d)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("flt10_implausible_returns", M.with_views("bars", more=f"r AS (SELECT symbol, bar_date, unnest([1, 5, 20]) AS lag, unnest([close_px / lag(close_px, 1) OVER w - 1, close_px / lag(close_px, 5) OVER w - 1, close_px / lag(close_px, 20) OVER w - 1]) AS ret FROM bars {_W})")
    + "SELECT symbol, bar_date, lag, round(ret, 6) AS ret FROM r WHERE abs(ret) > CASE lag WHEN 1 THEN 0.04e0 WHEN 5 THEN 0.05e0 ELSE 0.06e0 END")
def implausible_returns(spark: SparkSession, d: str) -> DataFrame:
    """One row for each lag whose return is beyond its limit (limits that this table's returns reach)."""
    w = W.by_symbol()
    lags = F.array(*[F.struct(F.lit(n).alias("lag"), W.lagged_return("close_px", n, w).alias("ret"), F.lit(limit).alias("limit")) for n, limit in ((1, 0.04), (5, 0.05), (20, 0.06))])
    return M.bars(spark, d).select("symbol", "bar_date", lags.alias("x")).select("symbol", "bar_date", F.inline("x")).where("abs(ret) > limit").select("symbol", "bar_date", "lag", F.round("ret", 6).alias("ret"))


@query("jon05_benchmark_return", M.with_views("bench", "decisions", more="b AS (SELECT bar_date, close_px, lead(close_px, 5) OVER (ORDER BY bar_date) AS e5 FROM bench)")
    + "SELECT seq, round(e5 / close_px - 1, 6) AS bench_ret_5 FROM decisions d ASOF LEFT JOIN b ON d.event_date <= b.bar_date")
def benchmark_return(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark has one row a day: days between its bars are given the next bar, and the small table is joined by day."""
    b = M.bench(spark, d).withColumn("series", F.lit(1))
    s = Window.partitionBy("series").orderBy("bar_date")
    b = b.withColumns({"e5": F.lead("close_px", 5).over(s), "before": F.coalesce(F.lag("bar_date").over(s), F.date_sub("bar_date", 3660))})
    days = b.select(F.explode(F.sequence(F.date_add("before", 1), F.col("bar_date"))).alias("event_date"), (F.col("e5") / F.col("close_px") - 1).alias("r"))
    return M.decisions(spark, d).join(F.broadcast(days), "event_date", "left").select("seq", F.round("r", 6).alias("bench_ret_5"))


_ETF = {"AFRICA": "AFK", "AMERICA": "SPY", "ASIA": "AAXJ", "EUROPE": "VGK"}


@query("jon06_sector_benchmark", M.with_views("decisions", "sectors") + "SELECT seq, coalesce(CASE WHEN seq % 7 = 0 THEN 'XLK' END, CASE sector " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ETF.items()) + " END, 'SPY') AS benchmark FROM decisions LEFT JOIN sectors USING (symbol)")
def sector_benchmark(spark: SparkSession, d: str) -> DataFrame:
    given, of = F.when(F.expr("seq % 7 = 0"), "XLK"), F.create_map(*[F.lit(x) for kv in _ETF.items() for x in kv])
    return M.decisions(spark, d).join(M.sectors(spark, d), "symbol", "left").select("seq", F.coalesce(given, F.try_element_at(of, F.col("sector")), F.lit("SPY")).alias("benchmark"))


_MODELS = _SCORED.rstrip() + ", y AS (SELECT *, probability_up >= 0.5e0 AS a, (probability_up * 0.7e0 + 0.2e0 * (seq % 2)) >= 0.45e0 AS b, probability_up * 0.7e0 + 0.2e0 * (seq % 2) AS pb FROM s)"


def compared(spark: SparkSession, d: str) -> DataFrame:
    """Scored decisions with the calls of a production rule (a) and a candidate (b)."""
    pb = F.col("probability_up") * 0.7 + 0.2 * F.expr("seq % 2").cast("double")
    return scored(spark, d).withColumns({"a": F.col("probability_up") >= 0.5, "pb": pb, "b": pb >= 0.45})


@query("jon09_model_overlap", _MODELS + """ SELECT count(*) AS n, count(*) FILTER (a AND b) AS both_buy, round(avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END), 6) AS agreement, round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b)::DOUBLE, 6) AS jaccard,
  count(*) FILTER (b AND r5 < -0.03e0) AS big_loss_buys, count(*) FILTER (NOT b AND r5 > 0.03e0) AS missed_gains FROM y""")  # fmt: skip
def model_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return compared(spark, d).agg(F.count(F.lit(1)).alias("n"), n("a and b").alias("both_buy"), F.round(F.avg(F.expr("a = b").cast("double")), 6).alias("agreement"), F.round(n("a and b") / n("a or b"), 6).alias("jaccard"), n("b and ret_5 < -0.03").alias("big_loss_buys"), n("not b and ret_5 > 0.03").alias("missed_gains"))


@query("ml18_clone_check", _MODELS + " SELECT round(avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END), 6) AS agreement, round(avg(abs(probability_up - pb)), 6) AS mae, avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) >= 0.98e0 AND avg(abs(probability_up - pb)) <= 0.02e0 AS clone FROM y")
def clone_check(spark: SparkSession, d: str) -> DataFrame:
    agreement, mae = F.avg(F.expr("a = b").cast("double")), F.avg(F.abs(F.col("probability_up") - F.col("pb")))
    return compared(spark, d).agg(F.round(agreement, 6).alias("agreement"), F.round(mae, 6).alias("mae"), ((agreement >= 0.98) & (mae <= 0.02)).alias("clone"))


@query("ml17_mistakes", _MODELS + " SELECT seq, CASE WHEN NOT a AND r5 > 0.03e0 THEN 'missed_big_gain' ELSE 'big_loss_buy' END AS mistake, round(r5, 6) AS ret FROM y WHERE (NOT a AND r5 > 0.03e0) OR (a AND r5 < -0.03e0)")
def mistakes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.expr("not a and ret_5 > 0.03"), "missed_big_gain").when(F.expr("a and ret_5 < -0.03"), "big_loss_buy")
    return compared(spark, d).withColumn("mistake", kind).where("mistake is not null").select("seq", "mistake", F.round("ret_5", 6).alias("ret"))


@query("snk08_mistake_slices", _MODELS + " SELECT CASE WHEN NOT a AND r5 > 0.03e0 THEN 'missed_big_gain' ELSE 'big_loss_buy' END AS mistake, event_date, count(*) AS n FROM y WHERE (NOT a AND r5 > 0.03e0) OR (a AND r5 < -0.03e0) GROUP BY 1, 2")
def mistake_slices(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.expr("not a and ret_5 > 0.03"), "missed_big_gain").when(F.expr("a and ret_5 < -0.03"), "big_loss_buy")
    return compared(spark, d).withColumn("mistake", kind).where("mistake is not null").groupBy("mistake", "event_date").agg(F.count(F.lit(1)).alias("n"))


def _utility(side: str) -> str:
    return f"avg(CASE WHEN {side} THEN r5 END) - avg(CASE WHEN {side} AND r5 < 0 THEN -r5 WHEN {side} THEN 0e0 END) - avg(CASE WHEN {side} THEN CASE WHEN r5 < -0.03e0 THEN 1e0 ELSE 0e0 END END) + 0.1e0 * count(*) FILTER ({side} AND r5 > 0.03e0) / nullif(count(*) FILTER (r5 > 0.03e0), 0)"


def utility(side: F.Column, ret: F.Column) -> F.Column:
    """Mean return less downside less share of big losses among the selected, and a tenth of the big gains' capture."""
    of = lambda x: F.avg(F.when(side, x))
    captured = F.count(F.when(side & (ret > 0.03), 1)) / F.nullif(F.count(F.when(ret > 0.03, 1)), F.lit(0))
    return of(ret) - of(F.greatest(-ret, F.lit(0.0))) - of((ret < -0.03).cast("double")) + 0.1 * captured


_METRICS = "round(avg(CASE WHEN {0} = (up = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(({1} - up) ** 2), 6) AS brier, round(avg(r5) FILTER ({0}), 6) AS mean_return, round({2}, 6) AS utility, count(*) FILTER ({0} AND r5 < -0.03e0) AS big_losses"


@query("evl15_model_metrics", _MODELS + f" SELECT 'production' AS model, {_METRICS.format('a', 'probability_up', _utility('a'))} FROM y UNION ALL SELECT 'candidate', {_METRICS.format('b', 'pb', _utility('b'))} FROM y")
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Both models in one pass: a row becomes one for each model."""
    y = compared(spark, d)
    long = y.select("up", "ret_5", F.inline(F.array(F.struct(F.lit("production").alias("model"), F.col("a").alias("buy"), F.col("probability_up").alias("p")), F.struct(F.lit("candidate").alias("model"), F.col("b").alias("buy"), F.col("pb").alias("p")))))
    buy, r = F.col("buy"), F.col("ret_5")
    return long.groupBy("model").agg(F.round(F.avg((buy == (F.col("up") == 1)).cast("double")), 6).alias("accuracy"), F.round(E.brier(F.col("p"), F.col("up")), 6).alias("brier"), F.round(F.avg(F.when(buy, r)), 6).alias("mean_return"), F.round(utility(buy, r), 6).alias("utility"), F.count(F.when(buy & (r < -0.03), 1)).alias("big_losses"))


_TWO = _MODELS + f", m AS (SELECT 'production' AS model, {_METRICS.format('a', 'probability_up', _utility('a'))} FROM y UNION ALL SELECT 'candidate', {_METRICS.format('b', 'pb', _utility('b'))} FROM y), p AS (SELECT * FROM m WHERE model = 'production'), c AS (SELECT * FROM m WHERE model = 'candidate')"


@query("evl09_promotion", _TWO + """ SELECT concat_ws(',', CASE WHEN c.accuracy <= p.accuracy THEN 'accuracy' END, CASE WHEN c.brier >= p.brier THEN 'brier' END, CASE WHEN c.mean_return < p.mean_return THEN 'return' END, CASE WHEN c.big_losses > p.big_losses THEN 'big_loss' END, CASE WHEN c.utility <= p.utility THEN 'utility' END) AS reasons,
  CASE WHEN c.brier < p.brier AND c.mean_return >= p.mean_return AND c.big_losses <= p.big_losses AND c.utility > p.utility THEN 'PROMOTE' WHEN c.utility > p.utility THEN 'WATCH' ELSE 'HOLD' END AS verdict FROM c, p""")  # fmt: skip
def promotion(spark: SparkSession, d: str) -> DataFrame:
    m = model_metrics(spark, d)
    side = lambda name, x: m.where(F.col("model") == name).select(F.struct("*").alias(x))
    both = side("candidate", "c").crossJoin(F.broadcast(side("production", "p")))  # one row each
    rules = {"accuracy": "c.accuracy <= p.accuracy", "brier": "c.brier >= p.brier", "return": "c.mean_return < p.mean_return", "big_loss": "c.big_losses > p.big_losses", "utility": "c.utility <= p.utility"}
    reasons = F.concat_ws(",", *[F.when(F.expr(r), n) for n, r in rules.items()])
    good = F.expr("c.brier < p.brier and c.mean_return >= p.mean_return and c.big_losses <= p.big_losses and c.utility > p.utility")
    return both.select(reasons.alias("reasons"), F.when(good, "PROMOTE").when(F.expr("c.utility > p.utility"), "WATCH").otherwise("HOLD").alias("verdict"))


@query("evl12_metric_deltas", _TWO + " SELECT round(c.accuracy - p.accuracy, 6) AS accuracy, round(c.brier - p.brier, 6) AS brier, round(c.mean_return - p.mean_return, 6) AS mean_return, round(c.utility - p.utility, 6) AS utility FROM c, p")
def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    m = model_metrics(spark, d)
    of = lambda name, c: F.max(F.when(F.col("model") == name, F.col(c)))
    return m.agg(*[F.round(of("candidate", c) - of("production", c), 6).alias(c) for c in ("accuracy", "brier", "mean_return", "utility")])


_DRAWS = "(7919 * r + 104729 * j + (r * j) % 31) % n"
_BOOT = """blk AS (SELECT i // {0} AS block, avg(v) AS mean FROM c GROUP BY 1), draws AS (SELECT r, {1} AS pick FROM (SELECT unnest(range(500)) AS r), (SELECT block AS j, count(*) OVER () AS n FROM blk)), boots AS (SELECT r, avg(mean) AS mean FROM draws JOIN blk ON blk.block = draws.pick GROUP BY r)
SELECT round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.5), 6) AS median, round(quantile_cont(mean, 0.975), 6) AS upper, round(avg(CASE WHEN mean > 0 THEN 1e0 ELSE 0e0 END), 6) AS positive FROM boots"""


@query("evl04_block_bootstrap", _SCORED.rstrip() + ", c AS (SELECT event_date, avg(r5) AS v, row_number() OVER (ORDER BY event_date) - 1 AS i FROM s WHERE probability_up >= 0.5e0 GROUP BY event_date), " + _BOOT.format(5, _DRAWS))
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Five-day blocks of the selected decisions' daily means, 500 resamples."""
    daily = scored(spark, d).where("probability_up >= 0.5").groupBy("event_date").agg(F.avg("ret_5").alias("v"))
    return L.bounds(L.block_bootstrap(L.day_blocks(daily, "event_date", "v", 5)))


@query("evl05_paired_bootstrap", _MODELS + ", c AS (SELECT event_date, avg((CAST(b AS INT) - CAST(a AS INT)) * r5) AS v, row_number() OVER (ORDER BY event_date) - 1 AS i FROM y GROUP BY event_date), " + _BOOT.format(1, _DRAWS))
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Days resampled; a day counts the mean of the candidate's return less production's."""
    daily = compared(spark, d).groupBy("event_date").agg(F.avg((F.col("b").cast("int") - F.col("a").cast("int")) * F.col("ret_5")).alias("v"))
    return L.bounds(L.block_bootstrap(L.day_blocks(daily, "event_date", "v", 1)))


_THRESHOLDS = f", t AS (SELECT unnest(range(17)) AS step), u AS (SELECT step, {_utility('probability_up >= 0.3e0 + step * 0.025e0')} AS utility, count(*) FILTER (probability_up >= 0.3e0 + step * 0.025e0) AS n FROM s, t GROUP BY step)"


def threshold_utilities(spark: SparkSession, d: str) -> DataFrame:
    """step, utility, n of a grid of thresholds, all in one pass over the decisions."""
    s, p, r = scored(spark, d), F.col("probability_up"), F.col("ret_5")
    rows = [F.struct(F.lit(k).alias("step"), utility(p >= 0.3 + k * 0.025, r).alias("utility"), F.count(F.when(p >= 0.3 + k * 0.025, 1)).alias("n")) for k in range(17)]
    return s.agg(F.array(*rows).alias("g")).select(F.inline("g"))


@query("evl02_plateau", _SCORED.rstrip() + _THRESHOLDS + """, e AS (SELECT *, max(utility) OVER () AS best FROM u), f AS (SELECT *, step - row_number() OVER (ORDER BY step) AS run FROM e WHERE utility >= best - 0.002e0),
q AS (SELECT run, count(*) AS width, max(utility) AS top, list(step ORDER BY step) AS steps FROM f GROUP BY run ORDER BY width DESC, top DESC, run LIMIT 1) SELECT CAST(steps[(width - 1) // 2 + 1] AS INTEGER) AS step, width, round(top, 6) AS top FROM q""")  # fmt: skip
def plateau(spark: SparkSession, d: str) -> DataFrame:
    return L.plateau(threshold_utilities(spark, d), "step", "utility", 0.002).select("step", "width", F.round("top", 6).alias("top"))


@query("evl03_guardrails", _SCORED.rstrip() + _THRESHOLDS + " SELECT CAST(a.step AS INTEGER) AS step, round(a.utility - b.utility, 6) AS gain, a.utility > b.utility AND a.n >= b.n * 0.5e0 AS passes FROM u a, u b WHERE b.step = 8")
def guardrails(spark: SparkSession, d: str) -> DataFrame:
    """Each step against step 8 of the same sums: a second pass may add up in another order, and differ from itself."""
    all_ = Window.partitionBy(F.lit(0))  # 17 rows
    now = {f"now_{c}": F.max(F.when(F.col("step") == 8, F.col(c))).over(all_) for c in ("utility", "n")}
    u = threshold_utilities(spark, d).withColumns(now)
    return u.select("step", F.round(F.col("utility") - F.col("now_utility"), 6).alias("gain"), ((F.col("utility") > F.col("now_utility")) & (F.col("n") >= F.col("now_n") * 0.5)).alias("passes"))


_VARIANTS = ", v AS (SELECT model_version || '/' || endpoint AS model, avg(r5) AS ret, -avg((probability_up - up) ** 2) AS fit, -avg(CASE WHEN r5 < -0.03e0 THEN 1e0 ELSE 0e0 END) AS loss FROM s GROUP BY 1)"


@query("evl07_pareto", _SCORED.rstrip() + _VARIANTS + " SELECT model FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.model <> a.model AND b.ret >= a.ret AND b.fit >= a.fit AND b.loss >= a.loss AND (b.ret > a.ret OR b.fit > a.fit OR b.loss > a.loss))")
def pareto(spark: SparkSession, d: str) -> DataFrame:
    v = scored(spark, d).groupBy(F.concat_ws("/", "model_version", "endpoint").alias("model")).agg(F.avg("ret_5").alias("ret"), (-E.brier(F.col("probability_up"), F.col("up"))).alias("fit"), (-F.avg((F.col("ret_5") < -0.03).cast("double"))).alias("loss"))
    return L.undominated(v, "model", ["ret", "fit", "loss"]).select("model")


@query("evl10_fold_means", _SCORED.rstrip() + ", k AS (SELECT *, ntile(3) OVER (ORDER BY event_date, seq) AS fold FROM s), f AS (SELECT model_version, fold, avg(r5) AS ret FROM k GROUP BY 1, 2) SELECT model_version, round(avg(ret), 6) AS mean_return, count(*) FILTER (ret > 0) AS positive_folds FROM f GROUP BY 1")
def fold_means(spark: SparkSession, d: str) -> DataFrame:
    """Three folds of equal rows in order of (day, seq): days find their ranks first, so no window holds all rows."""
    s = scored(spark, d)
    days = s.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(F.lit(0)).orderBy("event_date")
    days = days.withColumns({"before": F.sum("rows").over(w) - F.col("rows"), "total": F.sum("rows").over(Window.partitionBy(F.lit(0)))})
    r = s.join(F.broadcast(days), "event_date").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("event_date").orderBy("seq")))  # one row a day
    # The first total mod 3 folds are one row longer.
    size, more = F.floor(F.col("total") / 3), F.col("total") % 3
    long = more * (size + 1)
    fold = F.when(F.col("rank") <= long, F.ceil(F.col("rank") / (size + 1))).otherwise(more + F.ceil((F.col("rank") - long) / size))
    f = r.withColumn("fold", fold).groupBy("model_version", "fold").agg(F.avg("ret_5").alias("ret"))
    return f.groupBy("model_version").agg(F.round(F.avg("ret"), 6).alias("mean_return"), F.count(F.when(F.col("ret") > 0, 1)).alias("positive_folds"))


def _descent(rate: float, steps: int, by_brier: bool) -> str:
    q = "1 / (1 + exp(-greatest(-35e0, least(35e0, a * x + b))))"
    g = f"2 * ({q} - y) * {q} * (1 - {q})" if by_brier else f"({q} - y)"
    clip = ("greatest(0.25e0, least(3e0, ", "))") if by_brier else ("", "")
    return f"""h AS (SELECT ln(p / (1 - p)) AS x, up AS y, count(*) AS n FROM (SELECT greatest(1e-6, least(1 - 1e-6, round(probability_up, 6))) AS p, up FROM s) GROUP BY 1, 2), t AS (SELECT sum(n) AS total FROM h),
g(k, a, b) AS (SELECT 0, 1e0, 0e0 UNION ALL SELECT k + 1, {clip[0]}any_value(a) - {rate}e0 * sum(n * ({g}) * x) / any_value(total){clip[1]}, any_value(b) - {rate}e0 * sum(n * ({g})) / any_value(total) FROM g, h, t WHERE k < {steps} GROUP BY k)"""


_REC = _SCORED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
_ABR = "avg((1 / (1 + exp(-(a * ln(p / (1 - p)) + b))) - up) ** 2)"


@query("ml05_platt", _REC + ", " + _descent(0.05, 500, False) + f""", z AS (SELECT a, b FROM g WHERE k = 500), q AS (SELECT avg((p - up) ** 2) AS raw, {_ABR} AS fitted FROM (SELECT greatest(1e-6, least(1 - 1e-6, probability_up)) AS p, up FROM s), z)
SELECT round(CASE WHEN fitted < raw THEN a ELSE 1e0 END, 5) AS slope, round(CASE WHEN fitted < raw THEN b ELSE 0e0 END, 5) AS intercept, round(raw, 6) AS raw_brier, round(least(raw, fitted), 6) AS brier, fitted < raw AS applied FROM z, q""")  # fmt: skip
def platt(spark: SparkSession, d: str) -> DataFrame:
    fit = L.platt(scored(spark, d), "probability_up", "up")
    return spark.createDataFrame([(round(fit["slope"], 5), round(fit["intercept"], 5), round(fit["raw_brier"], 6), round(fit["brier"], 6), bool(fit["applied"]))], "slope double, intercept double, raw_brier double, brier double, applied boolean")


@query("ml06_brier_deltas", _REC + ", " + _descent(0.03, 600, True) + " SELECT round(b, 5) AS intercept_delta, round(a - 1, 5) AS slope_delta FROM g WHERE k = 600")
def brier_deltas(spark: SparkSession, d: str) -> DataFrame:
    intercept, slope = L.platt_by_brier(scored(spark, d), "probability_up", "up")
    return spark.createDataFrame([(round(intercept, 5), round(slope, 5))], "intercept_delta double, slope_delta double")


@query("evl11_recalibration", _REC + ", " + _descent(0.03, 600, True) + """, c AS (SELECT count(*) AS n FROM s) SELECT n, round(greatest(-0.75e0, least(0.75e0, b)), 5) AS intercept_step, round(greatest(-0.5e0, least(0.5e0, a - 1)), 5) AS slope_step, n >= 30 AS enough FROM g, c WHERE k = 600""")
def recalibration(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    intercept, slope = L.platt_by_brier(s, "probability_up", "up")
    clip = lambda x, most: round(max(-most, min(most, x)), 5)
    return s.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(clip(intercept, 0.75)).alias("intercept_step"), F.lit(clip(slope, 0.5)).alias("slope_step"), (F.col("n") >= 30).alias("enough"))


@query("ml03_medians", _FEATURES + ", k AS (SELECT *, bar_date < DATE '1998-01-01' AS fit FROM x), med AS (SELECT median(ret_20) FILTER (fit) AS a, median(rsi_14) FILTER (fit) AS b FROM k) SELECT symbol, bar_date, round(coalesce(ret_20, a), 5) AS ret_20, round(coalesce(rsi_14, b), 5) AS rsi_14 FROM k, med WHERE NOT fit OR ret_20 IS NULL")
def filled(spark: SparkSession, d: str) -> DataFrame:
    f = stored(features(spark, d, ["ret_20", "rsi_14"]).drop("close_px"), "feature-medians")
    fill = L.medians(f.where("bar_date < date '1998-01-01'"), ["ret_20", "rsi_14"])
    return f.where("bar_date >= date '1998-01-01' or ret_20 is null").na.fill(fill).select("symbol", "bar_date", W.rounded("ret_20", 5).alias("ret_20"), W.rounded("rsi_14", 5).alias("rsi_14"))


@query("ml08_sample_weights", _SCORED + "SELECT seq, CASE WHEN r5 < -0.03e0 THEN 3e0 WHEN r5 < -0.005e0 THEN 1.5e0 WHEN r5 <= 0.005e0 THEN 0.5e0 WHEN r5 <= 0.03e0 THEN 1e0 ELSE 2e0 END AS by_bucket, round(CASE WHEN up = 1 THEN 0.5e0 / avg(up) OVER () ELSE 0.5e0 / (1 - avg(up) OVER ()) END, 6) AS balanced FROM s")
def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    rate = s.agg(F.avg("up").alias("rate"))
    bucket = F.create_map(*[F.lit(x) for kv in {"big_loss": 3.0, "loss": 1.5, "flat": 0.5, "gain": 1.0, "big_gain": 2.0}.items() for x in kv])
    return s.crossJoin(F.broadcast(rate)).select("seq", bucket[D.return_bucket(F.col("ret_5"))].alias("by_bucket"), F.round(F.when(F.col("up") == 1, 0.5 / F.col("rate")).otherwise(0.5 / (1 - F.col("rate"))), 6).alias("balanced"))  # one row


@query("ml13_baselines", _SCORED + "SELECT unnest(['majority', 'always_up', 'always_down']) AS baseline, unnest([round(greatest(avg(up), 1 - avg(up)), 6), round(avg(up), 6), round(1 - avg(up), 6)]) AS accuracy FROM s")
def baselines(spark: SparkSession, d: str) -> DataFrame:
    up = F.avg("up")
    rows = [("majority", F.greatest(up, 1 - up)), ("always_up", up), ("always_down", 1 - up)]
    return scored(spark, d).agg(F.array(*[F.struct(F.lit(n).alias("baseline"), F.round(v, 6).alias("accuracy")) for n, v in rows]).alias("g")).select(F.inline("g"))


@query("agg34_binary_summary", _SCORED + "SELECT count(*) AS n, round(avg(CASE WHEN (probability_up >= 0.5e0) = (up = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(CASE WHEN probability_up >= 0.5e0 THEN 1e0 ELSE 0e0 END), 6) AS positive_rate FROM s")
def binary_summary(spark: SparkSession, d: str) -> DataFrame:
    call = F.col("probability_up") >= 0.5
    return scored(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((call == (F.col("up") == 1)).cast("double")), 6).alias("accuracy"), F.round(F.avg(call.cast("double")), 6).alias("positive_rate"))


@query("ml01_logistic_fit")
def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    """feature, mean, deviation, coefficient, and the intercept's row, of the model of the bars before 1999."""
    data, scale = L.standardised(labelled(spark, d).where("bar_date < date '1999-01-01'"), L.FEATURES)
    coefficients, intercept = L.fit_logistic(data, L.FEATURES, "up")
    rows = [(c, *scale[c], w) for c, w in coefficients.items()] + [("intercept", 0.0, 1.0, intercept)]
    return spark.createDataFrame(rows, "feature string, mean double, deviation double, coefficient double")


def fitted(spark: SparkSession, d: str) -> tuple[DataFrame, dict, dict, float]:
    rows = labelled(spark, d)
    data, scale = L.standardised(rows.where("bar_date < date '1999-01-01'"), L.FEATURES)
    coefficients, intercept = L.fit_logistic(data, L.FEATURES, "up")
    return rows, scale, coefficients, intercept


@query("ml19_train_and_score")
def train_and_score(spark: SparkSession, d: str) -> DataFrame:
    """Fit before 1999, calibrate on 1999, score the rest."""
    rows, scale, coefficients, intercept = fitted(spark, d)
    scaled = rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})
    scored_ = scaled.withColumn("p", L.linear_score(coefficients, intercept))
    fit = L.platt(scored_.where("bar_date >= date '1999-01-01' and bar_date < date '2000-01-01'"), "p", "up")
    calibrated = D.clipped_sigmoid(fit["slope"] * D.clipped_logit(F.col("p")) + fit["intercept"])
    return scored_.where("bar_date >= date '2000-01-01'").select("symbol", "bar_date", "p", calibrated.alias("calibrated"), "up", "ret_next")


@query("ml16_contributions")
def contribution_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows in which a feature adds most to the score."""
    rows, scale, coefficients, _ = fitted(spark, d)
    top = rows.select(F.array_max(F.transform(L.contributions(coefficients, scale), lambda x: F.struct(x["part"].alias("part"), x["feature"].alias("feature")))).alias("t")).where("t.part > 0")
    total = top.agg(F.count(F.lit(1)).alias("n"))
    return top.groupBy("t.feature").agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(total)).select("feature", "rows", (F.col("rows") / F.col("n")).alias("share"))  # one row
