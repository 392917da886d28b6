"""Queries of event-time joins, corporate actions and scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import windows as W
from ..operators import asof as A
from ..sources import market as M
from .registry import query

_DB = M.with_views("bars", "decisions")


@query("jon01_backward_asof", M.with_views("bars", "decisions", more="b AS (SELECT *, row_number() OVER w AS bar_idx, lead(close_px, 5) OVER w AS exit_px FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))")
    + """SELECT d.seq, b.bar_date, round(b.close_px, 6) AS close_px, round(b.exit_px / b.close_px - 1, 6) AS fwd_5
FROM decisions d ASOF JOIN b ON d.symbol = b.symbol AND d.event_date >= b.bar_date WHERE b.bar_idx > 5""")  # fmt: skip
def backward_asof(spark: SparkSession, d: str) -> DataFrame:
    bars = A.bar_index(A.exits(M.bars(spark, d), [5]))
    met = A.backward_asof(M.decisions(spark, d).select("seq", "symbol", "event_date"), bars, "symbol", "event_date", "bar_date", ["close_px", "exit_5", "bar_idx"])
    return met.where("met.bar_idx > 5").select("seq", F.col("met._at").alias("bar_date"), F.round("met.close_px", 6).alias("close_px"), F.round(F.col("met.exit_5") / F.col("met.close_px") - 1, 6).alias("fwd_5"))


@query("jon02_last_bar_index", M.with_views("bars", "decisions", more="b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS bar_idx FROM bars)")
    + "SELECT d.seq, b.bar_idx FROM decisions d ASOF LEFT JOIN b ON d.symbol = b.symbol AND d.event_date >= b.bar_date")
def last_bar_index(spark: SparkSession, d: str) -> DataFrame:
    met = A.backward_asof(M.decisions(spark, d).select("seq", "symbol", "event_date"), A.bar_index(M.bars(spark, d)), "symbol", "event_date", "bar_date", ["bar_idx"])
    return met.select("seq", F.col("met.bar_idx").alias("bar_idx"))


_FORWARD = """b AS (SELECT *, lead(close_px, 1) OVER w AS e1, lead(close_px, 5) OVER w AS e5, lead(close_px, 10) OVER w AS e10 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
o AS (SELECT d.*, b.bar_date AS entry_date, b.close_px AS entry, e1, e5, e10 FROM decisions d ASOF LEFT JOIN b ON d.symbol = b.symbol AND d.event_date <= b.bar_date)"""


def outcomes(spark: SparkSession, d: str, horizons: list[int]) -> DataFrame:
    """Decisions with entry (first bar on or after the event day) and returns at the horizons."""
    bars = A.exits(M.bars(spark, d, together=True), horizons)
    met = A.forward_asof(M.decisions(spark, d), bars, "symbol", "event_date", "bar_date", ["close_px", *[f"exit_{n}" for n in horizons]])
    returns = {f"ret_{n}": W.safe_ratio(F.col(f"met.exit_{n}"), F.col("met.close_px")) - 1 for n in horizons}
    return met.withColumns({"entry_date": F.col("met._at"), "entry": F.col("met.close_px"), **returns}).drop("met")


@query("jon03_forward_asof", M.with_views("bars", "decisions", more=_FORWARD)
    + "SELECT seq, entry_date, round(e1 / entry - 1, 4) AS ret_1, round(e5 / entry - 1, 4) AS ret_5, round(e10 / entry - 1, 4) AS ret_10 FROM o")
def forward_asof(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(spark, d, [1, 5, 10])
    return o.select("seq", "entry_date", *[F.round(f"ret_{n}", 4).alias(f"ret_{n}") for n in (1, 5, 10)])


@query("win23_path_extremes", M.with_views("bars", "decisions", more="""b AS (SELECT symbol, bar_date, list(close_px) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS path FROM bars),
o AS (SELECT d.seq, d.action, b.path FROM decisions d ASOF JOIN b ON d.symbol = b.symbol AND d.event_date <= b.bar_date),
e AS (SELECT seq, list_transform(path, lambda p: (p / path[1] - 1) * CASE WHEN action IN ('STRONG BUY', 'BUY') THEN 1 WHEN action = 'SELL' THEN -1 ELSE 0 END) AS r FROM o)""")
    + "SELECT seq, round(list_min(r), 4) + 0 AS worst, round(list_max(r), 4) + 0 AS best FROM e")
def path_extremes(spark: SparkSession, d: str) -> DataFrame:
    bars = M.bars(spark, d, together=True).withColumn("path", A.path_closes("close_px", 5))
    met = A.forward_asof(M.decisions(spark, d), bars, "symbol", "event_date", "bar_date", ["path"]).where("met is not null")
    path = F.transform("met.path", lambda p: (p / F.col("met.path")[0] - 1) * D.exposure(F.col("action")))
    return met.select("seq", (F.round(F.array_min(path), 4) + 0).alias("worst"), (F.round(F.array_max(path), 4) + 0).alias("best"))


_FACTORS = "f AS (SELECT ticker, execution_date, exp(sum(ln(x)) OVER (PARTITION BY ticker ORDER BY execution_date)) AS factor FROM (SELECT ticker, execution_date, product(split_from / split_to) AS x FROM splits GROUP BY 1, 2))"


@query("jon07_split_range", M.with_views("bars", "splits", more="""w AS (SELECT max(bar_date) AS asof FROM bars)""")
    + """SELECT b.symbol, b.bar_date, round(coalesce(exp(sum(ln(split_from / split_to))), 1e0), 6) AS factor, count(s.id) AS n_splits
FROM bars b JOIN w ON true LEFT JOIN splits s ON s.ticker = b.symbol AND b.bar_date < s.execution_date AND s.execution_date <= w.asof GROUP BY 1, 2""")  # fmt: skip
def split_range(spark: SparkSession, d: str) -> DataFrame:
    """Product of the factors after a bar and up to the last day, as the ratio of two cumulative factors."""
    bars, splits = M.bars(spark, d).select("symbol", "bar_date"), M.splits(spark, d)
    last = bars.agg(F.max("bar_date").alias("asof"))
    inside = splits.crossJoin(F.broadcast(last)).where("execution_date <= asof")  # one row
    day = inside.groupBy("ticker", "execution_date").agg(F.sum(F.log(F.col("split_from") / F.col("split_to"))).alias("f"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ticker").orderBy("execution_date").rowsBetween(Window.unboundedPreceding, 0)
    run = day.select(F.col("ticker").alias("symbol"), "execution_date", F.sum("f").over(w).alias("f"), F.sum("n").over(w).alias("n"))
    totals = day.groupBy(F.col("ticker").alias("symbol")).agg(F.sum("f").alias("all_f"), F.sum("n").alias("all_n"))
    met = A.backward_asof(bars, run, "symbol", "bar_date", "execution_date", ["f", "n"]).join(totals, "symbol", "left")
    rest = F.coalesce(F.col("all_f"), F.lit(0.0)) - F.coalesce(F.col("met.f"), F.lit(0.0))
    return met.select("symbol", "bar_date", F.round(F.exp(rest), 6).alias("factor"), (F.coalesce("all_n", F.lit(0)) - F.coalesce("met.n", F.lit(0))).alias("n_splits"))


@query("jon08_news_interval", M.with_views("news", "decisions", more="e AS (SELECT seq, symbol, ts FROM decisions)")
    + """SELECT e.seq, count(n.doc_id) FILTER (n.published_ts > e.ts - 86400) AS news_24h, count(n.doc_id) AS news_72h
FROM e LEFT JOIN news n ON n.symbol = e.symbol AND n.published_ts <= e.ts AND n.published_ts > e.ts - 259200 GROUP BY e.seq""")  # fmt: skip
def news_interval(spark: SparkSession, d: str) -> DataFrame:
    events = M.decisions(spark, d).select("seq", "symbol", "ts")
    news = M.news(spark, d).select("symbol", "published_ts", F.lit(1).alias("news"))
    return A.interval_totals(events, news, "symbol", "ts", "published_ts", ["seq"], ["news"], {"24h": 86400, "72h": 259200})


@query("jon10_ranking_pairs", M.with_views("bars", "decisions", more=_FORWARD + ", s AS (SELECT probability_up AS p, CASE WHEN e5 / entry - 1 > 0 THEN 1 ELSE 0 END AS y FROM o WHERE probability_up IS NOT NULL AND e5 IS NOT NULL), g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p), c AS (SELECT *, sum(neg) OVER (ORDER BY p DESC) AS above FROM g)")
    + "SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, round(sum(pos * above) / (sum(pos) * sum(neg)), 6) AS misranked FROM c")
def ranking_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Share of (positive, negative) pairs in which the negative scores as high: from counts per score, not from pairs."""
    s = outcomes(spark, d, [5]).where("probability_up is not null and ret_5 is not null")
    g = s.groupBy(F.col("probability_up").alias("p")).agg(F.sum((F.col("ret_5") > 0).cast("long")).alias("pos"), F.sum((F.col("ret_5") <= 0).cast("long")).alias("neg"))
    # Scores have three decimals, so this table has 1,000 rows at most.
    c = g.withColumn("above", F.sum("neg").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)))
    return c.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.round(F.sum(F.col("pos") * F.col("above")) / (F.sum("pos") * F.sum("neg")), 6).alias("misranked"))


@query("jon11_portfolio", M.with_views("bars", "positions", "sectors", more="q AS (SELECT symbol, arg_max(close_px, bar_date) AS price FROM bars GROUP BY symbol), v AS (SELECT p.*, coalesce(q.price, p.buy_price) AS price, shares * coalesce(q.price, p.buy_price) AS value, coalesce(sector, 'UNKNOWN') AS sector FROM positions p LEFT JOIN q USING (symbol) LEFT JOIN sectors USING (symbol))")
    + "SELECT position_id, sector, round(value, 4) AS value, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS weight, round(sum(value) OVER (PARTITION BY user_id, sector) / sum(value) OVER (PARTITION BY user_id), 6) AS sector_weight, round(price / buy_price - 1, 6) AS gain FROM v")
def portfolio(spark: SparkSession, d: str) -> DataFrame:
    quotes = M.bars(spark, d).groupBy("symbol").agg(F.max_by("close_px", "bar_date").alias("price"))
    v = M.positions(spark, d).join(quotes, "symbol", "left").join(M.sectors(spark, d), "symbol", "left")
    v = v.withColumn("price", F.coalesce("price", "buy_price")).withColumns({"value": F.col("shares") * F.col("price"), "sector": F.coalesce("sector", F.lit("UNKNOWN"))})
    all_ = F.sum("value").over(Window.partitionBy("user_id"))
    by_sector = F.sum("value").over(Window.partitionBy("user_id", "sector"))
    return v.select("position_id", "sector", F.round("value", 4).alias("value"), F.round(F.col("value") / all_, 6).alias("weight"), F.round(by_sector / all_, 6).alias("sector_weight"), F.round(F.col("price") / F.col("buy_price") - 1, 6).alias("gain"))


@query("jon14_load_window", _DB + "SELECT DISTINCT symbol, CAST(min(event_date) OVER () - 70 AS DATE) AS load_from, CAST(max(event_date) OVER () + 8 AS DATE) AS load_to FROM decisions")
def load_window(spark: SparkSession, d: str) -> DataFrame:
    dec = M.decisions(spark, d)
    span = dec.agg(F.date_sub(F.min("event_date"), 70).alias("load_from"), F.date_add(F.max("event_date"), 8).alias("load_to"))
    return dec.select("symbol").distinct().crossJoin(F.broadcast(span))  # one row


@query("jon17_bounded_outcome", M.with_views("bars", "decisions", more="b AS (SELECT *, lead(close_px, 5) OVER w AS e5, lead(bar_date, 5) OVER w AS d5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))")
    + "SELECT d.seq, round(CASE WHEN b.d5 < d.event_date + 14 THEN b.e5 / b.close_px - 1 END, 4) AS ret_5 FROM decisions d ASOF LEFT JOIN b ON d.symbol = b.symbol AND d.event_date <= b.bar_date")
def bounded_outcome(spark: SparkSession, d: str) -> DataFrame:
    bars = A.exits(M.bars(spark, d), [5]).withColumn("exit_date", F.lead("bar_date", 5).over(W.by_symbol()))
    met = A.forward_asof(M.decisions(spark, d), bars, "symbol", "event_date", "bar_date", ["close_px", "exit_5", "exit_date"])
    ret = F.when(F.col("met.exit_date") < F.date_add("event_date", 14), F.col("met.exit_5") / F.col("met.close_px") - 1)
    return met.select("seq", F.round(ret, 4).alias("ret_5"))


@query("cor01_split_factor", M.with_views("splits") + "SELECT id, ticker, execution_date, round(split_from / split_to, 6) AS price_factor FROM splits WHERE adjustment_type IN ('forward_split', 'reverse_split', 'stock_dividend') AND split_from > 0 AND split_to > 0")
def split_factor(spark: SparkSession, d: str) -> DataFrame:
    s = M.splits(spark, d).where(F.col("adjustment_type").isin("forward_split", "reverse_split", "stock_dividend") & (F.col("split_from") > 0) & (F.col("split_to") > 0))
    return s.select("id", "ticker", "execution_date", F.round(F.col("split_from") / F.col("split_to"), 6).alias("price_factor"))


@query("cor02_canonical_splits", M.with_views("splits", more="two AS (SELECT *, 1 AS pos FROM splits UNION ALL SELECT *, 2 FROM splits WHERE id LIKE 'b%')")
    + "SELECT ticker, execution_date, id, split_from, split_to, max(pos) AS pos FROM two GROUP BY 1, 2, 3, 4, 5")
def canonical_splits(spark: SparkSession, d: str) -> DataFrame:
    s = M.splits(spark, d)
    two = s.withColumn("pos", F.lit(1)).unionByName(s.where("id like 'b%'").withColumn("pos", F.lit(2)))
    return two.groupBy("ticker", "execution_date", "id", "split_from", "split_to").agg(F.max("pos").alias("pos"))


@query("cor04_cumulative_factor", M.with_views("splits", more=_FACTORS) + "SELECT ticker, execution_date, round(factor, 6) AS factor FROM f")
def cumulative_factor(spark: SparkSession, d: str) -> DataFrame:
    return A.cumulative_factor(M.splits(spark, d)).select("ticker", "execution_date", F.round("factor", 6).alias("factor"))


@query("cor05_adjusted_bars", M.with_views("bars", "splits", more=_FACTORS)
    + "SELECT b.symbol, b.bar_date, round(close_px / coalesce(factor, 1e0), 6) AS neutral_close, round(volume * coalesce(factor, 1e0), 6) AS neutral_volume FROM bars b ASOF LEFT JOIN f ON f.ticker = b.symbol AND b.bar_date >= f.execution_date")
def adjusted_bars(spark: SparkSession, d: str) -> DataFrame:
    b = A.with_factor(M.bars(spark, d), M.splits(spark, d), "symbol", "bar_date", "factor")
    return b.select("symbol", "bar_date", F.round(F.col("close_px") / F.col("factor"), 6).alias("neutral_close"), F.round(F.col("volume") * F.col("factor"), 6).alias("neutral_volume"))


_RET = M.with_views("bars", "decisions", more=_FORWARD)


@query("scl14_return_bucket", _RET + "SELECT seq, CASE WHEN r < -0.03 THEN 'big_loss' WHEN r < -0.005 THEN 'loss' WHEN r <= 0.005 THEN 'flat' WHEN r <= 0.03 THEN 'gain' WHEN r IS NOT NULL THEN 'big_gain' END AS bucket FROM (SELECT seq, e5 / entry - 1 AS r FROM o)")
def return_buckets(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d, [5]).select("seq", D.return_bucket(F.col("ret_5")).alias("bucket"))


_OUTCOME = """CASE WHEN r IS NULL THEN 'skipped' WHEN action IN ('STRONG BUY', 'BUY') THEN CASE WHEN r > 0 THEN 'correct' ELSE 'incorrect' END
  WHEN action IN ('SELL', 'HOLD OFF FOR NOW') THEN CASE WHEN r <= 0 THEN 'correct' ELSE 'incorrect' END WHEN action = 'HOLD' THEN 'neutral' ELSE 'skipped' END"""
_EXPOSURE = "CASE WHEN action IN ('STRONG BUY', 'BUY') THEN 1 WHEN action = 'SELL' THEN -1 ELSE 0 END"


@query("scl16_outcome", _RET + f"SELECT seq, {_OUTCOME} AS outcome, CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END AS label_up, round(r * {_EXPOSURE}, 4) + 0 AS paper_return FROM (SELECT *, e5 / entry - 1 AS r FROM o)")
def outcome_rules(spark: SparkSession, d: str) -> DataFrame:
    o, r, a = outcomes(spark, d, [5]), F.col("ret_5"), F.col("action")
    return o.select("seq", D.outcome(a, r).alias("outcome"), (r > 0).cast("double").alias("label_up"), (F.round(r * D.exposure(a), 4) + 0).alias("paper_return"))


@query("scl18_sentiment", M.with_views("news", more="c AS (SELECT doc_id, " + " + ".join(f"CAST(contains(lower(title), '{w}') AS INT)" for w in ("thatin", "hehely", "ering")) + " AS p, " + " + ".join(f"CAST(contains(lower(title), '{w}') AS INT)" for w in ("ononst", "orantion", "oning")) + " AS n FROM news)")
    + "SELECT doc_id, round(CASE WHEN p + n > 0 THEN (p - n) / CAST(p + n AS DOUBLE) ELSE 0e0 END, 6) AS sentiment FROM c")
def sentiment(spark: SparkSession, d: str) -> DataFrame:
    s = D.keyword_sentiment(F.col("title"), ["thatin", "hehely", "ering"], ["ononst", "orantion", "oning"])
    return M.news(spark, d).select("doc_id", F.round(s, 6).alias("sentiment"))


@query("scl23_hash_bucket", M.with_views("decisions") + "SELECT seq, round(CAST(('0x' || substring(sha256('s1:' || symbol), 1, 8)) AS BIGINT) / 4294967295e0, 6) AS share FROM decisions")
def hash_bucket(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).select("seq", F.round(D.hash_share("s1", F.col("symbol")), 6).alias("share"))


@query("scl24_sigmoid_logit", M.with_views("decisions", more="p AS (SELECT seq, greatest(1e-6, least(1 - 1e-6, probability_up)) AS p, probability_up FROM decisions WHERE probability_up IS NOT NULL)")
    + "SELECT seq, round(1 / (1 + exp(-greatest(-35e0, least(35e0, probability_up * 4 - 2)))), 6) AS sig, round(ln(p / (1 - p)), 6) AS logit FROM p")
def sigmoid_logit(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("probability_up")
    return M.decisions(spark, d).where(p.isNotNull()).select("seq", F.round(D.clipped_sigmoid(p * 4 - 2), 6).alias("sig"), F.round(D.clipped_logit(p), 6).alias("logit"))


@query("scl02_epoch_unit", M.with_views("decisions", more="x AS (SELECT seq, ts * CASE seq % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END AS e FROM decisions)")
    + "SELECT seq, CAST(round(CASE WHEN e >= 100000000000000000 THEN e / 1e9 WHEN e >= 100000000000000 THEN e / 1e6 WHEN e >= 100000000000 THEN e / 1e3 WHEN e > 0 THEN CAST(e AS DOUBLE) END) AS BIGINT) AS seconds FROM x")
def epoch_unit(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u).cast("long") for u in (1, 10**3, 10**6, 10**9)]), (F.pmod("seq", F.lit(4)) + 1).cast("int"))
    return M.decisions(spark, d).select("seq", F.round(D.epoch_seconds(F.col("ts") * unit)).cast("long").alias("seconds"))


@query("scl13_horizon", M.with_views("decisions") + "SELECT seq, CASE WHEN regexp_extract(model_version, '([0-9]+)\\s*d', 1) <> '' THEN regexp_extract(model_version, '([0-9]+)\\s*d', 1) || 'd' ELSE 'unknown' END AS horizon FROM decisions")
def horizon(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).select("seq", D.horizon_days(F.col("model_version")).alias("horizon"))


@query("snk04_partition_key", M.with_views("decisions") + "SELECT seq, substring(regexp_replace(upper(trim(action)), '[^A-Z0-9_-]', '_', 'g'), 1, 32) AS part, CAST(year(event_date) AS INTEGER) AS event_year FROM decisions")
def partition_keys(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).select("seq", D.partition_key(F.col("action")).alias("part"), F.year("event_date").alias("event_year"))


@query("flt04_exclusions", M.with_views("bars", "decisions", more=_FORWARD + ", x AS (SELECT CASE WHEN probability_up IS NULL THEN 'no_probability' WHEN entry IS NULL THEN 'no_entry' WHEN e5 IS NULL THEN 'immature' WHEN action = 'HOLD' THEN 'neutral_action' ELSE 'eligible' END AS reason FROM o)")
    + "SELECT reason, count(*) AS n FROM x GROUP BY reason")
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("probability_up").isNull(), "no_probability").when(F.col("entry").isNull(), "no_entry").when(F.col("ret_5").isNull(), "immature").when(F.col("action") == "HOLD", "neutral_action").otherwise("eligible")
    return outcomes(spark, d, [5]).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
