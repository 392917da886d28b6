"""Queries of whole reports: all horizons, bins, segments, percentiles and limits of the measures that other modules show in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import windows as W
from ..operators import asof as A
from ..operators import evaluation as E
from ..operators import modeling as L
from ..sources import market as M
from ..sources.files import stored
from .desk_queries import _LAST, last_prices
from .evaluation_queries import _O, _SCORED, scored
from .join_queries import outcomes
from .model_queries import _FEATURES, features, utility
from .model_queries import _utility as _utility_sql
from .registry import query

_ACTIONS = ("STRONG BUY", "BUY", "HOLD", "HOLD OFF FOR NOW", "SELL")
_HORIZONS = (1, 5, 10, 20)
_O20 = _O.replace("lead(close_px, 10) OVER w AS e10", "lead(close_px, 10) OVER w AS e10, lead(close_px, 20) OVER w AS e20").replace("e1, e5, e10 FROM", "e1, e5, e10, e20 FROM").rstrip()


@query("agg02_by_action_all", _O20 + ", l AS (SELECT action, side, unnest([1, 5, 10, 20]) AS horizon, unnest([e1, e5, e10, e20]) / entry - 1 AS r FROM y), x5 AS (SELECT unnest(['" + "', '".join(_ACTIONS) + "']) AS action), h AS (SELECT unnest([1, 5, 10, 20]) AS horizon) SELECT x5.action, CAST(h.horizon AS INTEGER) AS horizon, count(r) AS n, round(avg(r), 6) AS mean_return, round(avg(r * side), 6) + 0 AS mean_paper FROM x5 CROSS JOIN h LEFT JOIN l ON l.action = x5.action AND l.horizon = h.horizon GROUP BY 1, 2")
def by_action(spark: SparkSession, d: str) -> DataFrame:
    """Every action at every horizon, also where none was evaluated."""
    o = outcomes(spark, d, list(_HORIZONS)).withColumn("side", D.exposure(F.col("action")))
    long = o.select("action", "side", F.inline(F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"ret_{n}").alias("r")) for n in _HORIZONS])))
    got = long.groupBy("action", "horizon").agg(F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean_return"), (F.round(F.avg(F.col("r") * F.col("side")), 6) + 0).alias("mean_paper"))
    every = spark.createDataFrame([(a, n) for a in _ACTIONS for n in _HORIZONS], "action string, horizon int")
    return every.join(got, ["action", "horizon"], "left").na.fill(0, ["n"])


@query("agg04_event_counts", M.with_views("decisions", more="t AS (SELECT symbol, count(*) AS n FROM decisions GROUP BY 1 ORDER BY n DESC, symbol LIMIT 5)") + "SELECT 'source' AS kind, decision_source AS value, count(*) AS n, max(ts) AS latest FROM decisions GROUP BY 2 UNION ALL SELECT 'endpoint', endpoint, count(*), max(ts) FROM decisions GROUP BY 2 UNION ALL SELECT 'symbol', symbol, n, NULL FROM t")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    x = M.decisions(spark, d)
    u = x.select("ts", F.explode(F.create_map(F.lit("source"), "decision_source", F.lit("endpoint"), "endpoint")).alias("kind", "value"))
    top = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(5)
    return u.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest")).unionByName(top.select(F.lit("symbol").alias("kind"), F.col("symbol").alias("value"), "n", F.lit(None).cast("bigint").alias("latest")))


_BIN5 = "b AS (SELECT least(floor(probability_up * 5), 4) AS bin, count(*) AS n, avg(probability_up) AS p, avg(up) AS y FROM s GROUP BY 1)"


@query("agg07_five_bins", _SCORED.rstrip().replace("b AS (SELECT *, lead", "bb AS (SELECT *, lead").replace("ASOF LEFT JOIN b ON d.symbol = b.symbol AND d.event_date <= b.bar_date", "ASOF LEFT JOIN bb ON d.symbol = bb.symbol AND d.event_date <= bb.bar_date").replace("b.bar_date AS entry_date, b.close_px", "bb.bar_date AS entry_date, bb.close_px") + ", " + _BIN5 + " SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece, count(*) AS bins FROM b")
def five_bins(spark: SparkSession, d: str) -> DataFrame:
    b = E.calibration_bins(scored(spark, d), "probability_up", "up", 5)
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n"), 6).alias("ece"), F.count(F.lit(1)).alias("bins"))


@query("agg08_brier_scores", _SCORED.rstrip() + ", c AS (SELECT probability_up AS p, 1 / (1 + exp(-(0.8e0 * ln(greatest(1e-6, least(1 - 1e-6, probability_up)) / (1 - greatest(1e-6, least(1 - 1e-6, probability_up)))) + 0.1e0))) AS q, up FROM s) SELECT count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(up), 6) AS mean_y, round(avg((p - up) ** 2), 6) AS raw, round(avg((q - up) ** 2), 6) AS calibrated, round(least(avg((p - up) ** 2), avg((q - up) ** 2)), 6) AS effective FROM c")
def brier_scores(spark: SparkSession, d: str) -> DataFrame:
    p, y = F.col("probability_up"), F.col("up")
    raw, calibrated = E.brier(p, y), E.brier(D.clipped_sigmoid(0.8 * D.clipped_logit(p) + 0.1), y)
    return scored(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("mean_y"), F.round(raw, 6).alias("raw"), F.round(calibrated, 6).alias("calibrated"), F.round(F.least(raw, calibrated), 6).alias("effective"))


_SEGMENTS = {"endpoint": "endpoint", "source": "decision_source", "version": "model_version", "action": "action", "year": "CAST(year(event_date) AS STRING)", "side": "CASE WHEN action IN ('STRONG BUY', 'BUY') THEN 'buy' ELSE 'other' END", "confidence": "CASE WHEN probability_up >= 0.5 THEN 'high' ELSE 'low' END"}


@query("agg09_seven_segments", _SCORED.rstrip() + ", u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS segment, {e} AS value, probability_up AS p, up FROM s" for k, e in _SEGMENTS.items()) + ") SELECT segment, value, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(up), 6) AS mean_y, round(avg((p - up) ** 2), 6) AS brier FROM u GROUP BY 1, 2")
def seven_segments(spark: SparkSession, d: str) -> DataFrame:
    u = scored(spark, d).select(F.col("probability_up").alias("p"), "up", F.explode(F.create_map(*[x for k, e in _SEGMENTS.items() for x in (F.lit(k), F.expr(e))])).alias("segment", "value"))
    return u.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("up"), 6).alias("mean_y"), F.round(E.brier(F.col("p"), F.col("up")), 6).alias("brier"))


_DIST = ("ret_1", "ret_5", "ret_20")
_UNPIVOT = "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM x" for c in _DIST) + ")"


def unpivoted(spark: SparkSession, d: str) -> DataFrame:
    """Values of the returns, written once: percentiles, gaps and moments read them."""
    held = stored(features(spark, d, _DIST).select(*_DIST), "unpivoted")
    return held.select(F.explode(F.create_map(*[x for c in _DIST for x in (F.lit(c), F.col(c))])).alias("feature", "v"))


@query("agg13_distribution", _FEATURES + f", {_UNPIVOT}, k AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS k, count(*) OVER (PARTITION BY feature) AS n FROM u WHERE v IS NOT NULL) SELECT feature, count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, " + ", ".join(f"round(min(v) FILTER (k >= floor((n - 1) * {q}e0) + 1), 6) AS {c}" for c, q in (("p50", 0.5), ("p99", 0.99), ("p995", 0.995), ("p999", 0.999))) + " FROM k GROUP BY 1")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    u = unpivoted(spark, d).where("v is not null")
    q = E.nearest_rank(u, ["feature"], "v", {"p50": 0.5, "p99": 0.99, "p995": 0.995, "p999": 0.999})
    g = u.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"), F.round(F.avg("v"), 6).alias("mean"))
    return g.join(q, "feature").select("feature", "n", "least", "most", "mean", *[F.round(c, 6).alias(c) for c in ("p50", "p99", "p995", "p999")])


_QS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999)


@query("agg14_feature_audit", _FEATURES + f", {_UNPIVOT}, m AS (SELECT feature, median(v) AS med FROM u GROUP BY 1) ".replace(", m AS", ", med AS") + "SELECT u.feature, count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(median(abs(v - med)), 6) AS mad, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{k}" for k, q in enumerate(_QS)) + " FROM u JOIN med ON med.feature = u.feature GROUP BY 1")
def feature_audit(spark: SparkSession, d: str) -> DataFrame:
    u = unpivoted(spark, d)
    q = L.interpolated(u, ["feature"], "v", {f"q{k}": q for k, q in enumerate(_QS)})
    gaps = u.join(F.broadcast(q.select("feature", "q6")), "feature").select("feature", F.abs(F.col("v") - F.col("q6")).alias("v"))  # one row a feature
    mad = L.interpolated(gaps, ["feature"], "v", {"mad": 0.5})
    g = u.groupBy("feature").agg(F.count("v").alias("n"), (F.count(F.lit(1)) - F.count("v")).alias("missing"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation"))
    return g.join(q, "feature").join(mad, "feature").select("feature", "n", "missing", "mean", "deviation", F.round("mad", 6).alias("mad"), *[F.round(f"q{k}", 6).alias(f"q{k}") for k in range(len(_QS))])


_BUCKET = "CASE WHEN r5 < -0.03e0 THEN 'big_loss' WHEN r5 < -0.005e0 THEN 'loss' WHEN r5 <= 0.005e0 THEN 'flat' WHEN r5 <= 0.03e0 THEN 'gain' ELSE 'big_gain' END"


@query("agg16_bucket_rates", _SCORED.rstrip() + f" SELECT {_BUCKET} AS bucket, count(*) AS n, count(*) FILTER (probability_up >= 0.5e0) AS selected, round(avg(probability_up), 6) AS mean_p, round(avg(r5), 6) AS mean_return, round(count(*) FILTER (probability_up >= 0.5e0) / (SELECT count(*) FROM s WHERE probability_up >= 0.5e0)::DOUBLE, 6) AS share_of_selected, round(count(*) FILTER (probability_up >= 0.5e0) / count(*)::DOUBLE, 6) AS capture FROM s GROUP BY 1")
def bucket_rates(spark: SparkSession, d: str) -> DataFrame:
    g = scored(spark, d).groupBy(D.return_bucket(F.col("ret_5")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("probability_up") >= 0.5, 1)).alias("selected"), F.round(F.avg("probability_up"), 6).alias("mean_p"), F.round(F.avg("ret_5"), 6).alias("mean_return"))
    return g.withColumn("share_of_selected", F.round(F.col("selected") / F.sum("selected").over(Window.partitionBy(F.lit(0))), 6)).withColumn("capture", F.round(F.col("selected") / F.col("n"), 6))


_WT = "CASE WHEN r5 < -0.03e0 THEN 3e0 ELSE 1e0 END"


@query("agg18_weighted_metrics", _SCORED.rstrip() + f" SELECT round(sum({_WT} * CASE WHEN (probability_up >= 0.5e0) = (up = 1) THEN 1e0 ELSE 0e0 END) / sum({_WT}), 6) AS accuracy, round(sum({_WT} * (probability_up - up) ** 2) / sum({_WT}), 6) AS brier, round(avg(r5) FILTER (probability_up >= 0.5e0), 6) AS selected_return, round({_utility_sql('probability_up >= 0.5e0')}, 6) AS utility FROM s")
def weighted_metrics(spark: SparkSession, d: str) -> DataFrame:
    p, y, r = F.col("probability_up"), F.col("up"), F.col("ret_5")
    weight = F.when(r < -0.03, 3.0).otherwise(1.0)
    mean = lambda x: F.round(F.sum(weight * x) / F.sum(weight), 6)
    return scored(spark, d).agg(mean(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), mean((p - y) * (p - y)).alias("brier"), F.round(F.avg(F.when(p >= 0.5, r)), 6).alias("selected_return"), F.round(utility(p >= 0.5, r), 6).alias("utility"))


@query("agg22_leakage_pairs", _SCORED.rstrip() + ", f AS (SELECT 'probability' AS feature, probability_up AS v, r5 FROM s UNION ALL SELECT 'echo', r5 * 1.0000001e0, r5 FROM s UNION ALL SELECT 'entry', entry, r5 FROM s) SELECT feature, count(*) AS n, round(avg(CASE WHEN abs(v - r5) <= 1e-6 THEN 1e0 ELSE 0e0 END), 6) AS equal_share, round(corr(v, r5), 5) AS correlation, count(*) >= 20 AND (avg(CASE WHEN abs(v - r5) <= 1e-6 THEN 1e0 ELSE 0e0 END) >= 0.95e0 OR abs(corr(v, r5)) >= 0.995e0) AS violation FROM f GROUP BY 1")
def leakage_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a feature and the outcome in one pass."""
    r = F.col("ret_5")
    f = scored(spark, d).select("ret_5", F.explode(F.create_map(F.lit("probability"), F.col("probability_up"), F.lit("echo"), r * 1.0000001, F.lit("entry"), F.col("entry"))).alias("feature", "v"))
    same, like = F.avg((F.abs(F.col("v") - r) <= 1e-6).cast("double")), F.corr("v", "ret_5")
    return f.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(same, 6).alias("equal_share"), F.round(like, 5).alias("correlation"), ((F.count(F.lit(1)) >= 20) & ((same >= 0.95) | (F.abs(like) >= 0.995))).alias("violation"))


_DEC = ", ".join(f"quantile_cont(v, {k / 10}) AS c{k}" for k in range(1, 10))
_CUT = " + ".join(f"CASE WHEN v > c{k} THEN 1 ELSE 0 END" for k in range(1, 10))


@query("agg27_decile_stability", _FEATURES + f""", {_UNPIVOT.replace('AS v FROM x', "AS v, bar_date < DATE '1998-06-01' AS ref FROM x")}, c AS (SELECT feature, {_DEC}, avg(v) AS m, median(v) AS med, stddev_pop(v) AS sd FROM u WHERE ref AND v IS NOT NULL GROUP BY 1),
n AS (SELECT feature, {_CUT} AS bin, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM u JOIN c USING (feature) WHERE v IS NOT NULL GROUP BY 1, 2), g AS (SELECT feature, CAST(unnest(range(10)) AS INTEGER) AS bin FROM c),
h AS (SELECT feature, bin, greatest(coalesce(a, 0), 0.5e0) AS a, greatest(coalesce(b, 0), 0.5e0) AS b FROM g LEFT JOIN n USING (feature, bin)), p AS (SELECT feature, a / sum(a) OVER (PARTITION BY feature) AS p, b / sum(b) OVER (PARTITION BY feature) AS q FROM h),
l AS (SELECT u.feature, avg(v) - any_value(m) AS mean_shift, median(v) - any_value(med) AS median_shift, stddev_pop(v) / any_value(sd) AS deviation_ratio FROM u JOIN c USING (feature) WHERE NOT ref GROUP BY 1)
SELECT p.feature, round(sum((q - p) * ln(q / p)), 5) AS psi, any_value(round(mean_shift, 5)) AS mean_shift, any_value(round(median_shift, 5)) AS median_shift, any_value(round(deviation_ratio, 5)) AS deviation_ratio FROM p JOIN l USING (feature) GROUP BY 1""")  # fmt: skip
def decile_stability(spark: SparkSession, d: str) -> DataFrame:
    f = stored(features(spark, d, _DIST).drop("symbol", "close_px"), "decile-rows")
    u = f.select((F.col("bar_date") < F.lit("1998-06-01").cast("date")).alias("ref"), F.explode(F.create_map(*[x for c in _DIST for x in (F.lit(c), F.col(c))])).alias("feature", "v")).where("v is not null")
    old, new = u.where("ref"), u.where("not ref")
    cuts = L.interpolated(old, ["feature"], "v", {f"c{k}": k / 10 for k in range(1, 10)})
    moments = lambda x, s: x.groupBy("feature").agg(F.avg("v").alias(f"m{s}"), F.stddev_pop("v").alias(f"sd{s}")).join(L.interpolated(x, ["feature"], "v", {f"med{s}": 0.5}), "feature")
    cut = sum((F.when(F.col("v") > F.col(f"c{k}"), 1).otherwise(0) for k in range(1, 10)), F.lit(0)).alias("bin")
    n = u.join(F.broadcast(cuts), "feature").groupBy("feature", cut).agg(F.count(F.when(F.col("ref"), 1)).alias("a"), F.count(F.when(~F.col("ref"), 1)).alias("b"))  # one row a feature
    grid = cuts.select("feature", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    w = Window.partitionBy("feature")
    h = grid.join(n, ["feature", "bin"], "left").select("feature", *[F.greatest(F.coalesce(c, F.lit(0)).cast("double"), F.lit(0.5)).alias(c) for c in ("a", "b")])
    p = h.select("feature", (F.col("a") / F.sum("a").over(w)).alias("p"), (F.col("b") / F.sum("b").over(w)).alias("q"))
    psi = p.groupBy("feature").agg(F.round(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))), 5).alias("psi"))
    both = psi.join(moments(old, 0), "feature").join(moments(new, 1), "feature")
    return both.select("feature", "psi", F.round(F.col("m1") - F.col("m0"), 5).alias("mean_shift"), F.round(F.col("med1") - F.col("med0"), 5).alias("median_shift"), F.round(F.col("sd1") / F.col("sd0"), 5).alias("deviation_ratio"))


@query("agg24_cohort_economics_total", _SCORED.rstrip() + ", c AS (SELECT event_date, avg(r5) AS universe, avg(r5) FILTER (probability_up >= 0.5e0) - 0.002e0 AS net FROM s GROUP BY 1 HAVING count(*) FILTER (probability_up >= 0.5e0) > 0) SELECT count(*) AS days, round(avg(net), 6) AS mean_net, round(median(net), 6) AS median_net, round(avg(net - universe), 6) AS mean_excess FROM c")
def cohort_economics(spark: SparkSession, d: str) -> DataFrame:
    c = scored(spark, d).groupBy("event_date").agg(F.avg("ret_5").alias("universe"), (F.avg(F.when(F.col("probability_up") >= 0.5, F.col("ret_5"))) - 0.002).alias("net")).where("net is not null")
    return c.agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("net"), 6).alias("mean_net"), F.round(F.median("net"), 6).alias("median_net"), F.round(F.avg(F.col("net") - F.col("universe")), 6).alias("mean_excess"))


@query("agg29_sector_breakdown", M.with_views("bars", "positions", "sectors", more=_LAST) + ", v AS (SELECT coalesce(sector, 'UNKNOWN') AS sector, shares * coalesce(price, buy_price) AS value, change FROM positions LEFT JOIN q USING (symbol) LEFT JOIN sectors USING (symbol)) SELECT sector, round(sum(value), 2) AS value, round(sum(value) / (SELECT sum(value) FROM v), 6) AS share, round(avg(change), 6) AS mean_change, CAST(row_number() OVER (ORDER BY round(sum(value), 2) DESC, sector) AS INTEGER) AS place FROM v GROUP BY 1")
def sector_breakdown(spark: SparkSession, d: str) -> DataFrame:
    v = M.positions(spark, d).join(last_prices(spark, d), "symbol", "left").join(M.sectors(spark, d), "symbol", "left")
    g = v.groupBy(F.coalesce("sector", F.lit("UNKNOWN")).alias("sector")).agg(F.sum(F.col("shares") * F.coalesce("price", "buy_price")).alias("v"), F.round(F.avg("change"), 6).alias("mean_change"))
    one = Window.partitionBy(F.lit(0))  # one row a sector
    return g.select("sector", F.round("v", 2).alias("value"), F.round(F.col("v") / F.sum("v").over(one), 6).alias("share"), "mean_change", F.row_number().over(one.orderBy(F.desc(F.round("v", 2)), "sector")).alias("place"))


_REQ = "WITH k AS (SELECT event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, epoch(ts) AS secs FROM events), r AS (SELECT *, CASE WHEN k % 20 = 0 THEN 429 WHEN k % 33 = 0 THEN 500 ELSE 200 END AS status FROM k), o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(value) OVER (PARTITION BY event_type) AS n FROM r WHERE value IS NOT NULL), q AS (SELECT event_type, CASE WHEN max(n) >= 100 THEN max(value) FILTER (i = floor((n + 1) * 0.95e0)) + ((any_value(n) + 1) * 0.95e0 - floor((any_value(n) + 1) * 0.95e0)) * (max(value) FILTER (i = floor((n + 1) * 0.95e0) + 1) - max(value) FILTER (i = floor((n + 1) * 0.95e0))) END AS p95 FROM o GROUP BY 1) "


@query("agg31_request_rollup", _REQ + "SELECT r.event_type, count(*) AS n, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status = 429) AS throttled, count(*) FILTER (status = 500) AS failed, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(max(value), 6) AS most, round(any_value(p95), 6) AS p95, round(count(*) / nullif(max(secs) - min(secs), 0) * 3600, 6) AS per_hour FROM r LEFT JOIN q USING (event_type) GROUP BY 1")
def request_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    r = M.table(spark, d, "events").select("event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.when(k % 20 == 0, 429).when(k % 33 == 0, 500).otherwise(200).alias("status"))
    q = L.interpolated(r, ["event_type"], "value", {"p95": 0.95}, exclusive=True)
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    g = r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), n(200).alias("ok"), n(429).alias("throttled"), n(500).alias("failed"), F.round(F.min("value"), 6).alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.count("value").alias("held"),
        F.round(F.count(F.lit(1)) / F.nullif(F.max("at") - F.min("at"), F.lit(0.0)) * 3600, 6).alias("per_hour"))
    return g.join(q, "event_type", "left").withColumn("p95", F.when(F.col("held") >= 100, F.round("p95", 6))).drop("held")


_KEYS = {"symbol": "symbol", "endpoint": "endpoint", "source": "decision_source", "recommendation": "action"}


@query("agg33_concentration", _SCORED.rstrip() + ", u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS value FROM s WHERE (probability_up >= 0.5e0) <> (up = 1)" for k, c in _KEYS.items()) + "), g AS (SELECT kind, value, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS k FROM g) SELECT kind, value, n FROM r WHERE k <= 10")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    m = scored(spark, d).where((F.col("probability_up") >= 0.5) != (F.col("up") == 1))
    u = m.select(F.explode(F.create_map(*[x for k, c in _KEYS.items() for x in (F.lit(k), F.col(c))])).alias("kind", "value"))
    return E.top_k(u.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")), ["kind"], [F.desc("n"), F.col("value")], 10).select("kind", "value", "n")


@query("agg35_failure_cache", M.with_views("decisions") + "SELECT symbol, count(*) AS failures, arg_max(endpoint, row(ts, seq)) AS last_reason, max(ts) AS last_ts, count(*) >= 2 AS rejected FROM decisions WHERE seq % 40 = 7 GROUP BY 1")
def failure_cache(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).where("seq % 40 = 7").groupBy("symbol").agg(F.count(F.lit(1)).alias("failures"), F.max_by("endpoint", F.struct("ts", "seq")).alias("last_reason"), F.max("ts").alias("last_ts"), (F.count(F.lit(1)) >= 2).alias("rejected"))


@query("top02_daily_quality", _SCORED.rstrip() + ", k AS (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY probability_up DESC, symbol, seq) AS k FROM s) SELECT event_date, round(avg(r5) FILTER (k <= 3), 6) AS mean_return, round(avg(up) FILTER (k <= 3), 6) AS precision, round(count(*) FILTER (k <= 3 AND r5 > 0.03e0) / nullif(count(*) FILTER (r5 > 0.03e0), 0)::DOUBLE, 6) AS capture, round(avg(CASE WHEN r5 < -0.03e0 THEN 1e0 ELSE 0e0 END) FILTER (k <= 3), 6) AS loss_rate FROM k GROUP BY 1")
def daily_quality(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("event_date").orderBy(F.desc("probability_up"), "symbol", "seq"))
    s, top, r = scored(spark, d).withColumn("k", k), F.col("k") <= 3, F.col("ret_5")
    mean = lambda x: F.round(F.avg(F.when(top, x)), 6)
    capture = F.count(F.when(top & (r > 0.03), 1)) / F.nullif(F.count(F.when(r > 0.03, 1)), F.lit(0))
    return s.groupBy("event_date").agg(mean(r).alias("mean_return"), mean(F.col("up")).alias("precision"), F.round(capture, 6).alias("capture"), mean((r < -0.03).cast("double")).alias("loss_rate"))


@query("top03_ranking_backtests", _SCORED.rstrip() + """, k AS (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY probability_up DESC, symbol, seq) AS k FROM s), t AS (SELECT unnest([1, 3, 5]) AS top), e AS (SELECT top, event_date, greatest(-0.99e0, sum(r5) * 0.1e0) AS r FROM k, t WHERE k <= top GROUP BY 1, 2),
w AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY top ORDER BY event_date)) AS equity FROM e), g AS (SELECT *, equity / greatest(1e0, max(equity) OVER (PARTITION BY top ORDER BY event_date)) - 1 AS dd FROM w)
SELECT CAST(top AS INTEGER) AS top, count(*) AS days, round(exp(sum(ln(1 + r))) - 1, 5) AS total, round(min(dd), 5) AS drawdown, round(exp(sum(ln(1 + r))) - 1 + min(dd), 5) AS objective FROM g GROUP BY 1""")  # fmt: skip
def ranking_backtests(spark: SparkSession, d: str) -> DataFrame:
    """Top 1, 3 and 5 of each day at a tenth of the capital each, compounded over days; one series for each."""
    k = F.row_number().over(Window.partitionBy("event_date").orderBy(F.desc("probability_up"), "symbol", "seq"))
    s = scored(spark, d).withColumn("k", k).where("k <= 5").withColumn("top", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("k <= top")
    e = s.groupBy("top", "event_date").agg(F.greatest(F.lit(-0.99), F.sum("ret_5") * 0.1).alias("r"))
    w = Window.partitionBy("top").orderBy("event_date")
    g = e.withColumn("equity", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("dd", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)
    total = F.exp(F.sum(F.log1p("r"))) - 1
    return g.groupBy("top").agg(F.count(F.lit(1)).alias("days"), F.round(total, 5).alias("total"), F.round(F.min("dd"), 5).alias("drawdown"), F.round(total + F.min("dd"), 5).alias("objective"))


@query("win22_compounded_drawdown", M.with_views("bars", more="r AS (SELECT symbol, bar_date, CASE WHEN lag(close_px) OVER w IS NOT NULL THEN greatest(close_px / lag(close_px) OVER w - 1, -0.999e0) END AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)), e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY bar_date)) AS equity FROM r WHERE r IS NOT NULL), g AS (SELECT *, equity / greatest(1e0, max(equity) OVER (PARTITION BY symbol ORDER BY bar_date)) - 1 AS dd FROM e)") + "SELECT symbol, round(min(dd), 6) AS drawdown FROM g GROUP BY 1")
def compounded_drawdown(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    r = M.bars(spark, d).select("symbol", "bar_date", F.greatest(W.lagged_return("close_px", 1, w), F.when(F.lag("close_px").over(w).isNotNull(), -0.999)).alias("r")).where("r is not null")
    e = r.withColumn("equity", F.exp(F.sum(F.log1p("r")).over(w)))
    g = e.withColumn("dd", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)
    return g.groupBy("symbol").agg(F.round(F.min("dd"), 6).alias("drawdown"))


_PWEIGHT = "CASE CAST(substring(publisher, 4) AS INT) % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.88e0 ELSE 0.75e0 END"


@query("jon08_news_weights", M.with_views("decisions", "news", more=f"n AS (SELECT *, {_PWEIGHT} AS w, CASE WHEN contains(lower(title), 'ering') THEN 1e0 ELSE -1e0 END AS tone FROM news)") + "SELECT d.seq, count(n.doc_id) AS n_72, count(n.doc_id) FILTER (n.published_ts > d.ts - 86400) AS n_24, round(avg(w), 6) AS mean_weight, round(avg(tone), 6) AS mean_tone, round(sum(w * tone) / sum(w), 6) AS weighted_tone FROM decisions d LEFT JOIN n ON n.symbol = d.symbol AND n.published_ts <= d.ts AND n.published_ts > d.ts - 259200 GROUP BY 1")
def news_weights(spark: SparkSession, d: str) -> DataFrame:
    w, tone = F.round(F.expr(_PWEIGHT) * 100).cast("long"), F.when(F.contains(F.lower("title"), F.lit("ering")), 1).otherwise(-1)
    n = M.news(spark, d).select("symbol", "published_ts", F.lit(1).alias("n"), w.alias("w"), tone.alias("tone"), (w * tone).alias("both"))  # weights in hundredths, so totals are exact
    t = A.interval_totals(M.decisions(spark, d).select("seq", "symbol", "ts"), n, "symbol", "ts", "published_ts", ["seq"], ["n", "w", "tone", "both"], {"72": 259200, "24": 86400})
    each = lambda a, b: F.round(F.try_divide(a, b), 6)
    return t.select("seq", "n_72", "n_24", each(F.col("w_72") / 100, F.col("n_72")).alias("mean_weight"), each(F.col("tone_72"), F.col("n_72")).alias("mean_tone"), each(F.col("both_72"), F.col("w_72")).alias("weighted_tone"))


@query("flt04_calibration_rows", _SCORED.rstrip() + " SELECT seq, greatest(1e-6, least(1 - 1e-6, probability_up)) AS predicted, CAST(up AS INTEGER) AS observed FROM s")
def calibration_rows(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("seq", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("probability_up"))).alias("predicted"), F.col("up").cast("int").alias("observed"))


@query("top15_recent_bars", M.with_views("bars", more="k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS k FROM bars)") + "SELECT symbol, bar_date, round(close_px, 6) AS close_px, 'lineitem' AS source, CASE WHEN k = 1 THEN 'latest' ELSE 'history' END AS tag FROM k WHERE k <= 30")
def recent_bars(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_date")))
    return M.bars(spark, d).withColumn("k", k).where("k <= 30").select("symbol", "bar_date", F.round("close_px", 6).alias("close_px"), F.lit("lineitem").alias("source"), F.when(F.col("k") == 1, "latest").otherwise("history").alias("tag"))
