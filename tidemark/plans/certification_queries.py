"""Queries of validation reports, of the hygiene of periods, of what drove wrong calls, and of index cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import windows as W
from ..operators import diagnostics as G
from ..operators import validation as V
from ..sources import market as M
from ..sources.files import stored
from .desk_queries import _PERIODS, periods, purged_periods
from .evaluation_queries import judged
from .join_queries import _FORWARD
from .registry import query
from .suite_queries import _ROWS, suite_rows
from .window_queries import _W

_NAMES = (
    "evaluated_rows", "brier_score", "calibration_error", "calibration_rows", "buy_precision", "buy_recall", "sell_precision", "sell_recall", "avg_return", "avg_underlying_return", "avg_net_return", "worst_return",
    "avg_max_adverse_excursion", "worst_max_adverse_excursion", "profile_override_rate", "stale_data_rate", "fallback_rate", "recommendation_churn_rate",
)
_BUYS, _WAITS = "action IN ('STRONG BUY', 'BUY')", "action IN ('SELL', 'HOLD OFF FOR NOW')"
_SHARE = "round({0} / nullif({1}, 0)::DOUBLE, 6)"
_REPORT = M.with_views("bars", "decisions", more=_FORWARD + f""", r AS (SELECT seq, symbol, ts, action, model_version AS version, e5 / entry - 1 AS ret, CASE WHEN probability_up IS NOT NULL THEN least(probability_up * CASE WHEN seq % 5 = 0 THEN 100 ELSE 1 END, 100) END AS probability, CASE WHEN seq % 3 > 0 THEN seq % 3 * 5e0 END AS cost, CASE WHEN e1 / entry - 1 < 0 THEN e1 / entry - 1 END AS adverse,
  CASE decision_source WHEN 'hybrid' THEN 'delayed_fallback' WHEN 'model' THEN 'live' ELSE 'unknown' END AS mode, endpoint AS profile, seq % 29 = 0 AS stale, seq % 37 = 0 AS degraded, CASE WHEN seq % 17 = 0 THEN 'BUY' WHEN seq % 2 = 0 THEN action ELSE '' END AS base FROM o),
e AS (SELECT *, {_WAITS} AS waits, CASE WHEN {_WAITS} THEN -ret ELSE ret END AS dir, CASE WHEN probability > 1 THEN probability / 100 ELSE probability END AS p, CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END AS up FROM r WHERE ret IS NOT NULL AND ({_BUYS} OR {_WAITS})),
c AS (SELECT version, count(*) FILTER (last IS NOT NULL) AS t, count(*) FILTER (last <> action) AS ch FROM (SELECT version, action, lag(action) OVER (PARTITION BY version, symbol ORDER BY ts, seq) AS last FROM e) GROUP BY 1),
bins AS (SELECT version, least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS mp, avg(up) AS mu FROM e WHERE p IS NOT NULL GROUP BY 1, 2), ece AS (SELECT version, round(sum(n * abs(mp - mu)) / sum(n), 6) AS calibration_error FROM bins GROUP BY 1),
m AS (SELECT version, count(*) AS evaluated_rows, round(avg((p - up) ** 2), 6) AS brier_score, count(p) AS calibration_rows, {_SHARE.format('count(*) FILTER (NOT waits AND ret > 0)', 'count(*) FILTER (NOT waits)')} AS buy_precision, {_SHARE.format('count(*) FILTER (NOT waits AND ret > 0)', 'count(*) FILTER (ret > 0)')} AS buy_recall,
  {_SHARE.format('count(*) FILTER (waits AND ret <= 0)', 'count(*) FILTER (waits)')} AS sell_precision, {_SHARE.format('count(*) FILTER (waits AND ret <= 0)', 'count(*) FILTER (ret <= 0)')} AS sell_recall, round(avg(dir), 6) AS avg_return, round(avg(ret), 6) AS avg_underlying_return, round(avg(dir - coalesce(cost, 0) / 10000), 6) AS avg_net_return,
  round(min(dir), 6) AS worst_return, round(avg(adverse), 6) AS avg_max_adverse_excursion, round(min(adverse), 6) AS worst_max_adverse_excursion, {_SHARE.format("count(*) FILTER (base <> '' AND base <> action)", 'count(*)')} AS profile_override_rate, {_SHARE.format('count(*) FILTER (stale)', 'count(*)')} AS stale_data_rate,
  {_SHARE.format("count(*) FILTER (degraded OR mode = 'delayed_fallback')", 'count(*)')} AS fallback_rate FROM e GROUP BY 1),
a AS (SELECT m.*, calibration_error, coalesce({_SHARE.format('ch', 't')}, 0) AS recommendation_churn_rate FROM m JOIN ece USING (version) JOIN c USING (version)), x AS (SELECT * FROM a WHERE version = 'v2-5d'), y AS (SELECT * FROM a WHERE version = 'v1-5d'),
gates AS (SELECT 'minimum_evaluated_rows' AS name, evaluated_rows::DOUBLE AS value, 30e0 AS lim, evaluated_rows >= 30 AS passed, 'blocker' AS severity FROM x UNION ALL SELECT 'calibration_brier', x.brier_score, 0.26e0, x.brier_score <= 0.26e0 AND x.brier_score <= y.brier_score + 0.01e0, 'blocker' FROM x, y
  UNION ALL SELECT 'average_net_return', avg_net_return, 0e0, avg_net_return >= 0, 'blocker' FROM x UNION ALL SELECT 'recommendation_churn', recommendation_churn_rate, 0.35e0, recommendation_churn_rate <= 0.35e0, 'blocker' FROM x UNION ALL SELECT 'stale_data_rate', stale_data_rate, 0.05e0, stale_data_rate <= 0.05e0, 'blocker' FROM x
  UNION ALL SELECT 'fallback_rate', fallback_rate, 0.2e0, fallback_rate <= 0.2e0, 'blocker' FROM x UNION ALL SELECT 'adverse_excursion_regression', x.worst_max_adverse_excursion, y.worst_max_adverse_excursion, x.worst_max_adverse_excursion >= y.worst_max_adverse_excursion - 0.02e0, 'blocker' FROM x, y
  UNION ALL SELECT 'licensing_review', 1e0, 1e0, true, 'blocker' UNION ALL SELECT 'privacy_review', 0e0, 1e0, false, 'blocker'),
k AS (SELECT * FROM e WHERE version = 'v2-5d')""")  # fmt: skip


@query("evl13_validation_report", _REPORT + " UNION ALL ".join(f"SELECT 'metric' AS section, '{n}' AS name, {n}::DOUBLE AS value, NULL::DOUBLE AS lim, NULL::BOOLEAN AS passed, NULL::VARCHAR AS severity FROM x" for n in _NAMES)
    + """ UNION ALL SELECT 'by_source_mode', mode, count(*)::DOUBLE, NULL, NULL, NULL FROM k GROUP BY mode UNION ALL SELECT 'by_profile', profile, count(*)::DOUBLE, NULL, NULL, NULL FROM k GROUP BY profile UNION ALL SELECT 'gate', name, value, lim, passed, severity FROM gates
UNION ALL SELECT 'recommendation', CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'promote' ELSE 'hold_shadow' END, count(*) FILTER (NOT passed)::DOUBLE, NULL, NULL, NULL FROM gates""")  # fmt: skip
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """The second model version against the first: metrics, counts, gates and what follows from them."""
    seq, early = F.col("seq"), F.col("ret_1")
    p = F.least(F.col("probability_up") * F.when(seq % 5 == 0, 100).otherwise(1), F.lit(100.0))
    rows = judged(spark, d).select(
        "seq", "symbol", "ts", "action", F.col("model_version").alias("version"), F.col("ret_5").alias("ret"), F.when(F.col("probability_up").isNotNull(), p).alias("probability"), F.when(seq % 3 > 0, (seq % 3) * 5.0).alias("cost_bps"), F.when(early < 0, early).alias("adverse"),
        F.when(F.col("decision_source") == "hybrid", "delayed_fallback").when(F.col("decision_source") == "model", "live").alias("source_mode"), F.col("endpoint").alias("profile"), (seq % 29 == 0).alias("is_stale"), (seq % 37 == 0).alias("is_degraded"),
        F.when(seq % 17 == 0, "buy").when(seq % 2 == 0, F.col("action")).alias("base_action"),
    )
    return V.report(rows, "version", "v2-5d", "v1-5d", {"licensing_review": True, "privacy_review": False}, stored)


_CLEAN = _PERIODS.rstrip() + """, q AS (SELECT period, min(event_date) AS start FROM p GROUP BY 1), z AS (SELECT p.event_date, p.period FROM p LEFT JOIN q a ON a.period = p.period LEFT JOIN q b ON b.period = p.period + 1 WHERE (p.period = 0 OR p.event_date >= a.start + 1) AND (b.start IS NULL OR p.event_date < b.start - 5)),
s AS (SELECT 'days' AS split, p.period, d.* FROM decisions d JOIN p USING (event_date) UNION ALL SELECT 'purged', z.period, d.* FROM decisions d JOIN z USING (event_date) UNION ALL SELECT 'mixed', CASE WHEN d.seq % 7 = 0 AND p.period < 3 THEN p.period + 1 ELSE p.period END, d.* FROM decisions d JOIN p USING (event_date) UNION ALL SELECT 'empty', CASE WHEN p.period = 1 THEN 0 ELSE p.period END, d.* FROM decisions d JOIN p USING (event_date)),
w AS (SELECT split, """ + ", ".join(f"count(*) FILTER (period = {i}) AS rows_{n}, min(event_date) FILTER (period = {i}) AS s{i}, max(event_date) FILTER (period = {i}) AS e{i}" for i, n in enumerate(V.PERIODS)) + """ FROM s GROUP BY 1),
dd AS (SELECT split, event_date, list(DISTINCT period) AS l FROM s GROUP BY 1, 2), pp AS (SELECT split, event_date, symbol, list(DISTINCT period) AS l FROM s GROUP BY 1, 2, 3),
ov AS (SELECT split, """ + ", ".join(f"count(*) FILTER (list_contains(l, {i}) AND list_contains(l, {i + 1})) AS d{i}" for i in range(3)) + " FROM dd GROUP BY 1), po AS (SELECT split, " + ", ".join(f"count(*) FILTER (list_contains(l, {i}) AND list_contains(l, {i + 1})) AS p{i}" for i in range(3)) + """ FROM pp GROUP BY 1),
f AS (SELECT split, count(*) AS n, avg(CASE WHEN action IN ('STRONG BUY', 'BUY') THEN 1e0 ELSE 0e0 END) AS buys FROM s WHERE period = 0 GROUP BY 1), g AS (SELECT * FROM f WHERE split = 'days'),
j AS (SELECT w.*, (CASE WHEN d0 > 0 THEN 1 ELSE 0 END + CASE WHEN d1 > 0 THEN 1 ELSE 0 END + CASE WHEN d2 > 0 THEN 1 ELSE 0 END) AS shared_days, (CASE WHEN p0 > 0 THEN 1 ELSE 0 END + CASE WHEN p1 > 0 THEN 1 ELSE 0 END + CASE WHEN p2 > 0 THEN 1 ELSE 0 END) AS shared_pairs,
  (CASE WHEN s1 - e0 > 5 THEN 0 ELSE 1 END + CASE WHEN s2 - e1 > 5 THEN 0 ELSE 1 END + CASE WHEN s3 - e2 > 5 THEN 0 ELSE 1 END) AS short_gaps, coalesce(e0 < s1 AND e1 < s2 AND e2 < s3, false) AS split_ok, f.n = g.n AND abs(f.buys - g.buys) <= 1e-9 AS reproduced FROM w JOIN ov USING (split) JOIN po USING (split) JOIN f USING (split), g)
"""


@query("evl17_split_hygiene", _CLEAN + "SELECT split, " + ", ".join(f"rows_{n}" for n in V.PERIODS) + """, shared_days, shared_pairs, short_gaps, split_ok, shared_days + shared_pairs + short_gaps = 0 AS purge_ok, reproduced,
  concat_ws(';', CASE WHEN NOT split_ok THEN 'periods missing or out of order' END, CASE WHEN shared_days + shared_pairs + short_gaps > 0 THEN 'boundaries not purged' END, CASE WHEN NOT reproduced THEN 'recipe not reproduced' END) AS issues FROM j""")  # fmt: skip
def split_hygiene(spark: SparkSession, d: str) -> DataFrame:
    """Four ways to cut the decisions: by whole days, purged, with rows that strayed into the next period, without a second one."""
    dec = M.decisions(spark, d)
    plain = periods(spark, d).select("seq", "period", "symbol", "event_date", "action")
    named = lambda df, name: df.select(F.lit(name).alias("split"), "period", "symbol", "event_date", "action")
    p = F.col("period")
    purged = purged_periods(spark, d).join(dec.select("seq", "symbol", "event_date", "action"), "seq")
    mixed = plain.withColumn("period", F.when((F.col("seq") % 7 == 0) & (p < 3), p + 1).otherwise(p))
    s = named(plain, "days").unionByName(named(purged, "purged")).unionByName(named(mixed, "mixed")).unionByName(named(plain.withColumn("period", F.when(p == 1, 0).otherwise(p)), "empty"))
    s = stored(s, "split-periods")
    fits = s.where("period = 0").groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.avg(F.col("action").isin(*D.BUY).cast("double")).alias("buys"))
    fits = fits.select("split", F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("rows", "buys")))))
    stated = fits.where("split = 'days'").select("name", F.col("value").alias("stated"))
    return V.hygiene(s, fits.withColumnRenamed("value", "rerun").join(F.broadcast(stated), "name"))  # two rows


#: feature -> mean, deviation (0 counts as 1) and weight of the candidate, and the intercepts and thresholds of both models.
ARTIFACT = {"p": (0.5, 0.29, 0.8), "buy": (0.4, 0.0, 0.35), "quick": (0.1, 0.3, -0.2), "hour": (0.5, 0.28, 0.15)}
_PARTS = {f: f"(coalesce({f}, {m}e0) - {m}e0) / {s or 1.0}e0 * {w}e0" for f, (m, s, w) in ARTIFACT.items()}


@query("ml21_error_drivers", _ROWS.rstrip() + f""", v AS (SELECT seq, symbol, event_date, ts, r5, up, CASE WHEN seq % 13 = 0 THEN NULL ELSE p END AS p, buy, quick, CASE WHEN seq % 19 = 0 THEN 'NaN'::DOUBLE ELSE hour END AS hour, p AS pp FROM x),
u AS (SELECT * REPLACE (CASE WHEN isnan(hour) THEN NULL ELSE hour END AS hour) FROM v), c AS (SELECT *, 1 / (1 + exp(-(0.1e0 + {' + '.join(_PARTS.values())}))) AS cp FROM u), e AS (SELECT * FROM c WHERE cp >= 0.5e0 AND r5 < -0.03e0),
k AS ({' UNION ALL '.join(f"SELECT seq, '{f}' AS feature, round(coalesce({f}, {m}e0), 6) AS value, {w}e0 AS weight, round({_PARTS[f]}, 6) AS contribution FROM e" for f, (m, s, w) in ARTIFACT.items())}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY abs(contribution) DESC, feature) AS rank FROM k)
SELECT e.seq, symbol, event_date, round(r5, 6) AS ret, round(cp, 6) AS candidate_probability, 1 AS candidate_call, round(pp, 6) AS production_probability, CAST(pp >= 0.5e0 AS INTEGER) AS production_call, CAST(rank AS INTEGER) AS rank, feature, value, weight, contribution FROM e JOIN ranked USING (seq) WHERE rank <= 3""")  # fmt: skip
def error_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the candidate that lost much, with both models' calls and the three features that moved the score most."""
    p, seq = F.col("p"), F.col("seq")
    rows = suite_rows(spark, d).withColumns({"production": p, "p": F.when(seq % 13 != 0, p), "hour": F.when(seq % 19 == 0, float("nan")).otherwise(F.col("hour"))})
    wrong = G.with_score(rows, ARTIFACT, 0.1, "candidate").where("candidate >= 0.5 AND ret_5 < -0.03")
    calls = {"candidate_probability": F.round("candidate", 6), "candidate_call": (F.col("candidate") >= 0.5).cast("int"), "production_probability": F.round("production", 6), "production_call": (F.col("production") >= 0.5).cast("int")}
    return wrong.select("seq", "symbol", "event_date", F.round("ret_5", 6).alias("ret"), *(c.alias(n) for n, c in calls.items()), F.inline(G.drivers(ARTIFACT, 3)))


_CARDS = M.with_views("bars", more=f"""b AS (SELECT symbol, bar_date, close_px, lag(close_px) OVER w AS before, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS k FROM bars {_W}),
s AS (SELECT symbol, list(round(close_px, 2) ORDER BY bar_date) AS series FROM b WHERE k <= 15 GROUP BY 1), n AS (SELECT max(bar_date) AS today FROM bars), i AS (SELECT CAST(substring(symbol, 2) AS BIGINT) AS id, b.*, date_diff('second', CAST(bar_date AS TIMESTAMP), CAST(today AS TIMESTAMP) + INTERVAL 20 HOUR) AS age FROM b, n WHERE k = 1),
q AS (SELECT symbol, bar_date, age, CASE WHEN id % 11 <> 0 THEN close_px END AS quoted, CASE WHEN id % 5 <> 0 THEN (close_px / before - 1) * 100 END AS pct, CASE WHEN id % 3 = 0 THEN before END AS prev FROM i),
p AS (SELECT *, CASE WHEN age <= 345600 THEN quoted END AS price FROM q), r AS (SELECT *, coalesce(prev, CASE WHEN pct <> -100 THEN price / (1 + pct / 100) END) AS close0 FROM p)""")


@query("dec14_index_cards", _CARDS + """SELECT symbol, price IS NOT NULL AS available, round(price, 2) AS price, CASE WHEN price IS NOT NULL THEN round(close0 + 1e-9, 2) END AS previous_close, CASE WHEN price IS NOT NULL THEN round(price - close0 + 1e-9, 2) END AS change,
  CASE WHEN price IS NOT NULL THEN round(coalesce(pct, (price - close0) / nullif(close0, 0) * 100) + 1e-9, 2) END AS change_percent, age::DOUBLE AS freshness_seconds, CASE WHEN price IS NULL AND age > 345600 THEN 'quote_older_than_96h' WHEN price IS NULL THEN 'missing_current_value' END AS unavailable_reason, array_to_string(series, ' ') AS series FROM r JOIN s USING (symbol)""")  # fmt: skip
def index_cards(spark: SparkSession, d: str) -> DataFrame:
    """A card for each instrument: its last quote, the close before it where it can be told, and the last fifteen closes."""
    bars = M.bars(spark, d)
    last = bars.withColumn("before", F.lag("close_px").over(W.by_symbol())).groupBy("symbol").agg(F.max_by(F.struct("close_px", "before"), "bar_date").alias("v"), F.max("bar_date").alias("bar_date")).select("symbol", "bar_date", "v.*")
    today = bars.agg(F.max("bar_date").alias("today"))
    age = (F.datediff("today", "bar_date") * 86400 + 20 * 3600).cast("double")
    q = last.crossJoin(F.broadcast(today)).withColumn("id", F.substring("symbol", 2, 12).cast("long"))  # one row
    pct = (F.col("close_px") / F.col("before") - 1) * 100
    quotes = q.select("symbol", F.when(F.col("id") % 11 != 0, F.col("close_px")).alias("price"), F.when(F.col("id") % 5 != 0, pct).alias("change_percent"), F.when(F.col("id") % 3 == 0, F.col("before")).alias("previous_close"), age.alias("age"))
    cards = G.index_cards(quotes, bars.select("symbol", F.col("bar_date").alias("at"), F.col("close_px").alias("close")))
    return cards.withColumn("series", F.array_join(F.transform("series", lambda x: x.cast("string")), " "))


_COVERED = M.with_views("decisions", more="""r AS (SELECT action AS comparison, symbol, endpoint, event_date, probability_up AS p, CASE WHEN endpoint <> 'quick_ask' AND action = 'HOLD' THEN 'n/a' ELSE CAST(seq % 97 AS VARCHAR) END AS written FROM decisions),
s AS (SELECT comparison, count(*) AS n, min(event_date) AS first_day, max(event_date) AS last_day, count(DISTINCT symbol) AS symbols, count(DISTINCT endpoint) AS endpoints, round(count(p) / count(*)::DOUBLE, 6) >= 0.8e0 AS candidate_covered, round(count(try_cast(written AS DOUBLE)) / count(*)::DOUBLE, 6) >= 0.8e0 AS w FROM r GROUP BY 1),
t AS (SELECT * EXCLUDE (w), candidate_covered AND w AS production_covered FROM s)""")


@query("evl18_comparison_scope", _COVERED + """SELECT *, CASE WHEN n < 500 THEN 'narrow_diagnostic' ELSE 'holdout-only' END AS scope, candidate_covered AND production_covered AS like_with_like, candidate_covered AND production_covered AND n >= 500 AS evidence,
  concat_ws('; ', CASE WHEN n < 500 THEN 'too few rows' END, CASE WHEN NOT production_covered THEN 'production features filled' END, CASE WHEN NOT candidate_covered THEN 'candidate features incomplete' END) AS reasons FROM t""")  # fmt: skip
def comparison_scope(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons on the decisions of each action: which of them may count as evidence for a promotion."""
    written = F.when((F.col("endpoint") != "quick_ask") & (F.col("action") == "HOLD"), "n/a").otherwise(F.pmod("seq", F.lit(97)).cast("string"))
    rows = M.decisions(spark, d).select(F.col("action").alias("comparison"), "symbol", "endpoint", "event_date", F.col("probability_up").alias("p"), written.alias("written"))
    return V.comparison_scope(rows, "comparison", ["p"], ["p", "written"], {"target": True, "horizon": True, "weights": True, "lineage": True}, 500)
