"""Queries of whole suites of models: backtests with gates and frontiers, scopes, shadow candidates, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import suite as S
from ..operators import thresholds as T
from ..sources.files import stored
from .evaluation_queries import _SCORED, scored
from .registry import query

FEATURES = ["p", "buy", "quick", "hour"]
#: model, model_type, candidate_lane, family, slope, threshold, intercept and the weights of FEATURES.
SUITE = [
    ("always-up", "baseline_classifier", "decision", "", 1.0, 0.5, 35.0, 0.0, 0.0, 0.0, 0.0),
    ("linear-a", "logistic_regression", "decision", "", 1.0, 0.62, -1.003, 2.01, 0.1, 0.0, 0.0),
    ("linear-b", "calibrated_linear", "decision", "", 0.8, 0.51, 0.0107, -0.35, 0.21, 0.05, 0.13),
    ("linear-c", "calibrated_linear", "decision", "", -0.3, 0.55, 0.2013, 0.4, -0.3, 0.02, 0.01),
    ("ranker", "ranking_lane_linear", "ranking", "ranking_top5_model", 1.0, 0.7, -0.4011, 1.7, 0.3, -0.1, 0.0),
    ("ranker-b", "calibrated_linear", "ranking", "", 1.0, 0.6, 0.1009, 0.2, 0.1, 0.2, 0.6),
    ("risk-filter", "two_stage_risk_filter", "decision", "", 1.0, 0.8, -0.7003, 2.3, 0.0, 0.0, 0.11),
    ("abstainer", "abstention_linear", "decision", "", 1.0, 0.999, 0.0001, 0.1, 0.0, 0.0, 0.0),
    ("stump", "decision_stump", "decision", "", 1.0, 0.66, -0.5003, 0.0, 1.9, 0.0, 0.03),
]
MODELS = "model string, model_type string, candidate_lane string, family string, slope double, threshold double, intercept double, " + ", ".join(f"w_{f} double" for f in FEATURES)


def suite_rows(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return s.select(
        "symbol", "event_date", "ts", "seq", "endpoint", "ret_5", "up", F.col("probability_up").alias("p"), F.col("action").isin("STRONG BUY", "BUY").cast("double").alias("buy"), (F.col("endpoint") == "quick_ask").cast("double").alias("quick"),
        ((F.col("ts") % 86400) / 86400).alias("hour"),
    )


def suite(spark: SparkSession, d: str) -> DataFrame:
    return S.report(suite_rows(spark, d), spark.createDataFrame(SUITE, MODELS), FEATURES, "up", "ret_5", stored=stored)


def _case(pairs: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs.items()) + f" ELSE {other} END"


_VALUES = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in m) + ")" for m in SUITE)
_SHARES = "least(floor(score * 5), 4)"
_ROWS = _SCORED.rstrip() + """, x AS (SELECT symbol, event_date, ts, seq, endpoint, r5, up, probability_up AS p, CASE WHEN action IN ('STRONG BUY', 'BUY') THEN 1e0 ELSE 0e0 END AS buy, CASE WHEN endpoint = 'quick_ask' THEN 1e0 ELSE 0e0 END AS quick, (ts % 86400) / 86400e0 AS hour FROM s)"""
_SUITE = _ROWS + f""", models(model, model_type, candidate_lane, family, slope, threshold, intercept, w1, w2, w3, w4) AS (VALUES {_VALUES}),
a AS (SELECT x.*, m.model, m.threshold, round(1 / (1 + exp(-greatest(-35e0, least(35e0, intercept + w1 * p + w2 * buy + w3 * quick + w4 * hour)))), 9) AS score FROM x, models m),
picks AS (SELECT *, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pick FROM a),
raw AS (SELECT model, count(*) AS rows, avg(CASE WHEN pick = up THEN 1e0 ELSE 0e0 END) AS accuracy, avg(pick) AS positive_rate, avg((score - up) ** 2) AS brier, coalesce(-avg(r5) FILTER (pick = 1 AND r5 < 0), 0) AS downside, sum(pick) AS picks,
  coalesce(count(*) FILTER (pick = 1 AND r5 < -0.03e0) / nullif(count(*) FILTER (r5 < -0.03e0), 0)::DOUBLE, 0) AS big_loss_rate, coalesce(count(*) FILTER (pick = 1 AND r5 >= 0.03e0) / nullif(count(*) FILTER (r5 >= 0.03e0), 0)::DOUBLE, 0) AS big_gain_capture FROM picks GROUP BY model),
bins AS (SELECT model, {_SHARES} AS bin, count(*) AS n, avg(score) AS p, avg(up) AS y FROM picks GROUP BY 1, 2), eces AS (SELECT model, sum(n * abs(p - y)) / sum(n) AS ece FROM bins GROUP BY model),
held AS (SELECT model, symbol, event_date, sum(pick) AS n FROM picks GROUP BY ALL), conc AS (SELECT model, coalesce(max(n) / nullif(sum(n), 0)::DOUBLE, 0) AS concentration FROM held GROUP BY model),
c AS (SELECT model, event_date, symbol, avg(score) AS score, CASE WHEN avg(pick) >= 0.5 THEN 1 ELSE 0 END AS pick, avg(up) AS y, avg(r5) AS ret FROM (SELECT DISTINCT model, event_date, symbol, score, pick, up, r5 FROM picks) GROUP BY 1, 2, 3),
g AS (SELECT model, event_date, avg(ret) AS universe, avg(ret) FILTER (pick = 1) AS gross, count(*) FILTER (pick = 1) AS entries, sum(ret) FILTER (pick = 1) AS total FROM c GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN entries > 0 THEN gross - 0.002e0 ELSE 0 END AS net, row_number() OVER (PARTITION BY model ORDER BY event_date) - 1 AS i FROM g),
econ AS (SELECT model, avg(net) AS net_return, avg(net - universe) AS excess_return, CAST(sum(entries) AS BIGINT) AS entries, coalesce(sum(total) / nullif(sum(entries), 0), 0) AS entry_return FROM h GROUP BY model),
k AS (SELECT *, row_number() OVER (PARTITION BY model, event_date ORDER BY round(score, 9) DESC, symbol) AS r FROM c), top AS (SELECT model, avg(ret) AS top_return, avg(CASE WHEN y >= 0.5 THEN 1e0 ELSE 0e0 END) AS top_precision, count(DISTINCT symbol) AS top_symbols FROM k WHERE r <= 5 GROUP BY model),
blk AS (SELECT model, i // 5 AS block, avg(net - universe) AS mean FROM h GROUP BY 1, 2), blks AS (SELECT *, count(*) OVER (PARTITION BY model) AS n FROM blk),
draws AS (SELECT model, r, (7919 * r + 104729 * block + (r * block) % 31) % n AS pick FROM blks, (SELECT unnest(range(500)) AS r)), means AS (SELECT d.model, r, avg(mean) AS mean FROM draws d JOIN blk ON blk.model = d.model AND blk.block = d.pick GROUP BY 1, 2),
boot AS (SELECT model, quantile_cont(mean, 0.025) AS lower, quantile_cont(mean, 0.975) AS upper, avg(CASE WHEN mean > 0 THEN 1e0 ELSE 0e0 END) AS positive FROM means GROUP BY model),
halves AS (SELECT *, row_number() OVER (ORDER BY event_date, ts, seq) <= (SELECT count(*) FROM x) // 2 AS early FROM x),
shifts AS (SELECT greatest({", ".join(f"abs(avg({f}) FILTER (NOT early) - avg({f}) FILTER (early)) / CASE WHEN stddev_pop({f}) FILTER (early) > 1e-12 THEN stddev_pop({f}) FILTER (early) ELSE 1 END" for f in FEATURES)}) AS shift FROM halves),
v AS (SELECT model, rows, entries, round(accuracy, 6) AS accuracy, round(positive_rate, 6) AS positive_rate, round(brier, 6) AS brier, round(ece, 6) AS ece, round(net_return, 6) AS net_return, round(excess_return, 6) AS excess_return, round(entry_return, 6) AS entry_return, round(downside, 6) AS downside,
  round(big_loss_rate, 6) AS big_loss_rate, round(big_gain_capture, 6) AS big_gain_capture, CAST(picks AS BIGINT) AS picks, round(concentration, 6) AS concentration, round(top_return, 6) AS top_return, round(top_precision, 6) AS top_precision, top_symbols, round(lower, 6) AS lower, round(upper, 6) AS upper, round(positive, 6) AS positive,
  models.model_type, models.slope, CASE WHEN candidate_lane = 'ranking' OR family = 'ranking_top5_model' THEN 'ranking' ELSE 'decision' END AS lane, shift
  FROM raw JOIN eces USING (model) JOIN conc USING (model) JOIN econ USING (model) JOIN top USING (model) JOIN boot USING (model) JOIN models USING (model), shifts),
z AS (SELECT *, CASE WHEN lane = 'ranking' OR model_type = 'ranking_lane_linear' THEN 'ranking_only_candidate' WHEN model_type IN ('decision_stump', 'shallow_decision_tree', 'hard_example_linear') THEN 'research_only'
  WHEN model_type IN ('two_stage_risk_filter', 'abstention_linear') THEN 'high_conviction_overlay_candidate' WHEN model_type IN ('logistic_regression', 'calibrated_linear') THEN 'main_decision_candidate' ELSE 'not_usable' END AS scope FROM v),
lim(scope, low, high, loss) AS (VALUES ('main_decision_candidate', 0.02e0, 0.6e0, 0.02e0), ('high_conviction_overlay_candidate', 0.005e0, 0.25e0, 0.01e0), ('ranking_only_candidate', 0e0, 1e0, 0.05e0), ('research_only', 0e0, 1e0, 1e0), ('not_usable', 0e0, 1e0, 1e0)),
i AS (SELECT z.*, concat_ws(',', CASE WHEN big_loss_rate > lim.loss THEN 'big_loss_prediction_rate_above_scope_limit' END, CASE WHEN lower < 0 THEN 'bootstrap_profit_confidence_failed' END, CASE WHEN ece > 0.2 THEN 'calibration_gate_failed' END,
  CASE WHEN slope < 0 THEN 'calibration_invalid_negative_slope' END, 'drawdown_evidence_unavailable', CASE WHEN shift > 3 THEN 'drift_gate_failed' END, CASE WHEN rows < 20 THEN 'insufficient_rows' END, CASE WHEN scope <> 'main_decision_candidate' THEN 'not_main_decision_candidate' END,
  CASE WHEN positive_rate > lim.high THEN 'positive_rate_above_scope_maximum' END, CASE WHEN positive_rate < lim.low THEN 'positive_rate_below_scope_minimum' END, CASE WHEN picks < 10 AND scope = 'main_decision_candidate' THEN 'selected_trade_count_too_small' END,
  CASE WHEN excess_return < 0 THEN 'underperforms_aligned_universe_after_costs' END) AS issues FROM z JOIN lim USING (scope)),
f AS (SELECT *, CASE WHEN lane = 'ranking' THEN top_return ELSE net_return END AS fit, CASE WHEN lane = 'ranking' THEN 0 ELSE -brier END AS err, row_number() OVER (ORDER BY top_return DESC, excess_return DESC, net_return DESC, ece, model) AS rank FROM i),
q AS (SELECT model, rows, entries, accuracy, positive_rate, brier, ece, net_return, excess_return, entry_return, downside, big_loss_rate, big_gain_capture, picks, concentration, top_return, top_precision, top_symbols, lower, upper, positive, lane, scope, issues, false AS ready,
  model_type <> 'baseline_classifier' AND NOT EXISTS (SELECT 1 FROM f o WHERE o.lane = f.lane AND o.model <> f.model AND o.model_type <> 'baseline_classifier' AND o.lower >= f.lower AND o.fit >= f.fit AND o.err >= f.err AND o.big_loss_rate <= f.big_loss_rate
    AND (o.lower > f.lower OR o.fit > f.fit OR o.err > f.err OR o.big_loss_rate < f.big_loss_rate)) AS retained, CAST(rank AS INTEGER) AS rank FROM f),
suite AS (SELECT *, retained AND scope IN ('research_only', 'ranking_only_candidate', 'high_conviction_overlay_candidate') AS shadow FROM q)
"""


@query("evl06_suite", _SUITE + "SELECT * FROM suite")
def suite_report(spark: SparkSession, d: str) -> DataFrame:
    return suite(spark, d)


@query("flt11_shadow_candidates", _SUITE + "SELECT model, rank, scope FROM suite WHERE shadow AND model <> 'stump' ORDER BY rank LIMIT 3")
def shadow_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.promising(suite(spark, d), ["stump"]).select("model", "rank", "scope")


@query("flt14_scopes", _SUITE + "SELECT model, lane, scope, low AS min_positive_rate, high AS max_positive_rate, loss AS max_big_loss_rate, positive_rate BETWEEN low AND high AND big_loss_rate <= loss AS within FROM suite JOIN lim USING (scope)")
def scopes(spark: SparkSession, d: str) -> DataFrame:
    s = suite(spark, d).withColumn("l", S.scope_limits(F.col("scope")))
    within = F.col("positive_rate").between(F.col("l.min_positive_rate"), F.col("l.max_positive_rate")) & (F.col("big_loss_rate") <= F.col("l.max_big_loss_rate"))
    return s.select("model", "lane", "scope", "l.*", within.alias("within"))


#: Cells of (window, symbol, step) as SQL, and every threshold's measures from them.
_STEP = " + ".join(f"CASE WHEN probability_up >= {t}e0 THEN 1 ELSE 0 END" for t in T.THRESHOLDS)
_GRID = _SCORED.rstrip() + f""", w AS (SELECT *, CAST(ntile(3) OVER (ORDER BY event_date, seq) AS INTEGER) AS wnd FROM s), w2 AS (SELECT * FROM w UNION ALL BY NAME SELECT * REPLACE (0 AS wnd) FROM w),
th AS (SELECT unnest(range(1, {len(T.THRESHOLDS) + 1})) AS step, unnest([{", ".join(f"{t}e0" for t in T.THRESHOLDS)}]) AS threshold),
m0 AS (SELECT wnd, step, threshold, count(*) FILTER (hit) AS picks, avg(r5) FILTER (hit) - avg(greatest(-r5, 0)) FILTER (hit) - avg(CASE WHEN r5 < -0.03e0 THEN 1e0 ELSE 0e0 END) FILTER (hit) + 0.1e0 * coalesce(count(*) FILTER (hit AND r5 >= 0.03e0) / nullif(count(*) FILTER (r5 >= 0.03e0), 0)::DOUBLE, 0) AS utility,
  count(*) FILTER (hit AND r5 < -0.03e0) AS losses, coalesce(count(*) FILTER (hit AND r5 < -0.03e0) / nullif(count(*) FILTER (r5 < -0.03e0), 0)::DOUBLE, 0) AS loss_rate, coalesce(count(*) FILTER (hit AND r5 >= 0.03e0) / nullif(count(*) FILTER (r5 >= 0.03e0), 0)::DOUBLE, 0) AS capture
  FROM (SELECT *, probability_up >= threshold AS hit FROM w2, th) GROUP BY ALL),
sy AS (SELECT wnd, step, symbol, count(*) AS n FROM w2, th WHERE probability_up >= threshold GROUP BY ALL), sc AS (SELECT wnd, step, max(n) / sum(n)::DOUBLE AS concentration FROM sy GROUP BY ALL),
m1 AS (SELECT m0.*, coalesce(concentration, 0) AS concentration FROM m0 LEFT JOIN sc USING (wnd, step))
"""
_BROKEN = """, gd AS (SELECT m1.*, n.utility AS now_utility, concat_ws(',', CASE WHEN m1.losses > 0 AND m1.losses > n.losses THEN 'big_losses' END, CASE WHEN m1.loss_rate > n.loss_rate THEN 'big_loss_rate' END, CASE WHEN m1.capture < 0.1e0 THEN 'big_gain_capture' END,
  CASE WHEN m1.picks < greatest(10e0, 0.25e0 * n.picks) THEN 'picks' END, CASE WHEN m1.concentration > 0.5e0 THEN 'concentration' END) AS broken FROM m1 JOIN m1 n ON n.wnd = m1.wnd AND n.step = {0}),
ab AS (SELECT *, max(utility) OVER (PARTITION BY wnd) AS best FROM gd WHERE broken = '' AND utility IS NOT NULL), nr AS (SELECT *, step - row_number() OVER (PARTITION BY wnd ORDER BY step) AS run FROM ab WHERE utility >= best - {1}e0),
ru AS (SELECT wnd, run, count(*) AS width, max(utility) AS top, list(step ORDER BY step) AS steps, any_value(now_utility) AS now FROM nr GROUP BY 1, 2), rb AS (SELECT *, steps[(width - 1) // 2 + 1] AS mid FROM (SELECT *, row_number() OVER (PARTITION BY wnd ORDER BY width DESC, top DESC, run) AS r FROM ru) WHERE r = 1),
ch AS (SELECT x.wnd, CASE WHEN rb.wnd IS NULL OR list_contains(steps, {0}) OR coalesce(now, -1e300) >= m1.utility THEN {0} ELSE mid END AS step FROM (SELECT DISTINCT wnd FROM m1) x LEFT JOIN rb USING (wnd) LEFT JOIN m1 ON m1.wnd = rb.wnd AND m1.step = rb.mid),
ct AS (SELECT ch.wnd, ch.step, threshold FROM ch JOIN th USING (step))"""


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    rows = T.row_windows(scored(spark, d), "event_date", ["seq"], 3)
    return stored(rows.select("window", "symbol", "event_date", "probability_up", "ret_5"), "threshold-rows")


@query("evl16_threshold_windows", _GRID + _BROKEN.format(7, 0.02) + "SELECT CAST(wnd AS INTEGER) AS wnd, threshold, picks, round(utility, 6) AS utility, losses, round(capture, 6) AS capture, round(concentration, 6) AS concentration, broken FROM gd")
def threshold_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every threshold in every window from one histogram, with the guardrails it breaks beside the highest one."""
    g = T.guarded(T.grid(T.cells(_windowed(spark, d), "probability_up", "ret_5")), 7)
    return g.select(F.col("window").alias("wnd"), "threshold", "picks", F.round("utility", 6).alias("utility"), "losses", F.round("capture", 6).alias("capture"), F.round("concentration", 6).alias("concentration"), "broken")


_CHOICE = """, su AS (SELECT count(DISTINCT event_date) AS dates, count(DISTINCT symbol) AS symbols, count(*) FILTER (r5 >= 0.03e0) AS gains FROM s),
sp AS (SELECT picks >= 10 AND gains >= 10 AND dates >= 5 AND symbols >= 5 AND capture > 0 AND coalesce(utility, -1) >= {2} AND concentration <= 0.5 AS supported FROM su, m1 WHERE wnd = 0 AND step = {0}),
be AS (SELECT supported, CASE WHEN supported THEN ct.step ELSE {0} END AS best_step FROM sp, ct WHERE wnd = 0), bt AS (SELECT be.*, th.threshold AS best FROM be JOIN th ON th.step = be.best_step),
fw AS (SELECT count(*) AS evaluated, bool_and(broken = '' AND coalesce(utility > now_utility, false)) AS all_win FROM gd, bt WHERE wnd > 0 AND gd.step = best_step),
st AS (SELECT max(threshold) AS high, min(threshold) AS low, count(*) AS k, count(*) FILTER (abs(threshold - best) <= 0.025e0 + 1e-9) AS agree FROM ct, bt WHERE wnd > 0),
fi AS (SELECT (SELECT threshold FROM th WHERE step = {0}) AS cur, best, supported, best_step <> {0} AND evaluated >= 2 AND all_win AS consistent, best_step <> {0} AND k >= 2 AND high - low <= 0.05e0 + 1e-9 AND agree >= greatest(2, ceil(k * 2 / 3e0)) AS stable, evaluated FROM bt, fw, st)
SELECT cur AS current, best, supported, consistent, stable, evaluated, CASE WHEN consistent AND stable THEN best ELSE cur END AS recommended FROM fi"""


@query("evl16_recommendation", _GRID + _BROKEN.format(3, 0.002) + _CHOICE.format(3, 0.002, 0))
def threshold_recommendation(spark: SparkSession, d: str) -> DataFrame:
    rows = _windowed(spark, d)
    return T.recommendation(rows, stored(T.cells(rows, "probability_up", "ret_5"), "threshold-cells"), 3)
