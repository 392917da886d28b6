"""Queries of research sweeps over lattices of decision rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sweeps as R
from ..sources.files import stored
from .evaluation_queries import _SCORED, scored
from .registry import query

_LIST = {name: "[" + ", ".join(f"{float(v)}e0" for v in values) + "]" for name, values in (("t", R.THRESHOLDS), ("m", R.MARGINS), ("l", R.LAMBDAS))}
_SUM = "count(*) FILTER ({0}) AS n, sum(weight * r5) FILTER ({0}) / sum(weight) FILTER ({0}) AS mean_return, coalesce(count(*) FILTER ({0} AND r5 < -0.03e0) / nullif(count(*) FILTER (r5 < -0.03e0), 0)::DOUBLE, 0) AS loss_rate, coalesce(count(*) FILTER ({0} AND r5 >= 0.03e0) / nullif(count(*) FILTER (r5 >= 0.03e0), 0)::DOUBLE, 0) AS capture, \
sum(weight * (r5 - greatest(-r5, 0) - CASE WHEN r5 < -0.03e0 THEN 1 ELSE 0 END)) FILTER ({0}) / sum(weight) FILTER ({0}) + 0.1e0 * coalesce(count(*) FILTER ({0} AND r5 >= 0.03e0) / nullif(count(*) FILTER (r5 >= 0.03e0), 0)::DOUBLE, 0) AS utility"
_LATTICE = _SCORED.rstrip() + f""", y AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY symbol, event_date, endpoint, decision_source) AS weight, probability_up AS p, ((ts + seq * 13) % 1000) / 1000e0 AS risk, ((ts + seq * 29) % 997) / 997e0 AS gain, ts % 3 <> 0 AS regime FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY p DESC, seq) AS rp, row_number() OVER (PARTITION BY event_date ORDER BY gain DESC, seq) AS rg, greatest(0e0, least(1e0, p + CASE WHEN regime THEN 0.05e0 ELSE -0.05e0 END)) AS moved FROM y),
t AS (SELECT unnest({_LIST["t"]}) AS threshold), k AS (SELECT unnest([1, 3, 5]) AS top_k),
pts AS (SELECT 'overlay' AS family, threshold, second, top_k, {_SUM.format("rp <= top_k AND p >= threshold + second")} FROM z, t, (SELECT unnest({_LIST["m"]}) AS second), k GROUP BY ALL
  UNION ALL SELECT 'ranker', NULL, 0e0, top_k, {_SUM.format("rg <= top_k")} FROM z, k GROUP BY top_k
  UNION ALL SELECT 'filter', threshold, second, 0, {_SUM.format("p - second * risk >= threshold")} FROM z, t, (SELECT unnest({_LIST["l"]}) AS second) GROUP BY threshold, second
  UNION ALL SELECT 'regime', t.threshold, u.threshold, 0, {_SUM.format("moved >= CASE WHEN regime THEN t.threshold ELSE u.threshold END")} FROM z, t, t u WHERE t.threshold <> u.threshold GROUP BY t.threshold, u.threshold),
best AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(utility, 9) DESC NULLS LAST, threshold, second, top_k) = 1 AS best FROM pts)
"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    s = R.duplicate_weights(scored(spark, d))
    rows = s.select("event_date", "seq", "ret_5", "weight", F.col("probability_up").alias("p"), ((F.col("ts") + F.col("seq") * 13) % 1000 / 1000).alias("risk"), ((F.col("ts") + F.col("seq") * 29) % 997 / 997).alias("gain"), (F.col("ts") % 3 != 0).alias("regime"))
    return stored(rows, "sweep-rows")


def _points(rows: DataFrame) -> DataFrame:
    return R.sweep(rows, "p", "risk", "gain", "regime", "ret_5", "seq")


@query("ml15_sweep", _LATTICE + "SELECT family, threshold, second, top_k, n, round(mean_return, 6) AS mean_return, round(loss_rate, 6) AS loss_rate, round(capture, 6) AS capture, round(utility, 6) AS utility, best FROM best")
def research_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every point of four families of rules, measured on all decisions."""
    p = _points(_rows(spark, d))
    return p.select(*R.POINT, "n", *(F.round(c, 6).alias(c) for c in ("mean_return", "loss_rate", "capture", "utility")), "best")


@query("evl19_research_gates", _LATTICE + f""", now AS (SELECT {_SUM.format("p >= 0.55e0")} FROM z)
SELECT family, concat_ws(',', CASE WHEN b.n < 10 OR coalesce(b.mean_return, 0) <= 0 OR b.capture <= 0 THEN 'support' END, CASE WHEN coalesce(b.mean_return <= now.mean_return, true) THEN 'return' END, CASE WHEN coalesce(b.utility <= now.utility, true) THEN 'utility' END,
  CASE WHEN b.loss_rate > now.loss_rate AND b.mean_return < now.mean_return + 0.02e0 THEN 'big_losses' END) AS failed, NOT (b.n < 10 OR coalesce(b.mean_return, 0) <= 0 OR b.capture <= 0 OR coalesce(b.mean_return <= now.mean_return, true) OR coalesce(b.utility <= now.utility, true) OR (b.loss_rate > now.loss_rate AND b.mean_return < now.mean_return + 0.02e0)) AS research_winner FROM best b, now WHERE best""")
def research_winners(spark: SparkSession, d: str) -> DataFrame:
    """Each family's best point beside a plain threshold of 0.55 on the same decisions."""
    rows = _rows(spark, d)
    hit, r, w = F.col("p") >= 0.55, F.col("ret_5"), F.col("weight")
    share = lambda c: F.coalesce(F.try_divide(F.count(F.when(hit & c, 1)), F.count(F.when(c, 1))), F.lit(0.0))
    mean = lambda x: F.try_divide(F.sum(F.when(hit, w * x)), F.sum(F.when(hit, w)))
    capture = share(r >= 0.03)
    now = rows.agg(mean(r).alias("mean_return"), share(r < -0.03).alias("loss_rate"), (mean(r - F.greatest(-r, F.lit(0.0)) - (r < -0.03).cast("int")) + 0.1 * capture).alias("utility"))
    return R.research_gates(stored(_points(rows), "sweep-points"), now)
