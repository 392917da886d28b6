"""Queries of audits: servable features, widening reads, the cache of splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import servability as V
from ..sources import caches as C
from ..sources import market as M
from ..sources.files import stored, work_folder
from .join_queries import _FORWARD, outcomes
from .registry import query

_DECLARED = """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size AS s FROM part),
d AS (SELECT 'f' || k AS feature, k, CASE WHEN k > 3 THEN list_distinct(['f' || (k // 2), 'f' || (k // 3)]) ELSE CAST([] AS VARCHAR[]) END AS inputs, CASE WHEN k % 41 = 0 THEN 'T+5 window' WHEN k % 37 = 0 THEN 'post_event' ELSE 'at_prediction' END AS semantics,
  k % 29 = 0 AS circular, k % 23 <> 0 AND s % 17 <> 0 AS known, k % 2 = 0 AS required FROM p),
o AS (SELECT *, CASE WHEN semantics = 'T+5 window' THEN 0 WHEN semantics = 'post_event' THEN 1 WHEN circular THEN 2 WHEN NOT known THEN 3 WHEN required THEN 4 ELSE 5 END AS own FROM d),
l AS (SELECT feature, unnest(inputs) AS input FROM d), r AS (SELECT feature, input FROM l UNION SELECT r.feature, l.input FROM r JOIN l ON l.feature = r.input),
w AS (SELECT r.feature, min(coalesce(o.own, 3)) AS worst FROM r LEFT JOIN o ON o.feature = r.input GROUP BY 1),
v AS (SELECT o.feature, own, CASE WHEN worst < 4 THEN least(own, worst) ELSE own END AS verdict FROM o LEFT JOIN w USING (feature)),
n AS (SELECT ['NON_SERVABLE_FUTURE', 'NON_SERVABLE_POST_EVENT', 'NON_SERVABLE_CIRCULAR', 'NON_SERVABLE_UNKNOWN', 'SERVABLE', 'OPTIONAL_SERVABLE'] AS names)
"""


@query("evl14_servability", _DECLARED + "SELECT feature, names[own + 1] AS own, names[verdict + 1] AS classification, verdict >= 4 AS servable, verdict < own AS inherited FROM v, n")
def servability(spark: SparkSession, d: str) -> DataFrame:
    """Features built on one another in chains: each as bad as the worst that it reaches."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("f"), x.cast("long").cast("string"))
    text = F.when((k % 23 != 0) & (F.col("p_size") % 17 != 0), "stated")
    declared = M.table(spark, d, "part").select(
        name(k).alias("feature"), F.when(k > 3, F.array_distinct(F.array(name(F.floor(k / 2)), name(F.floor(k / 3))))).alias("inputs"), F.when(k % 41 == 0, "T+5 window").when(k % 37 == 0, "post_event").otherwise("at_prediction").alias("time_semantics"),
        (k % 29 == 0).alias("depends_on_output"), F.lit("v9").alias("upstream_model_version"), F.lit(True).alias("available"), (k % 2 == 0).alias("required"), *(text.alias(c) for c in V.DOCUMENTED),
    )
    return V.audit(declared, "v3", stored)


_USABLE = "probability_up >= 0.9 AND endpoint = 'quick_ask'"


@query("src11_widening_read", M.with_views("decisions", more=f"""m AS (SELECT *, date_trunc('month', event_date) AS month FROM decisions), r AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS i FROM (SELECT DISTINCT month FROM m)),
w AS (SELECT least(CAST(2 ** k AS BIGINT), 64, (SELECT count(*) FROM r)) AS parts FROM (SELECT unnest(range(7)) AS k)), c AS (SELECT parts, count(*) AS scanned, count(*) FILTER ({_USABLE}) AS usable FROM w, m JOIN r USING (month) WHERE r.i <= parts GROUP BY parts)""")
    + "SELECT parts, scanned, usable, usable < 20 AS capped FROM c ORDER BY usable < 20, parts * CASE WHEN usable < 20 THEN -1 ELSE 1 END LIMIT 1")
def widening_read(spark: SparkSession, d: str) -> DataFrame:
    """Months of decisions from the newest back, until twenty rows are usable; older months' files are not opened."""
    path = f"{work_folder(spark)}/widening-{uuid.uuid4().hex}"
    M.decisions(spark, d).withColumn("month", F.date_format("event_date", "yyyy-MM")).write.partitionBy("month").parquet(path)
    w = C.read_widening(spark.read.parquet(path), "month", F.expr(_USABLE), enough=20)
    return w.rows.agg(F.lit(w.parts).cast("long").alias("parts"), F.count(F.lit(1)).alias("scanned"), F.lit(w.usable).cast("long").alias("usable"), F.lit(w.capped).alias("capped"))


@query("snk07_split_cache", M.with_views("decisions", "splits", more="u AS (SELECT DISTINCT symbol FROM decisions)") + """SELECT ticker, execution_date, adjustment_type, CASE WHEN execution_date >= DATE '1998-06-01' THEN split_to * 2 ELSE split_to END AS split_to, split_from, id
FROM splits WHERE ticker IN (SELECT symbol FROM u)""")
def split_cache(spark: SparkSession, d: str) -> DataFrame:
    """Two runs into one cache, the second with revised ratios of late splits, and a third that fails and leaves nothing."""
    cache = C.split_cache(f"{work_folder(spark)}/splits-{uuid.uuid4().hex}")
    raw, universe = M.splits(spark, d), M.decisions(spark, d).select("symbol")
    C.write_splits(cache, raw.withColumn("ticker", F.lower("ticker")), universe, "first", 1)
    C.write_splits(cache, raw.where("execution_date >= '1998-06-01'").withColumn("split_to", F.col("split_to") * 2), universe, "second", 2)
    try:
        C.write_splits(cache, raw.withColumn("adjustment_type", F.lit("spin_off")), universe, "third", 3)
    except ValueError:
        pass
    return cache.read(spark).drop("retrieved")


_LABELLED = M.with_views("bars", "decisions", more=_FORWARD + """, raw AS (SELECT *, seq % 53 <> 0 AS named, CASE WHEN seq % 31 <> 0 THEN action END AS recommendation, e1 / entry - 1 AS r1, e5 / entry - 1 AS r5 FROM o),
kept AS (SELECT * FROM raw WHERE named AND event_date <= (SELECT max(event_date) FROM decisions) - 30 AND recommendation IS NOT NULL AND (r1 IS NOT NULL OR r5 IS NOT NULL))""")


@query("flt12_labelled_decisions", _LABELLED + """SELECT seq, symbol, recommendation, CASE WHEN r5 IS NOT NULL THEN CAST(r5 > 0 AS INTEGER) END AS label_up_5d, CASE WHEN r5 IS NOT NULL THEN CAST(r5 <= -0.02e0 AS INTEGER) END AS label_drawdown_5d,
  CASE WHEN r5 < -0.03e0 THEN 'big_loss' WHEN r5 < -0.005e0 THEN 'loss' WHEN r5 <= 0.005e0 THEN 'flat' WHEN r5 <= 0.03e0 THEN 'gain' WHEN r5 > 0.03e0 THEN 'big_gain' END AS return_bin_5d FROM kept""")
def labelled_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Mature decisions with a proper symbol, a recommendation and a return at one horizon at least, and their labels."""
    o = outcomes(spark, d, [1, 5])
    raw = o.withColumns({"written": F.when(F.col("seq") % 53 != 0, F.concat(F.lit(" "), F.lower("symbol"))).otherwise(F.lit("no symbol!")), "recommendation": F.when(F.col("seq") % 31 != 0, F.col("action"))})
    newest = M.decisions(spark, d).agg(F.max("event_date").alias("newest"))
    return V.labelled(raw.crossJoin(F.broadcast(newest)), "written", F.date_sub("newest", 30)).select("seq", "symbol", "recommendation", "label_up_5d", "label_drawdown_5d", "return_bin_5d")  # one row
