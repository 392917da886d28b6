"""Queries of field aliases, feature maps and contracts, policies, advice scores and whole views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import advice as A
from ..functions import records as R
from ..operators import modeling as L
from ..sources import market as M
from .desk_queries import _ADVICE, advised
from .evaluation_queries import _O, judged
from .model_queries import _FEATURES, features
from .record_queries import RAW, raw
from .registry import query
from .source_queries import _new

_ALIAS = {"ticker": "CASE seq % 3 WHEN 0 THEN symbol END", "sym": "CASE seq % 3 WHEN 1 THEN ' ' || lower(symbol) END", "t": "CASE seq % 3 WHEN 2 THEN symbol ELSE '' END", "c": "CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(seq AS STRING) END"}


@query("scl01_field_aliases", M.with_views("decisions", more="r AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _ALIAS.items()) + " FROM decisions)") + "SELECT seq, upper(trim(coalesce(nullif(ticker, ''), nullif(sym, ''), nullif(t, '')))) AS symbol, TRY_CAST(c AS DOUBLE) AS close_px FROM r WHERE TRY_CAST(c AS DOUBLE) IS NOT NULL")
def field_aliases(spark: SparkSession, d: str) -> DataFrame:
    r = M.decisions(spark, d).select("seq", *[F.expr(e).alias(n) for n, e in _ALIAS.items()])
    return r.select("seq", F.upper(F.trim(R.first_text(*map(F.col, ("ticker", "sym", "t"))))).alias("symbol"), R.finite(F.col("c")).alias("close_px")).where("symbol <> '' and close_px is not null")


_NUMS = ("f_ret1", "f_ret5", "f_rsi", "f_macd", "f_volume")


@query("scl11_feature_map", RAW + "SELECT seq, feature, value FROM (" + " UNION ALL ".join(f"SELECT seq, 'feature_{c[2:]}' AS feature, CASE WHEN isfinite(TRY_CAST(trim({c}) AS DOUBLE)) THEN TRY_CAST(trim({c}) AS DOUBLE) END AS value FROM raw" for c in _NUMS) + ") WHERE value IS NOT NULL")
def feature_map(spark: SparkSession, d: str) -> DataFrame:
    """Numeric entries of a map under prefixed names."""
    texts = F.create_map(*[x for c in _NUMS for x in (F.lit(c[2:]), F.col(c))])
    numbers = F.map_filter(F.transform_values(texts, lambda _, v: R.finite(v)), lambda _, v: v.isNotNull())
    return raw(spark, d).select("seq", F.explode(F.transform_keys(numbers, lambda k, _: F.concat(F.lit("feature_"), k))).alias("feature", "value"))


@query("scl30_conditions", "WITH k AS (SELECT event_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) SELECT event_id, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS conditions, k AS first_condition, CAST(trunc(value) AS BIGINT) AS whole FROM k")
def conditions(spark: SparkSession, d: str) -> DataFrame:
    """A number or a list of them, as JSON text, becomes an array; prices are cut to whole numbers."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    text = F.when(k.cast("bigint") % 3 == 0, F.concat(F.lit("["), k, F.lit(",7]"))).otherwise(k)
    listed = F.from_json(F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<bigint>")
    return M.table(spark, d, "events").select("event_id", F.size(listed).alias("conditions"), listed[0].alias("first_condition"), F.col("value").cast("bigint").alias("whole"))


@query("scl31_values_and_days", RAW + "SELECT seq, p_rec IS NOT NULL AND trim(p_rec) <> '' AS has_value, event_date AS day FROM raw")
def values_and_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.substring(F.concat(F.col("event_date").cast("string"), F.lit("T00:00:00Z")), 1, 10).try_cast("date")
    return raw(spark, d).select("seq", R.blank_to_null(F.col("p_rec")).isNotNull().alias("has_value"), day.alias("day"))


@query("flt05_feature_columns", _FEATURES + ", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n FROM x" for c in L.FEATURES) + ") SELECT feature, n, feature NOT IN ('bench_ret_5', 'risk_on') AS own FROM u WHERE n > 0")
def feature_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that hold any number, leaking names left out, counted in one pass."""
    f = features(spark, d)
    leaking = [c for c in f.columns if c.startswith(("label", "future", "exit"))]
    kept = [c for c in L.FEATURES if c not in leaking]
    one = f.agg(*[F.count(c).alias(c) for c in kept])
    return one.select(F.explode(F.create_map(*[x for c in kept for x in (F.lit(c), F.col(c))])).alias("feature", "n")).where("n > 0").withColumn("own", ~F.col("feature").isin("bench_ret_5", "risk_on"))


@query("snk01_rows_and_manifest", M.with_views("decisions") + "SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, 'event_time' AS policy, CAST(sum(CAST('0x' || substring(md5('' || seq), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM decisions")
def rows_and_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON lines with their fields by name, and the manifest of what was written, read back."""
    path = _new(spark, "training-rows")
    x = M.decisions(spark, d)
    x.select(*sorted(x.columns)).write.json(path)
    kept = spark.read.schema("seq long, symbol string").json(path)
    part = F.conv(F.substring(F.md5(F.col("seq").cast("string")), 1, 8), 16, 10).cast("bigint")
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"), F.lit("event_time").alias("policy"), F.sum(part).alias("checksum"))


@query("snk09_decision_log", M.with_views("decisions") + "SELECT forecast_horizon, count(*) AS n FROM (SELECT CASE WHEN probability_up IS NOT NULL THEN '5d' END AS forecast_horizon FROM decisions) GROUP BY 1")
def decision_log(spark: SparkSession, d: str) -> DataFrame:
    """Records appended in two parts; a horizon is resolved where there is a probability."""
    path = _new(spark, "decision-log")
    x = M.decisions(spark, d).select("seq", "symbol", F.when(F.col("probability_up").isNotNull(), R.horizon(F.regexp_extract("model_version", "([0-9]+d)", 1))).alias("forecast_horizon"))
    for part in (x.where("seq % 2 = 0"), x.where("seq % 2 <> 0")):
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("forecast_horizon").agg(F.count(F.lit(1)).alias("n"))


@query("src12_dimension_tables", "WITH p AS (SELECT CAST(c_custkey % 20 + 90 AS DECIMAL(16, 4)) AS buy_price, CAST(c_custkey % 20 + 1 AS DECIMAL(16, 6)) AS shares FROM customer) SELECT count(*) AS n, CAST(sum(buy_price * shares) AS DOUBLE) AS cost, CAST(max(shares) AS DOUBLE) AS most FROM p")
def dimension_tables(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "positions")
    M.positions(spark, d).select("user_id", "symbol", F.col("buy_price").cast("decimal(16,4)").alias("buy_price"), F.col("shares").cast("decimal(16,6)").alias("shares")).write.parquet(path)
    p = spark.read.schema("user_id long, symbol string, buy_price decimal(16,4), shares decimal(16,6)").parquet(path)
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("buy_price") * F.col("shares")).cast("double").alias("cost"), F.max("shares").cast("double").alias("most"))


@query("top14_outcome_view", _O + "SELECT seq, decision_source, outcome, round(r5, 6) AS ret_5 FROM y WHERE decision_source = 'model' AND outcome <> 'skipped' ORDER BY seq DESC LIMIT 100")
def outcome_view(spark: SparkSession, d: str) -> DataFrame:
    y = judged(spark, d).where("decision_source = 'model' and outcome <> 'skipped'")
    return y.orderBy(F.desc("seq")).limit(100).select("seq", "decision_source", "outcome", F.round("ret_5", 6).alias("ret_5"))


@query("dec04_policy_modes", _ADVICE + "SELECT position_id, CASE position_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'shadow' ELSE 'enforce' END AS mode, advice = 'BUY' AND risk_flags <> '' AS would_soften, CASE WHEN position_id % 3 = 2 AND advice = 'BUY' AND risk_flags <> '' THEN 'HOLD' ELSE advice END AS final_action FROM v")
def policy_modes(spark: SparkSession, d: str) -> DataFrame:
    """The policy decides only in enforce mode; in shadow mode it shows what it would do."""
    mode = F.element_at(F.array(F.lit("off"), F.lit("shadow"), F.lit("enforce")), (F.col("position_id") % 3 + 1).cast("int"))
    soften = (F.col("advice") == "BUY") & (F.col("risk_flags") != "")
    return advised(spark, d).select("position_id", mode.alias("mode"), soften.alias("would_soften"), F.when((mode == "enforce") & soften, "HOLD").otherwise(F.col("advice")).alias("final_action"))


@query("dec05_scored_advice", M.with_views("decisions") + "SELECT seq, CASE WHEN coalesce(probability_up, 0.5e0) >= 0.75e0 THEN 'STRONG BUY' WHEN coalesce(probability_up, 0.5e0) >= 0.55e0 THEN 'BUY' ELSE 'HOLD OFF FOR NOW' END AS call, round(abs(coalesce(probability_up, 0.5e0) - 0.5e0) * 2, 6) AS confidence, probability_up IS NULL AS imputed FROM decisions")
def scored_advice(spark: SparkSession, d: str) -> DataFrame:
    call, confidence, imputed = A.scored_call(F.col("probability_up"))
    return M.decisions(spark, d).select("seq", call.alias("call"), F.round(confidence, 6).alias("confidence"), imputed.alias("imputed"))


@query("dec15_source_preference", RAW + "SELECT seq, CASE WHEN p_prob IS NOT NULL THEN 'payload' WHEN s_prob IS NOT NULL THEN 'snapshot' WHEN e_prob IS NOT NULL THEN 'event' END AS source, round(coalesce(p_prob, s_prob / 100, e_prob), 6) AS value FROM raw")
def source_preference(spark: SparkSession, d: str) -> DataFrame:
    offers = [("payload", F.col("p_prob")), ("snapshot", F.col("s_prob") / 100), ("event", F.col("e_prob"))]
    picked = F.coalesce(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("source"), v.alias("value"))) for n, v in offers])
    return raw(spark, d).select("seq", picked["source"].alias("source"), F.round(picked["value"], 6).alias("value"))


@query("dec17_signal_resolution", RAW + "SELECT seq, coalesce(CASE WHEN decision_source <> 'rules' AND probability_up IS NOT NULL THEN CASE WHEN probability_up >= 0.55e0 THEN 'BUY' ELSE 'HOLD' END END, action) AS action, CASE WHEN decision_source <> 'rules' AND probability_up IS NOT NULL THEN 'model' ELSE 'rules' END AS resolved_by FROM raw")
def signal_resolution(spark: SparkSession, d: str) -> DataFrame:
    model = F.when((F.col("decision_source") != "rules") & F.col("probability_up").isNotNull(), F.when(F.col("probability_up") >= 0.55, "BUY").otherwise("HOLD"))
    return raw(spark, d).select("seq", F.coalesce(model, "action").alias("action"), F.when(model.isNotNull(), "model").otherwise("rules").alias("resolved_by"))
