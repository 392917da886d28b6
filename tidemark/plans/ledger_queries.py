"""Queries of sinks with manifests, strict readers, decision snapshots, profiles and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import asof as A
from ..sources import files as S
from ..sources import market as M
from .desk_queries import _LAST, last_prices
from .evaluation_queries import _O, judged
from .join_queries import outcomes
from .registry import query
from .source_queries import _new


@query("src04_training_rows", M.with_views("decisions") + "SELECT seq, symbol, probability_up FROM decisions WHERE seq % 5 <> 0")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines with broken ones between them, and read leniently."""
    path = _new(spark, "training")
    row = F.to_json(F.struct("seq", "symbol", "probability_up"))
    M.decisions(spark, d).select(F.when(F.expr("seq % 5 <> 0"), row).otherwise(F.concat(F.lit("{broken "), F.col("seq").cast("string"))).alias("value")).write.text(path)
    return S.read_json_rows(spark, path, "seq long, symbol string, probability_up double")


@query("src05_strict_lineage", M.with_views("decisions") + "SELECT count(*) AS n, 'v2' AS schema_version, 'event_time' AS policy FROM decisions")
def strict_lineage(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "lineage")
    M.decisions(spark, d).select("seq", F.lit("v2").alias("schema_version"), F.lit("event_time").alias("policy")).write.json(path)
    rows = S.read_one_lineage(spark, path, "seq long, schema_version string, policy string", ["schema_version", "policy"])
    return rows.groupBy("schema_version", "policy").agg(F.count(F.lit(1)).alias("n"))


@query("snk02_row_slices", M.with_views("decisions") + "SELECT slice, count(*) AS n FROM (SELECT 'all' AS slice FROM decisions UNION ALL SELECT CASE WHEN event_date < DATE '1997-01-01' THEN 'train' ELSE 'test' END FROM decisions UNION ALL SELECT 'probability' FROM decisions WHERE probability_up IS NOT NULL) GROUP BY 1")
def row_slices(spark: SparkSession, d: str) -> DataFrame:
    """All slices in one write, a folder for each."""
    path = _new(spark, "slices")
    day = F.col("event_date")
    names = F.array_compact(F.array(F.lit("all"), F.when(day < F.lit("1997-01-01").cast("date"), "train").otherwise("test"), F.when(F.col("probability_up").isNotNull(), "probability")))
    M.decisions(spark, d).withColumn("slice", F.explode(names)).write.partitionBy("slice").json(path)
    return spark.read.schema("seq long, slice string").json(path).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query("snk06_dated_landing", M.with_views("bars") + "SELECT DATE '2024-01-02' AS ingest_date, count(*) AS rows, count(DISTINCT symbol) AS symbols, true AS refused FROM bars")
def dated_landing(spark: SparkSession, d: str) -> DataFrame:
    """A dated folder that takes one write; the second is refused."""
    path = _new(spark, "landing")
    bars = M.bars(spark, d)
    first = S.land(bars, path, "daily/bars", "2024-01-02")
    try:
        S.land(bars.limit(0), path, "daily/bars", "2024-01-02")
        refused = False
    except ValueError:
        refused = True
    kept = spark.read.parquet(first)
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols")).select(F.lit("2024-01-02").cast("date").alias("ingest_date"), "rows", "symbols", F.lit(refused).alias("refused"))


@query("snk10_shadow_records", M.with_views("decisions") + "SELECT role, count(*) AS n, count(DISTINCT seq) AS decisions FROM (SELECT seq, 'production' AS role FROM decisions UNION ALL SELECT seq, 'challenger' FROM decisions WHERE probability_up IS NOT NULL UNION ALL SELECT seq, 'challenger' FROM decisions WHERE probability_up IS NOT NULL) GROUP BY 1")
def shadow_records(spark: SparkSession, d: str) -> DataFrame:
    """Production's records are appended first, then those of two challengers."""
    path = _new(spark, "log")
    x = M.decisions(spark, d).select("seq", "symbol", "probability_up")
    x.withColumn("role", F.lit("production")).write.mode("append").parquet(path)
    models = F.explode(F.array(F.lit("a"), F.lit("b")))
    x.where("probability_up is not null").select("seq", "symbol", "probability_up", F.lit("challenger").alias("role"), models.alias("model")).drop("model").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("decisions"))


@query("snk12_outcome_snapshot", _O + "SELECT action, count(*) AS rows, count(r5) AS evaluated, round(avg(r1), 6) AS mean_1, round(avg(r5), 6) AS mean_5, max(ts) AS latest FROM y GROUP BY 1")
def outcome_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = _new(spark, "outcomes")
    judged(spark, d).select("seq", "action", "ts", "ret_1", "ret_5", "outcome").write.parquet(path)
    return spark.read.parquet(path).groupBy("action").agg(F.count(F.lit(1)).alias("rows"), F.count("ret_5").alias("evaluated"), F.round(F.avg("ret_1"), 6).alias("mean_1"), F.round(F.avg("ret_5"), 6).alias("mean_5"), F.max("ts").alias("latest"))


@query("scl26_decision_snapshot", M.with_views("decisions") + """SELECT seq, '{"symbol":"' || symbol || '","endpoint":"' || endpoint || '","model":{"version":"' || model_version || '","horizon":"5d"},"recommendation":"' || action || '"}' AS snapshot FROM decisions""")
def decision_snapshot(spark: SparkSession, d: str) -> DataFrame:
    model = F.struct(F.col("model_version").alias("version"), F.lit("5d").alias("horizon")).alias("model")
    return M.decisions(spark, d).select("seq", F.to_json(F.struct("symbol", "endpoint", model, F.col("action").alias("recommendation"))).alias("snapshot"))


_PROFILE = "p AS (SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'moderate' WHEN 1 THEN 'wild' WHEN 2 THEN 'conservative' WHEN 3 THEN 'aggressive' END AS risk, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 60 - 3 END AS years, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 120 + 0e0 END AS loss FROM customer)"


@query("scl27_profile_rules", "WITH " + _PROFILE + " SELECT user_id, concat_ws(',', CASE WHEN risk NOT IN ('conservative', 'moderate', 'aggressive') THEN 'risk_tolerance' END, CASE WHEN years NOT BETWEEN 1 AND 50 THEN 'time_horizon_years' END, CASE WHEN loss NOT BETWEEN 1 AND 100 THEN 'loss_capacity_percent' END) AS errors, coalesce(risk, 'conservative') AS risk, coalesce(years, 1) AS years, coalesce(loss, 10e0) AS loss FROM p")
def profile_rules(spark: SparkSession, d: str) -> DataFrame:
    """Fields out of their list or range, and cautious values for those that are missing."""
    key = F.col("c_custkey")
    risk = F.when(key % 5 == 0, "moderate").when(key % 5 == 1, "wild").when(key % 5 == 2, "conservative").when(key % 5 == 3, "aggressive")
    p = M.table(spark, d, "customer").select(key.alias("user_id"), risk.alias("risk"), F.when(key % 7 != 0, key % 60 - 3).alias("years"), F.when(key % 4 != 0, (key % 120).cast("double")).alias("loss"))
    errors = F.array_compact(F.array(F.when(~F.col("risk").isin("conservative", "moderate", "aggressive"), "risk_tolerance"), F.when(~F.col("years").between(1, 50), "time_horizon_years"), F.when(~F.col("loss").between(1, 100), "loss_capacity_percent")))
    return p.select("user_id", F.concat_ws(",", errors).alias("errors"), F.coalesce("risk", F.lit("conservative")).alias("risk"), F.coalesce("years", F.lit(1)).alias("years"), F.coalesce("loss", F.lit(10.0)).alias("loss"))


@query("flt09_actionable_rows", M.with_views("bars", "decisions", more=_LAST) + "SELECT seq, round(price, 6) AS price FROM decisions JOIN q USING (symbol) WHERE action IN ('BUY', 'STRONG BUY') AND price > 0 AND price <= 105 AND change > 0")
def actionable_rows(spark: SparkSession, d: str) -> DataFrame:
    x = M.decisions(spark, d).where(F.col("action").isin("BUY", "STRONG BUY")).join(last_prices(spark, d), "symbol")
    return x.where("price > 0 and price <= 105 and change > 0").select("seq", F.round("price", 6).alias("price"))


@query("flt13_dated_closes", M.with_views("bars") + "SELECT symbol, bar_date AS day, round(close_px, 6) AS close_px FROM bars WHERE close_px IS NOT NULL AND volume % 4 <> 0")
def dated_closes(spark: SparkSession, d: str) -> DataFrame:
    b = M.bars(spark, d).withColumn("close_px", F.when(F.col("volume") % 4 != 0, F.col("close_px")))
    return b.where("close_px is not null").select("symbol", F.to_date("bar_date").alias("day"), F.round("close_px", 6).alias("close_px"))


@query("jon04_price_path", M.with_views("bars", "decisions", more="b AS (SELECT *, list(close_px) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS path FROM bars)") + "SELECT d.seq, len(path) AS bars, round(path[1], 6) AS entry, round(path[len(path)], 6) AS last, array_to_string(list_transform(path, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS cents FROM decisions d ASOF JOIN b ON d.symbol = b.symbol AND d.event_date <= b.bar_date")
def price_path(spark: SparkSession, d: str) -> DataFrame:
    bars = M.bars(spark, d, together=True).withColumn("path", A.path_closes("close_px", 5))
    met = A.forward_asof(M.decisions(spark, d), bars, "symbol", "event_date", "bar_date", ["path"]).where("met is not null")
    path = F.col("met.path")
    cents = F.array_join(F.transform(path, lambda x: F.round(x * 100).cast("bigint").cast("string")), ",")
    return met.select("seq", F.size(path).cast("bigint").alias("bars"), F.round(path[0], 6).alias("entry"), F.round(F.element_at(path, -1), 6).alias("last"), cents.alias("cents"))


@query("jon14_load_window", M.with_views("decisions", more="w AS (SELECT min(event_date) - 70 AS first_day, max(event_date) + 8 AS last_day FROM decisions), u AS (SELECT DISTINCT symbol FROM decisions UNION SELECT unnest(['SPY', 'XLK']))") + "SELECT symbol, first_day, last_day FROM u, w")
def load_window(spark: SparkSession, d: str) -> DataFrame:
    x = M.decisions(spark, d)
    w = x.agg(F.date_sub(F.min("event_date"), 70).alias("first_day"), F.date_add(F.max("event_date"), 8).alias("last_day"))
    every = x.select("symbol").unionByName(spark.createDataFrame([("SPY",), ("XLK",)], "symbol string")).distinct()
    return every.crossJoin(F.broadcast(w))  # one row


@query("win16_derived_all", M.with_views("bars", more="a AS (SELECT *, CASE WHEN count(close_px) OVER n20 = 20 THEN avg(close_px) OVER n20 END AS sma20, CASE WHEN count(close_px) OVER n50 = 50 THEN avg(close_px) OVER n50 END AS sma50, CASE WHEN count(close_px) OVER n20 = 20 THEN sum(close_px * volume) OVER n20 / nullif(sum(volume) OVER n20, 0) END AS vwap, close_px / lag(close_px, 5) OVER w - 1 AS m5, close_px / lag(close_px, 20) OVER w - 1 AS m20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date), n20 AS (PARTITION BY symbol ORDER BY bar_date ROWS 19 PRECEDING), n50 AS (PARTITION BY symbol ORDER BY bar_date ROWS 49 PRECEDING))")
    + "SELECT symbol, bar_date, round(close_px / vwap - 1, 5) AS vs_vwap, close_px > vwap AS above_vwap, round(sma20 / sma50 - 1, 5) AS sma_ratio, round(m5 - m20, 5) AS momentum_gap FROM a WHERE m20 IS NOT NULL")
def derived_all(spark: SparkSession, d: str) -> DataFrame:
    w, close = W.by_symbol(), F.col("close_px")
    a = M.bars(spark, d).withColumns({"sma20": W.moving_average("close_px", 20, w), "sma50": W.moving_average("close_px", 50, w), "vwap": W.vwap("close_px", "volume", 20, w), "m5": W.lagged_return("close_px", 5, w), "m20": W.lagged_return("close_px", 20, w)})
    return a.where("m20 is not null").select("symbol", "bar_date", F.round(close / F.col("vwap") - 1, 5).alias("vs_vwap"), (close > F.col("vwap")).alias("above_vwap"), F.round(F.col("sma20") / F.col("sma50") - 1, 5).alias("sma_ratio"), F.round(F.col("m5") - F.col("m20"), 5).alias("momentum_gap"))


@query("cor05_adjusted_with_ids", M.with_views("bars", "splits", more="k AS (SELECT b.symbol, b.bar_date, string_agg(s.id, ',' ORDER BY s.id) AS ids, product(s.split_from / s.split_to) AS f FROM bars b JOIN splits s ON s.ticker = b.symbol AND s.execution_date > b.bar_date GROUP BY 1, 2)") + "SELECT b.symbol, b.bar_date, round(b.close_px * coalesce(f, 1e0), 6) AS close_px, round(b.volume / coalesce(f, 1e0), 6) AS volume, coalesce(ids, '') AS split_ids FROM bars b LEFT JOIN k USING (symbol, bar_date)")
def adjusted_with_ids(spark: SparkSession, d: str) -> DataFrame:
    """Bars on the basis of the last day, with the splits that are still ahead of each; a symbol's splits are few."""
    s = M.splits(spark, d).groupBy("ticker").agg(F.collect_list(F.struct("execution_date", "id", (F.col("split_from") / F.col("split_to")).alias("f"))).alias("all"))
    b = M.bars(spark, d).join(F.broadcast(s) if s.limit(100_001).count() <= 100_000 else s, F.col("symbol") == F.col("ticker"), "left")
    ahead = F.filter(F.coalesce("all", F.array()), lambda x: x["execution_date"] > F.col("bar_date"))
    factor = F.aggregate(ahead, F.lit(1.0), lambda acc, x: acc * x["f"])
    ids = F.array_join(F.array_sort(F.transform(ahead, lambda x: x["id"])), ",")
    return b.select("symbol", "bar_date", F.round(F.col("close_px") * factor, 6).alias("close_px"), F.round(F.col("volume") / factor, 6).alias("volume"), ids.alias("split_ids"))


@query("dec03_sector_limits", M.with_views("positions", "sectors", more="v AS (SELECT user_id, coalesce(sector, 'UNKNOWN') AS sector, shares * buy_price AS value FROM positions LEFT JOIN sectors USING (symbol)), g AS (SELECT user_id, sector, sum(value) AS value FROM v GROUP BY 1, 2)") + "SELECT user_id, sector, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS weight, value / sum(value) OVER (PARTITION BY user_id) > 0.5e0 AS beyond FROM g")
def sector_limits(spark: SparkSession, d: str) -> DataFrame:
    p = M.positions(spark, d).join(M.sectors(spark, d), "symbol", "left")
    g = p.groupBy("user_id", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector")).agg(F.sum(F.col("shares") * F.col("buy_price")).alias("value"))
    weight = F.col("value") / F.sum("value").over(Window.partitionBy("user_id"))
    return g.select("user_id", "sector", F.round(weight, 6).alias("weight"), (weight > 0.5).alias("beyond"))


@query("dec10_momentum_points", M.with_views("bars", more="a AS (SELECT *, close_px / lag(close_px) OVER w - 1 AS change, volume / nullif(CASE WHEN count(volume) OVER n = 20 THEN avg(volume) OVER n END, 0) AS rv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date), n AS (PARTITION BY symbol ORDER BY bar_date ROWS 19 PRECEDING))") + "SELECT symbol, bar_date, CASE WHEN change >= 0.05e0 THEN 4e0 WHEN change >= 0.02e0 THEN 2e0 ELSE 0e0 END + CASE WHEN rv >= 2 THEN 3e0 WHEN rv >= 1.2e0 THEN 1.5e0 ELSE 0e0 END + CASE WHEN close_px <= 105 THEN 1e0 ELSE 0e0 END AS points FROM a WHERE change IS NOT NULL")
def momentum_points(spark: SparkSession, d: str) -> DataFrame:
    w = W.by_symbol()
    a = M.bars(spark, d).withColumns({"change": W.lagged_return("close_px", 1, w), "rv": W.safe_ratio(F.col("volume"), W.moving_average("volume", 20, w))}).where("change is not null")
    steps = lambda c, *limits: F.coalesce(*[F.when(F.col(c) >= at, F.lit(v)) for at, v in limits], F.lit(0.0))
    return a.select("symbol", "bar_date", (steps("change", (0.05, 4.0), (0.02, 2.0)) + steps("rv", (2.0, 3.0), (1.2, 1.5)) + F.when(F.col("close_px") <= 105, 1.0).otherwise(0.0)).alias("points"))


@query("dec18_mean_headline", M.with_views("news", "decisions", more="s AS (SELECT symbol, avg(CASE WHEN contains(lower(title), 'ering') THEN 1e0 WHEN contains(lower(title), 'oning') THEN -1e0 ELSE 0e0 END) AS m FROM news GROUP BY 1), u AS (SELECT DISTINCT symbol FROM decisions)") + "SELECT symbol, coalesce(round((m + 1) / 2 + 1e-9, 2), 0.5e0) AS sentiment FROM u LEFT JOIN s USING (symbol)")
def mean_headline(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("title")
    tone = F.when(F.contains(t, F.lit("ering")), 1.0).when(F.contains(t, F.lit("oning")), -1.0).otherwise(0.0)
    s = M.news(spark, d).groupBy("symbol").agg(F.avg(tone).alias("m"))
    return M.decisions(spark, d).select("symbol").distinct().join(s, "symbol", "left").select("symbol", F.coalesce(F.round((F.col("m") + 1) / 2 + 1e-9, 2), F.lit(0.5)).alias("sentiment"))


@query("agg23_canonical_rows", _O + ", u AS (SELECT DISTINCT symbol, event_date, action, r5, probability_up FROM y) SELECT symbol, event_date, count(*) AS n, round(avg(r5), 6) AS ret, round(avg(probability_up), 6) AS p, avg(CASE WHEN action IN ('BUY', 'STRONG BUY') THEN 1e0 ELSE 0e0 END) >= 0.5e0 AS buy, count(DISTINCT action) AS variants FROM u GROUP BY 1, 2")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    u = outcomes(spark, d, [5]).select("symbol", "event_date", "action", "ret_5", "probability_up").dropDuplicates()
    buy = F.avg(F.col("action").isin("BUY", "STRONG BUY").cast("double")) >= 0.5
    return u.groupBy("symbol", "event_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret_5"), 6).alias("ret"), F.round(F.avg("probability_up"), 6).alias("p"), buy.alias("buy"), F.count_distinct("action").alias("variants"))
