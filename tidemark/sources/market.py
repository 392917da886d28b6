"""Market views over the star-schema tables: bars, benchmark, decisions, splits, sectors, positions, news, ticks.

Each view is a function (spark, sf_dir) -> DataFrame; ``SQL`` holds the same views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def bars(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Daily bars: one row per (symbol, bar_date). ``together``: for windows by symbol, which then share the bars' own shuffle and sort."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("bar_date"),
        (F.lit(100.0) + F.pmod(_cents("l_extendedprice"), F.lit(1000)) / F.lit(100.0)).alias("px"),
        F.col("l_quantity").cast("double").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("k"),
    )
    if together:
        lines = lines.repartition("symbol")
    return lines.groupBy("symbol", "bar_date").agg(
        F.min_by("px", "k").alias("open_px"),
        F.max("px").alias("high_px"),
        F.min("px").alias("low_px"),
        F.max_by("px", "k").alias("close_px"),
        F.sum("qty").alias("volume"),
    )


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark closes: one row per bar_date."""
    lines = table(spark, sf_dir, "lineitem")
    total = F.sum(_cents("l_extendedprice"))
    return lines.groupBy(F.to_date("l_shipdate").alias("bar_date")).agg((F.lit(100.0) + F.pmod(total, F.lit(1000)) / F.lit(100.0)).alias("close_px"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision events from orders."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_sup"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))  # one row
    pick = lambda c, m, d: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in m.items()], F.lit(d))
    actions = {"1-URGENT": "STRONG BUY", "2-HIGH": "BUY", "3-MEDIUM": "HOLD", "4-NOT SPECIFIED": "HOLD OFF FOR NOW"}
    key = F.col("o_orderkey").cast("bigint")
    return o.select(
        key.alias("seq"),
        F.concat(F.lit("S"), F.pmod(F.col("o_custkey"), F.col("n_sup")).cast("string")).alias("symbol"),
        F.to_date("o_orderdate").alias("event_date"),
        (F.unix_timestamp(F.to_date("o_orderdate").cast("timestamp")) + F.pmod(key, F.lit(86400))).alias("ts"),
        pick("o_orderpriority", actions, "SELL").alias("action"),
        pick("o_orderstatus", {"P": "quick_ask", "F": "hot_momentum_buys"}, "user_watchlist").alias("endpoint"),
        F.element_at(F.array(F.lit("rules"), F.lit("model"), F.lit("hybrid")), (F.pmod(key, F.lit(3)) + 1).cast("int")).alias("decision_source"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.lit("v1-5d")).otherwise(F.lit("v2-5d")).alias("model_version"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.pmod(F.col("o_custkey") * 37 + key * 101, F.lit(1000)) / F.lit(1000.0)).alias("probability_up"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share splits (ticker, execution_date, adjustment_type, split_from, split_to, id)."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0")
    kind = F.pmod("s_nationkey", F.lit(3))
    first = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.date_add(F.lit("1997-01-01").cast("date"), F.pmod(F.col("s_suppkey") * 17, F.lit(1500)).cast("int")).alias("execution_date"),
        F.when(kind == 1, "reverse_split").otherwise("forward_split").alias("adjustment_type"),
        F.when(kind == 1, 2.0).otherwise(1.0).alias("split_from"),
        F.when(kind == 0, 2.0).when(kind == 1, 1.0).otherwise(4.0).alias("split_to"),
        F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"),
    )
    second = s.where("s_suppkey % 6 = 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.date_add(F.lit("1997-01-01").cast("date"), (F.pmod(F.col("s_suppkey") * 17, F.lit(1500)) + 400).cast("int")).alias("execution_date"),
        F.lit("stock_dividend").alias("adjustment_type"),
        F.lit(2.0).alias("split_from"),
        F.lit(3.0).alias("split_to"),
        F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("id"),
    )
    return first.unionByName(second)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("r_name").alias("sector"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_sup"))
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n))  # one row
    return c.select(
        F.col("c_custkey").alias("position_id"),
        F.pmod("c_custkey", F.lit(100)).cast("bigint").alias("user_id"),
        F.concat(F.lit("S"), F.pmod(F.col("c_custkey"), F.col("n_sup")).cast("string")).alias("symbol"),
        (F.pmod("c_custkey", F.lit(20)) + 1).cast("double").alias("shares"),
        (F.pmod("c_custkey", F.lit(20)) + 90).cast("double").alias("buy_price"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_sup"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n))  # one row
    return d.select(
        "doc_id",
        F.concat(F.lit("S"), F.pmod(F.col("doc_id"), F.col("n_sup")).cast("string")).alias("symbol"),
        F.col("source").alias("publisher"),
        (F.lit(820454400) + F.pmod(F.col("doc_id") * 7919, F.lit(60000000))).alias("published_ts"),
        F.substring("text", 1, 200).alias("title"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream events per (symbol, type) with a provider sequence that holds duplicates and gaps."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in {"click": "T", "view": "Q", "signup": "A", "purchase": "AM"}.items()], F.lit("T"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    base = e.select("event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), kind.alias("type"), F.col("ts").alias("event_ts"), F.col("value").alias("price"), k.alias("k"))
    step = F.when(F.pmod("k", F.lit(13)) == 0, 0).when(F.pmod("k", F.lit(10)) == 0, 2).otherwise(1)
    w = Window.partitionBy("symbol", "type").orderBy("event_ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return base.withColumn("sequence", F.sum(step).over(w))


SQL = {
    "bars": """bars AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS bar_date,
  arg_min(px, k) AS open_px, max(px) AS high_px, min(px) AS low_px, arg_max(px, k) AS close_px, sum(CAST(l_quantity AS DOUBLE)) AS volume
  FROM (SELECT *, 100e0 + (CAST(round(l_extendedprice * 100) AS BIGINT) % 1000) / 100e0 AS px,
    row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem) GROUP BY 1, 2)""",
    "bench": """bench AS (SELECT CAST(l_shipdate AS DATE) AS bar_date,
  100e0 + (CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) % 1000) / 100e0 AS close_px FROM lineitem GROUP BY 1)""",
    "decisions": """decisions AS (SELECT CAST(o_orderkey AS BIGINT) AS seq, 'S' || (o_custkey % (SELECT count(*) FROM supplier)) AS symbol,
  CAST(o_orderdate AS DATE) AS event_date, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) + o_orderkey % 86400 AS ts,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'STRONG BUY' WHEN '2-HIGH' THEN 'BUY' WHEN '3-MEDIUM' THEN 'HOLD'
    WHEN '4-NOT SPECIFIED' THEN 'HOLD OFF FOR NOW' ELSE 'SELL' END AS action,
  CASE o_orderstatus WHEN 'P' THEN 'quick_ask' WHEN 'F' THEN 'hot_momentum_buys' ELSE 'user_watchlist' END AS endpoint,
  CASE o_orderkey % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'model' ELSE 'hybrid' END AS decision_source,
  CASE o_orderkey % 2 WHEN 0 THEN 'v1-5d' ELSE 'v2-5d' END AS model_version,
  CASE WHEN o_orderkey % 11 <> 0 THEN ((o_custkey * 37 + o_orderkey * 101) % 1000) / 1000e0 END AS probability_up FROM orders)""",
    "splits": """splits AS (SELECT 'S' || s_suppkey AS ticker, DATE '1997-01-01' + CAST((s_suppkey * 17) % 1500 AS INTEGER) AS execution_date,
  CASE s_nationkey % 3 WHEN 1 THEN 'reverse_split' ELSE 'forward_split' END AS adjustment_type,
  CASE s_nationkey % 3 WHEN 1 THEN 2e0 ELSE 1e0 END AS split_from, CASE s_nationkey % 3 WHEN 0 THEN 2e0 WHEN 1 THEN 1e0 ELSE 4e0 END AS split_to,
  'a' || s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT 'S' || s_suppkey, DATE '1997-01-01' + CAST((s_suppkey * 17) % 1500 + 400 AS INTEGER), 'stock_dividend', 2e0, 3e0, 'b' || s_suppkey
  FROM supplier WHERE s_suppkey % 6 = 0)""",
    "sectors": """sectors AS (SELECT 'S' || s_suppkey AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "positions": """positions AS (SELECT c_custkey AS position_id, CAST(c_custkey % 100 AS BIGINT) AS user_id, 'S' || (c_custkey % (SELECT count(*) FROM supplier)) AS symbol,
  CAST(c_custkey % 20 + 1 AS DOUBLE) AS shares, CAST(c_custkey % 20 + 90 AS DOUBLE) AS buy_price FROM customer)""",
    "news": """news AS (SELECT doc_id, 'S' || (doc_id % (SELECT count(*) FROM supplier)) AS symbol, source AS publisher,
  820454400 + (doc_id * 7919) % 60000000 AS published_ts, substring(text, 1, 200) AS title FROM documents)""",
    "ticks": """ticks AS (SELECT event_id, symbol, type, event_ts, price, k, CAST(sum(CASE WHEN k % 13 = 0 THEN 0 WHEN k % 10 = 0 THEN 2 ELSE 1 END)
  OVER (PARTITION BY symbol, type ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sequence
  FROM (SELECT event_id, 'U' || user_id AS symbol, CASE event_type WHEN 'click' THEN 'T' WHEN 'view' THEN 'Q' WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'AM' ELSE 'T' END AS type,
    ts AS event_ts, value AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))""",
}


def with_views(*names: str, more: str = "") -> str:
    """A WITH clause of the named views, and of further expressions."""
    return "WITH " + ",\n".join([*(SQL[n] for n in names), *([more] if more else [])]) + "\n"
