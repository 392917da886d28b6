"""Lenient and strict readers of bar, decision and split files, and the sinks beside them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "symbol string, bar_date date, open_px double, high_px double, low_px double, close_px double, volume double"
DECISION = "seq long, ts long, symbol string, endpoint string, decision_source string, action string, model_version string, probability_up double"
SPLIT = "ticker string, execution_date date, adjustment_type string, split_from double, split_to double, id string"


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names for intermediate tables; a temporary one only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return named


def read_bar_files(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from JSON lines or CSV under ``path`` (gzip as well, files with a leading _ are skipped).

    Lines that don't parse and bars without symbol, day or close go; of equal (symbol, day) the last file's last
    line stays.
    """
    base = lambda kind: spark.read.schema(BAR + ", _bad string").option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", kind)
    parts = []
    for kind, read in (("*.{jsonl,json,json.gz,jsonl.gz}", "json"), ("*.{csv,csv.gz}", "csv")):
        reader = base(kind).option("header", True) if read == "csv" else base(kind)
        parts.append(getattr(reader, read)(path).where("_bad is null").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")).drop("_bad"))
    rows = parts[0].unionByName(parts[1]).withColumn("symbol", F.upper(F.trim("symbol"))).where("symbol <> '' and bar_date is not null and close_px is not null")
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin([s.upper() for s in symbols]))
    rows = rows.where(F.col("bar_date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("bar_date") <= F.lit(end).cast("date")) if end else rows
    values = [c for c in rows.columns if c not in ("symbol", "bar_date", "_file", "_block", "_line")]
    last = F.max_by(F.struct(*values), F.struct("_file", "_block", "_line")).alias("v")
    return rows.groupBy("symbol", "bar_date").agg(last).select("symbol", "bar_date", *[f"v.{c}" for c in values])


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; lines that don't parse go, a missing path is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest_events(events: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` events by (ts, seq)."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def read_splits_strict(spark: SparkSession, path: str) -> DataFrame:
    """Split events; any bad line, repeated event or unknown type is an error."""
    rows = spark.read.schema(SPLIT).option("mode", "FAILFAST").json(path)
    known = F.col("adjustment_type").isin("forward_split", "reverse_split", "stock_dividend")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker", "execution_date", "id", "split_from", "split_to").alias("d"), F.count(F.when(~known, 1)).alias("bad")).first()
    if found["bad"] or found["n"] != found["d"]:
        raise ValueError(f"{found['bad']} unknown types, {found['n'] - found['d']} repeated events")
    return rows


def provider_bars(raw: DataFrame, payload: Column | str = "value") -> DataFrame:
    """Bars from a provider's JSON with results[] of o, h, l, c, v and t in milliseconds; incomplete ones go."""
    x = raw.select(F.from_json(payload, "ticker string, results array<struct<o: double, h: double, l: double, c: double, v: double, vw: double, n: bigint, t: bigint>>").alias("p"))
    rows = x.select(F.col("p.ticker").alias("symbol"), F.explode("p.results").alias("r"))
    named = rows.select("symbol", F.to_date(F.timestamp_millis("r.t")).alias("bar_date"), *[F.col(f"r.{a}").alias(b) for a, b in (("o", "open_px"), ("h", "high_px"), ("l", "low_px"), ("c", "close_px"), ("v", "volume"), ("vw", "vwap"), ("n", "trades"))])
    return named.na.drop()


def write_partition_tree(rows: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> DataFrame:
    """Parquet under key folders, refused where the folder exists; returns rows per partition as its manifest."""
    rows.write.mode(mode).partitionBy(*keys).parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def union_columns(parts: list[DataFrame], preferred: list[str]) -> DataFrame:
    """Union over ragged columns, the preferred first, the others by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    rest = sorted(c for c in out.columns if c not in preferred)
    return out.select(*[c for c in preferred if c in out.columns], *rest)


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, checksum): a number that doesn't depend on the order of rows."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*columns)).alias("checksum"))


def last_bars(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_date"))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def read_one_lineage(spark: SparkSession, path: str, schema: str, lineage: list[str]) -> DataFrame:
    """JSON lines of one lineage: each of these columns has one value in all rows, anything else is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    found = rows.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in lineage], *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in lineage]).first()
    wrong = [c for c in lineage if found[f"n_{c}"] != 1 or found[f"null_{c}"]]
    if wrong:
        raise ValueError(f"not of one lineage: {', '.join(wrong)}")
    return rows


def land(rows: DataFrame, root: str, prefix: str, day: str) -> str:
    """Write ``rows`` into a dated folder that nothing may overwrite; returns the folder."""
    at = f"{root.rstrip('/')}/{'/'.join(p for p in prefix.split('/') if p not in ('', '.', '..'))}/ingest_date={day}"
    try:
        rows.write.mode("errorifexists").parquet(at)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise ValueError(f"{at} is there already") from e
        raise
    return at


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: it is computed once, and lost executors cost nothing."""
    path = f"{work_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
