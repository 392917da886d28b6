"""Reads that widen until enough rows are usable, and the cache of share splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import fingerprints
from ..streaming.keyed_table import KeyedTable

#: Funds whose splits are always wanted, and kinds of splits whose meaning is known.
FUNDS = ("SPY", "XLC", "XLY", "XLP", "XLE", "XLF", "XLV", "XLI", "XLB", "XLRE", "XLK", "XLU")
KINDS = ("forward_split", "reverse_split", "stock_dividend")


@dataclass(frozen=True)
class Widened:
    """Rows of the newest ``parts`` partitions, of which ``usable`` rows are."""

    rows: DataFrame
    parts: int
    usable: int
    capped: bool


def read_widening(rows: DataFrame, part: str, usable: Column, enough: int = 1, first: int = 1, cap: int = 64) -> Widened:
    """The newest partitions of ``rows``, twice as many each time, until ``enough`` rows are usable or ``cap`` are read.

    ``part`` is a partition column of the folder, so partitions are listed by their names, files of older ones are not
    opened, and a wider look counts only what it adds.
    """
    names = [r[0] for r in rows.select(part).distinct().orderBy(F.desc(part)).limit(cap).collect()]
    found, seen, want = 0, 0, min(first, cap)
    while True:
        want = min(want, len(names))
        if want > seen:
            found += rows.where(F.col(part).between(F.lit(names[want - 1]), F.lit(names[seen])) & usable).count()
            seen = want
        if found >= enough or seen == len(names):
            break
        want = 2 * seen
    held = rows.where(F.col(part) >= F.lit(names[seen - 1])) if names else rows
    return Widened(held, seen, found, found < enough)


def canonical_splits(raw: DataFrame) -> DataFrame:
    """Splits as they are cached: names trimmed and in capitals, and what is amiss with each (empty: nothing)."""
    ticker, kind = F.upper(F.trim("ticker")), F.lower(F.trim("adjustment_type"))
    amiss = F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unsupported_type").when(~F.coalesce((F.col("split_from") > 0) & (F.col("split_to") > 0) & F.col("execution_date").isNotNull(), F.lit(False)), "malformed")
    return raw.select(ticker.alias("ticker"), "execution_date", kind.alias("adjustment_type"), "split_from", "split_to", "id", F.coalesce(amiss, F.lit("")).alias("amiss"))


def split_cache(path: str) -> KeyedTable:
    return KeyedTable(path, ("ticker", "execution_date", "id"), ("retrieved", "split_to", "split_from"))


def write_splits(cache: KeyedTable, raw: DataFrame, universe: DataFrame, name: str, retrieved: int) -> DataFrame:
    """Cache the splits of ``universe`` (symbol) and the funds; the manifest of the run, one row.

    A run that meets an unsupported or malformed action of a wanted symbol raises, and readers see nothing of it.
    """
    spark = raw.sparkSession
    wanted = universe.select(F.upper("symbol").alias("ticker")).unionByName(spark.createDataFrame([(f,) for f in FUNDS], "ticker string")).distinct()
    mine = canonical_splits(raw).join(wanted, "ticker", "left_semi")
    cache.write_part(mine.where("amiss = ''").drop("amiss").withColumn("retrieved", F.lit(retrieved).cast("long")), name)
    # The part that was written is what the manifest speaks of.
    part = spark.read.parquet(f"{cache.path}/parts/name={name}")
    key = F.concat_ws("|", "ticker", F.col("execution_date").cast("string"), "id", F.col("split_from").cast("string"), F.col("split_to").cast("string"))
    source = fingerprints(part.withColumn("all", F.lit(1)), ["all"], key).select("fingerprint")
    counts = part.agg(F.count(F.lit(1)).alias("splits"), F.count_distinct("ticker").alias("symbols"))
    faults = mine.where("amiss <> ''").agg(F.count(F.when(F.col("amiss") == "unsupported_type", 1)).alias("unsupported"), F.count(F.when(F.col("amiss") == "malformed", 1)).alias("malformed"))
    manifest = counts.crossJoin(faults).join(source, F.lit(True), "left")  # one row each
    found = manifest.first()
    if found["unsupported"] or found["malformed"]:
        raise ValueError(f"{found['unsupported']} unsupported and {found['malformed']} malformed share actions")
    cache.write_record(spark, name, float(retrieved))
    return manifest
