"""Mixing sources to target weights by thresholds of a hash, found in histograms.

Every row has a key of 60 bits from its doc_id and text. Words are summed by source and the key's first 12 bits; in
that histogram a source's budget runs out in one bucket, and only this bucket's rows are looked at again by their
next 12 bits, and so on until one row is left, which goes whichever way comes nearer to the budget. A row is taken
once more if its key lies below its source's cut. Nothing is sorted: each step is a sum over at most 4,096 buckets of
a source. Cuts of a smaller budget lie below those of a larger one, so mixes are nested.

Rows that share a key are equal in doc_id and text. Only where they straddle a cut are they told apart, by further
bits from their place in the written table of sizes: which of them is taken differs then, what is taken does not.

A target of up to twice a source's size means that all rows are taken so many whole times, and those below the cut
once more. So no row is taken more than ``most`` times, and a source's taken words miss its target by half a
document at most.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order,
and the empty string is another one; null doc_ids and repeated rows are rows like others; with no words at all every
target is 0; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BITS, LEVELS = 12, 5
#: Sources up to which the table of cuts (five numbers and a name each) is broadcast.
BROADCAST = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of every row; the key's bits are those that MD5 begins with."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    key = F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to rows of one source each (source, source_size).

    With targets of weight * level, cut off at ``most`` times the size, a source is cut off before another if its
    size by weight is smaller. If the sources before a place in that order are cut off and the rest share what is
    left, the level rises from place to place while these sources are cut off rightly, and falls after that: the
    level is the largest of all places'.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((place - 1) % len(weights) + 1).cast("int"))
    full = (F.col("source_size") * most).cast("double")
    rows = by_source.withColumn("_w", weight).withColumn("_full", full)
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("_full").over(before), F.lit(0.0))
    rest = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / rest)
    return rows.withColumn("target", F.least(F.col("_full"), F.col("_w") * F.max("_level").over(whole))).drop("_w", "_full", "_level")


def _bucket(level: int) -> Column:
    """The bits of one level: of the key for the first LEVELS, then of the row's place."""
    of, at = ("key", level) if level < LEVELS else ("place", level - LEVELS)
    return F.shiftright(F.col(of), BITS * (LEVELS - 1 - at)).bitwiseAND((1 << BITS) - 1)


def _joined(rows: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """Rows with what is known of their source; a null source meets its own."""
    named = cuts.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def cuts(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """source, cut, cut_place of each source with a budget (source, left: words): rows below them are within it.

    ``rows`` has source, size, key and place. A level's histogram has 4,096 rows of a source at most, and the next
    level reads the rows of one of its buckets only.
    """
    held, state, ended = rows.where("size > 0"), budgets.select("source", "left", *(F.lit(0).cast("long").alias(c) for c in ("cut", "cut_place"))), []
    for level in range(2 * LEVELS):
        histogram = held.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = _joined(histogram, state, few).withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
        ends = upto.groupBy("source", "left", "cut", "cut_place").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("b", "words", "n", "upto"))).alias("over"), F.max("b").alias("last"))
        # The bucket in which the budget runs out. A row that is alone in it goes in if that comes nearer to the budget.
        left = F.col("left") - (F.col("over.upto") - F.col("over.words"))
        taken = (F.col("over.n") == 1) & (F.col("over.words") <= 2 * left)
        to = F.coalesce(F.col("over.b") + taken.cast("long"), F.col("last") + 1)
        of, shift = "cut" if level < LEVELS else "cut_place", BITS * (LEVELS - 1 - level % LEVELS)
        found = ends.select("source", left.alias("left"), F.coalesce("over.n", F.lit(0)).alias("n"), *((F.col(c) + F.shiftleft(to, shift) if c == of else F.col(c)).alias(c) for c in ("cut", "cut_place")))
        found = written(found, "mixing-cuts")
        ended.append(found.where("n <= 1").select("source", "cut", "cut_place"))
        state = found.where("n > 1").select("source", "left", "cut", "cut_place")
        if state.isEmpty():
            break
        inside = F.shiftright(F.col(of), shift) == F.shiftright(F.col("key" if of == "cut" else "place"), shift)
        held = written(_joined(held, state, few).where(inside).select("source", "size", "key", "place"), "mixing-bucket")
    return reduce(DataFrame.unionByName, ended)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    rows = written(sizes(docs), "mixing-sizes")
    place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index")).bitwiseAND((1 << BITS * LEVELS) - 1)
    rows = rows.select("*", place.alias("place"))
    aims = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mixing-targets")
    few = aims.count() <= BROADCAST
    # Whole times that all of a source is taken, and the words that are wanted besides.
    aims = aims.withColumn("times", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    budgets = aims.select("source", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long").alias("left"))
    found = aims.join(cuts(rows, budgets, few).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    below = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("place") < F.col("cut_place")))
    taken = F.col("size") * F.least(F.lit(most), F.col("times") + F.coalesce(below, F.lit(False)).cast("long"))
    return _joined(rows, found, few).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("source")


#: The same cuts by sorting: running sums of words by key.
OP13_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5e0 - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(most, w * (max(level) OVER ())) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.times, CAST(round(b.target - b.times * b.source_size) AS BIGINT) AS budget,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * least(2, times + CASE WHEN upto <= budget OR (upto - size < budget AND size <= 2 * (budget - upto + size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
