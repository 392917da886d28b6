"""Fingerprints of sets of rows that do not depend on how the rows are laid out, and comparisons of lineages by them.

Keys are dealt into segments by their own digest, ordered there, and hashed in blocks of ``BLOCK``; a group's fingerprint is
the hash of its blocks' hashes in order. Equal sets (repeated rows counted) have equal fingerprints under any
partitioning, and no row or task holds more than a segment's part of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1000


def fingerprints(rows: DataFrame, by: list[str], key: Column) -> DataFrame:
    """by, n and fingerprint of each group; a null key counts as the empty string."""
    keyed = rows.select(*by, F.coalesce(key, F.lit("")).alias("_key"))
    dealt = keyed.withColumn("_segment", F.substring(F.sha2("_key", 256), 1, 2))
    place = F.row_number().over(Window.partitionBy(*by, "_segment").orderBy("_key")) - 1
    blocks = dealt.withColumn("_block", F.floor(place / BLOCK)).groupBy(*by, "_segment", "_block").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("_key")).alias("_keys"))
    hashed = blocks.select(*by, "_n", F.struct("_segment", "_block", F.sha2(F.array_join("_keys", ","), 256).alias("_hash")).alias("_part"))
    whole = hashed.groupBy(*by).agg(F.sum("_n").alias("n"), F.sort_array(F.collect_list("_part")).alias("_parts"))
    return whole.select(*by, "n", F.sha2(F.array_join(F.transform("_parts", lambda p: p["_hash"]), ","), 256).alias("fingerprint"))


#: The same in SQL, of rows (by, key).
def fingerprint_sql(source: str, by: str, key: str, name: str) -> str:
    return f"""{name}_k AS (SELECT {by}, coalesce({key}, '') AS key FROM {source}), {name}_p AS (SELECT *, substring(sha256(key), 1, 2) AS segment FROM {name}_k),
{name}_r AS (SELECT *, (row_number() OVER (PARTITION BY {by}, segment ORDER BY key) - 1) // {BLOCK} AS block FROM {name}_p),
{name}_b AS (SELECT {by}, segment, block, count(*) AS n, sha256(string_agg(key, ',' ORDER BY key)) AS hash FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(hash, ',' ORDER BY segment, block)) AS fingerprint FROM {name}_b GROUP BY ALL)"""


def compared(candidate: DataFrame, others: dict[str, DataFrame], by: str) -> DataFrame:
    """Each group's fingerprint in the candidate's lineage, whether every other lineage has the same, and what is amiss.

    All have (by, n, fingerprint); a group that only some have is amiss too.
    """
    out = candidate.select(by, F.col("n").alias("rows"), "fingerprint")
    for name, other in others.items():
        side = other.select(by, F.col("fingerprint").alias(f"_{name}"))
        out = out.join(side, by, "full")
    same = {name: F.coalesce(F.col(f"_{name}") == F.col("fingerprint"), F.lit(False)) for name in others}
    issues = F.concat_ws(",", F.when(F.col("fingerprint").isNull(), "candidate_missing"), *(F.when(F.col(f"_{n}").isNull(), f"{n}_missing").when(~s, f"{n}_differs") for n, s in same.items()))
    return out.select(by, F.coalesce("rows", F.lit(0)).alias("rows"), issues.alias("issues"), (issues == "").alias("comparable"))
