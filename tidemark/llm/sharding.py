"""Sharding by jump consistent hashing, in DataFrame functions only.

Contract (law ``key``): the shard of a row depends on its key and the number of shards alone, and one more
shard takes rows only into itself.

Edge cases: a null key counts as key 0; a null text has size 1 and the CRC of the empty string; rows that are
equal in key, CRC and size get neighbouring slots in any order, which cannot be told apart; an empty table gives
an empty table; columns named shard, grown_shard or slot are replaced, all others are left alone and may have any
name. Rows of one key with different texts are numbered in different buckets, so a key (null, say) may hold any share
of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: The multiplier of the 64-bit linear congruential generator of jump hashing, in 16 and 32 bit limbs.
MULTIPLIER = 2862933555777941757
_M_HIGH, _M_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_M1, _M0 = _M_LOW >> 16, _M_LOW & 0xFFFF
_MASK = 0xFFFFFFFF

#: Steps that all rows make; a row that is not through after them (one in millions) goes on to the sure end.
COMMON_STEPS = 48


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 on two 32-bit limbs; no partial result leaves the signed 64-bit range."""
    low0, low1 = lo * _M0 + 1, lo * _M1
    low = low0.bitwiseAND(_MASK) + F.shiftleft(low1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(low0, 32) + F.shiftright(low1, 16) + F.shiftright(low, 32)
    high = carry + (lo * _M_HIGH).bitwiseAND(_MASK) + hi * _M0 + F.shiftleft((hi * _M1).bitwiseAND(0xFFFF), 16)
    return high.bitwiseAND(_MASK), low.bitwiseAND(_MASK)


def _limbs(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(_MASK)


def jump_hash(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the bucket of ``key`` among ``shards`` and among ``shards`` + 1."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    hi, lo = _limbs(key)
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("kept"))

    def advance(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        j = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1))).cast("long")
        live = s["j"] <= shards
        return F.struct(
            F.when(live, hi).otherwise(s["hi"]).alias("hi"),
            F.when(live, lo).otherwise(s["lo"]).alias("lo"),
            F.when(live, s["j"]).otherwise(s["b"]).alias("b"),
            F.when(live, j).otherwise(s["j"]).alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["kept"]).alias("kept"),
        )

    walk = lambda at, a, b: F.aggregate(F.sequence(F.lit(a), F.lit(b)), at, advance)
    # j grows with every step, so shards + 1 steps always end the walk.
    out = walk(start, 1, min(shards + 1, COMMON_STEPS))
    if shards + 1 > COMMON_STEPS:
        out = F.when(out["j"] > shards, out).otherwise(walk(out, COMMON_STEPS + 1, shards + 1))
    return F.struct(out["kept"].cast("int").alias("shard"), out["b"].cast("int").alias("grown"))


def assign_shards(df: DataFrame, key: str, shards: int, order: list[str], spread: str | None = None, buckets: int = 4096) -> DataFrame:
    """Add shard, grown_shard and slot, a number without gaps from 0 in each shard.

    A shard's rows are numbered in ``buckets`` hash buckets side by side, and each bucket starts after the rows
    of those before it. The table of starts has shards * buckets rows at most, so it is broadcast whatever the
    input's size; no task ever sorts a whole shard. ``spread`` is a number that differs between rows of one key: it
    moves them to different buckets of their shard.
    """
    hi, lo = _limbs(F.col(key))
    bucket = (_step(hi, lo)[0] + (F.coalesce(F.col(spread).cast("long"), F.lit(0)) if spread else 0)).bitwiseAND(buckets - 1).cast("int")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "grown_shard", "slot")]
    placed = df.select(F.struct(*kept).alias("_row"), F.struct(*order).alias("_order"), jump_hash(F.col(key), shards).alias("_jump"), bucket.alias("_bucket"))
    placed = placed.select("_row", "_order", "_bucket", "_jump.shard", F.col("_jump.grown").alias("grown_shard"))
    sizes = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_order")) - 1)
    slot = (F.col("_start") + F.col("_at")).cast("long").alias("slot")
    return numbered.join(F.broadcast(starts), ["shard", "_bucket"]).select("_row.*", "shard", "grown_shard", slot)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(sized, "doc_id", shards, ["doc_id", "text_crc32", "size"], "text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"), 8)


#: CRC-32 bit by bit and the walk of jump hashing, for small tables.
OP2_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n + 1 AS size, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(n), lambda i: CAST('0x' || substring(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(t[CAST(xor(c & 255, b) + 1 AS BIGINT)], c >> 8)), 4294967295) AS text_crc32 FROM d, tab),
a AS (SELECT *, CAST(CASE WHEN coalesce(doc_id, 0) < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE coalesce(doc_id, 0) END AS UHUGEINT) AS k0 FROM c),
g AS (SELECT *, list_reduce(list_transform(range(10), lambda i: {'k': k0, 'b': CAST(0 AS BIGINT), 'j': CAST(0 AS BIGINT), 'kept': CAST(0 AS BIGINT)}), lambda s, x: CASE WHEN s.j > 8 THEN s ELSE
    {'k': (s.k * 2862933555777941757 + 1) % 18446744073709551616, 'b': s.j,
     'j': CAST(floor((s.j + 1) * (2147483648e0 / CAST(((s.k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1 AS DOUBLE))) AS BIGINT),
     'kept': CASE WHEN s.j < 8 THEN s.j ELSE s.kept END} END) AS s,
  CAST((((k0 * 2862933555777941757 + 1) % 18446744073709551616) // 4294967296 + text_crc32) % 4096 AS BIGINT) AS bucket FROM a)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(s.kept AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY s.kept ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, CAST(s.b AS INTEGER) AS grown_shard FROM g
"""
