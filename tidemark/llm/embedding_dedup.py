"""Embedding near-dedup with randomised-rotation binary codes and stored correction factors.

A unit vector is rotated at random and kept as its signs, with the factor that the signs lose: the inner product
of the signs with another rotated vector, divided by the factor, is an unbiased estimate of the cosine, and its
deviation has a bound that the factor gives. Only pairs whose upper bound reaches the threshold are computed
anew, in double precision. Pairs to look at come from groups of equal code pieces (bands of sign bits from
further rotations), as many as give a pair at the threshold a chance of at least ``RECALL`` to meet; closer pairs
meet more surely. Equal vectors are one from the start. A large group is dealt into blocks, and each pair of
blocks is a task's work, so no task sees a whole group; pairs are counted there, never listed, each in the
first band in which it meets, and only a spanning forest of the links leaves the task.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label
or a null vec_id, link with nothing and stand alone (kept, with no links); equal vec_ids are rows of their own;
vectors of different lengths do not meet; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import connected_components, forest

THRESHOLD, RECALL = 0.93, 0.98
#: Width of the confidence bound in standard deviations.
WIDTH = 4.0
#: Rows of a block, so a task's matrices hold BLOCK * BLOCK numbers at most.
BLOCK = 1024


def rotation(dimension: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dimension]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def band_plan(rows: int) -> tuple[int, int]:
    """(bits of a band, bands): bands get longer with the number of rows, so groups keep their size."""
    bits = min(24, max(6, round(math.log2(max(2, rows))) - 6))
    meet = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def band_codes(vectors: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """An integer of sign bits for each vector and band; each rotation gives as many bits as it has rows."""
    d = vectors.shape[1]
    need, signs = bits * bands, []
    for k in range(math.ceil(need / d)):
        signs.append(vectors @ rotation(d, 1000 + k).T >= 0)
    flat = np.concatenate(signs, axis=1)[:, :need].reshape(len(vectors), bands, bits)
    return (flat @ (1 << np.arange(bits))).astype(np.int32)


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(embedding) > 0) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_estimates(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate of every cosine, bound of each row's deviation) from one rotation's sign codes."""
    d = units.shape[1]
    turned = units @ rotation(d, 1).T
    codes = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(d)
    factor = (codes * turned).sum(axis=1)
    bound = WIDTH * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1))
    return (codes @ turned.T) / factor[:, None], bound


def links_in_block(units: np.ndarray, codes: np.ndarray, band: int, side: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs i < j that link and meet in no earlier band; across the two sides where ``both``, else within."""
    estimate, bound = sign_estimates(units)
    maybe = np.triu(estimate + bound[:, None] >= THRESHOLD - 1e-9, 1)
    if both:
        maybe &= side[:, None] != side[None, :]
    i, j = np.nonzero(maybe)
    keep = []
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        keep.append((units[a] * units[b]).sum(axis=1) >= THRESHOLD)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    i, j = i[keep], j[keep]
    new = ~(codes[i, :band] == codes[j, :band]).any(axis=1)
    return i[new], j[new]


def near_duplicates(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    taking = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    taking = taking.withColumn("key", F.xxhash64("embedding"))
    single = taking.groupBy("label", "key", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    single = written(single, "embedding-single")
    bits, bands = band_plan(single.count())
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["embedding"].map(len)):
                codes = band_codes(_unit(_stack(part["embedding"])), bits, bands)
                yield part.assign(dim=int(d), codes=list(codes))

    label_type = single.schema["label"].dataType.simpleString()
    coded = single.drop("key").mapInPandas(encode, f"label {label_type}, embedding array<double>, rep long, copies long, dim int, codes array<int>")
    banded = coded.select("*", F.posexplode("codes").alias("band", "code"))
    at = ["label", "dim", "band", "code"]
    large = banded.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    dealt = banded.join(large.select(*at, "parts"), at).withColumn("part", F.pmod(F.xxhash64("rep", "band"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64(*at, "low", "high"), F.lit(groups)).cast("int"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, band, _, low, high), g in pdf.groupby([*at, "low", "high"], sort=False, dropna=False):
            if len(g) < 2:
                continue
            units = _unit(_stack(g["embedding"]))
            codes = np.stack([np.asarray(c, np.int32) for c in g["codes"]])
            i, j = links_in_block(units, codes, int(band), g["part"].to_numpy(), low != high)
            if len(i):
                copies, rep = g["copies"].to_numpy(), g["rep"].to_numpy()
                links = np.bincount(i, copies[j], len(g)) + np.bincount(j, copies[i], len(g))
                hit = np.flatnonzero(links)
                out.append(pd.DataFrame({"rep": rep[hit], "links": links[hit].astype(np.int64), "to": rep[forest(len(g), i, j)[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "to": []})

    found = dealt.select("task", "embedding", "rep", "copies", "codes", *at, "part", "low", "high").groupBy("task").applyInPandas(meet, "rep long, links long, to long")
    found = written(found, "embedding-links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")).where("a <> b"), "embedding-classes")
    reps = single.join(totals, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    reps = reps.select(F.col("label").alias("_label"), F.col("key").alias("_key"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = taking.join(reps, (F.col("label") == F.col("_label")) & (F.col("key") == F.col("_key")) & (F.col("embedding") == F.col("_embedding")))
    joined = joined.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    others = rows.where(~usable(F.col("embedding")) | F.col("label").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS k FROM l GROUP BY x), m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT e.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m.y, e.vec_id)) AS component_id, coalesce(m.y, e.vec_id) >= e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN m ON m.x = e.vec_id
"""
