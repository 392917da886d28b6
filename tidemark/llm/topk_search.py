"""Exact top-k inner-product search without random access.

For each component a block of vectors has a list sorted by value, which a query reads from its best end. Reading
goes on in all lists at once; a vector's score lies between what was read of it plus the worst of the lists it
was not yet met in, and the same with the lists' current values. Reading stops when few enough vectors can still
reach the k-th best lower bound; outsiders cannot qualify, and the final scores of the rest are resolved.

Queries and candidates meet in blocks of bounded size, so the work is spread over (queries / block) *
(candidates / block) groups, and each gives at most k rows for a query.

Edge cases: vectors that are null, empty or hold null or non-finite components, and rows with a null vec_id, take
no part; vectors of another length than the query's are no candidates; equal scores go to the smaller vec_id,
of queries with equal vec_id the smallest vector asks; a query's own vec_id is no candidate; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, SCALE = 5, 256
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Shares of the lists that were read when the bounds are looked at; after the last, all that is left is resolved.
DEPTHS = (0.5, 0.7, 0.85)


class SortedLists:
    """A block's components as lists in rising order, and the ranks of its vectors in them."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.exact = rows.astype(float), rows
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, order, axis=0)
        self.rank = np.empty(rows.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(rows), dtype=np.int32)[:, None], axis=0)

    def read(self, queries: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores once ``upto`` entries of each list were read, for all queries at once.

        A query reads a list from its high end where its own component is positive, else from its low end.
        """
        n = len(self.rows)
        lower = upper = 0.0
        for q, met, front, worst in (
            (np.maximum(queries, 0), self.rank >= n - upto, self.values[n - upto], self.values[0]),
            (np.minimum(queries, 0), self.rank < upto, self.values[upto - 1], self.values[-1]),
        ):
            done = q @ np.where(met, self.rows, 0).T
            unmet = (~met).T.astype(float)
            lower = lower + done + (q * worst) @ unmet
            upper = upper + done + (q * front) @ unmet
        return lower, upper

    def candidates(self, queries: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """For each query the positions of all vectors that may be among its k best."""
        n = len(self.rows)
        out: list[np.ndarray] = [np.arange(n)] * len(queries)
        left = np.flatnonzero(k < n) if n > 64 else np.empty(0, np.int64)
        for share in DEPTHS:
            if not len(left):
                break
            lower, upper = self.read(queries[left], max(1, int(np.ceil(share * n))))
            slack = 1e-9 * np.abs(upper).max(initial=1.0)
            most = int(k[left].max())
            lines = -np.partition(-lower, range(most), axis=1)[:, :most]
            may = upper + slack >= lines[np.arange(len(left)), k[left] - 1][:, None]
            few = may.sum(axis=1) <= max(4 * K, n // 16)
            for i in np.flatnonzero(few):
                out[left[i]] = np.flatnonzero(may[i])
            left = left[~few]
        return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows (vec_id, q: integer components) of each query."""
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    both = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), both(row_blocks).alias("rb"))
    right = rows.select("vec_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("rb"), both(query_blocks).alias("qb"))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            ids, block = held["vec_id"].to_numpy(), np.stack(held["q"].to_numpy())
            order = np.argsort(ids, kind="stable")
            ids, block = ids[order], block[order]
            lists = SortedLists(block)
            for start in range(0, len(asked), 256):
                part = asked.iloc[start : start + 256]
                asking, vectors = part["vec_id"].to_numpy(), np.stack(part["q"].to_numpy())
                # As many more than k are kept as the query has rows of its own in this block.
                own = np.searchsorted(ids, asking, "right") - np.searchsorted(ids, asking, "left")
                for query_id, q, at in zip(asking, vectors, lists.candidates(vectors.astype(float), k + own)):
                    at = at[ids[at] != query_id]
                    scores = block[at] @ q
                    best = np.lexsort((ids[at], -scores))[:k]
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at][best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = left.groupBy("rb", "qb", "dim").cogroup(right.groupBy("rb", "qb", "dim")).applyInPandas(search, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): components times ``scale``, rounded down, of all usable vectors."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    able = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    return able.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(rows, rows.where("vec_id % 50 = 0").groupBy("vec_id").agg(F.min("q").alias("q")))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON b.vec_id <> a.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
