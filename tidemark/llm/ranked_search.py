"""Ranked lexical search over a K2-treap of the grid of terms and documents.

A first pass over the texts keeps, for each document, its length and the counts of those terms that some item asks
for; from these come the corpus' counts. Then the documents are taken in blocks of ``BLOCK`` columns. A block's grid
has the items' terms as rows, the heaviest first, and its documents as columns, the shortest first; a cell's value is
the term's share of the document's score. The grid is kept as a quadtree of its filled cells only: of each level's
cells the largest value below, which of the four cells below are filled, and where they begin. For an item the
rows' paths go down together: a range of documents has one cell for each of the item's terms, and the sum of their
values bounds the score of all its documents. The best ranges are opened first, until no range can hold a document
that belongs to the best ``k``; scores of single documents are exact. The least of a task's best scores so far bounds
its further blocks.

Each task gives k documents for an item at most; these meet by item and part of the tasks first, then by item. Items
are asked in groups of bounded bytes (``ITEM_BYTES``), one pass over the texts each, so what a task holds of them does
not grow with their number.

Edge cases: null and empty texts have no terms, are no documents for the counts and are never found; an item without
terms finds nothing; rows of equal doc_id are documents of their own, a null doc_id comes last among equal scores;
items of equal item_id are ranked each by itself, those with equal text once; documents of score 0 are not found;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import schema_of, table, text_slices, tidy, with_columns, written

K, BLOCK, ITEM_BYTES = 50, 16_384, 4_000_000
#: Ranges of documents that are opened at a time, and bytes of a text that are split at a time.
OPENED, PIECE = 256, 1 << 20
_PARTS = 64
#: Bytes of terms stay (letters lower-cased), all others become spaces.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[str]:
    """All terms of a short text in order; only A-Z are lower-cased."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return _TERM.findall(low)


def term_bytes(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text of any length, piece by piece."""
    text, start = text.translate(_TERM_BYTES), 0
    while start < len(text):
        end = len(text)
        if end - start > PIECE:
            cut = text.rfind(b" ", start, start + PIECE)
            end = cut if cut >= start else text.find(b" ", start + PIECE)
            end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end + 1


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n, terms, counts: every document with a term; ``terms`` are numbered by their place."""
    number = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            for part in text_slices(batch):
                n, held, counts = [], [], []
                for text in part.column("text").cast(pa.large_binary()):
                    found: Counter[bytes] = Counter()
                    length = 0
                    for piece in term_bytes(text.as_py() or b""):
                        length += len(piece)
                        found.update(filter(known.__contains__, piece))
                    n.append(length)
                    held.append([known[t] for t in found])
                    counts.append(list(found.values()))
                out = with_columns(part, ["doc_id"], n=pa.array(n, pa.int64()), terms=pa.array(held, pa.list_(pa.int32())), counts=pa.array(counts, pa.list_(pa.int64())))
                yield out.filter(pa.array([x > 0 for x in n]))

    return docs.select("doc_id", "text").mapInArrow(count, f"{schema_of(docs, 'doc_id')}, n long, terms array<int>, counts array<long>")


class Grid:
    """A K2-treap: the filled cells of a square grid, level by level from the cell that holds all to single cells.

    Cells of a level are in Z-order, so the four below one stand together from ``first`` on; ``filled`` has a bit for
    each of the four, ``top`` the largest value below.
    """

    #: Filled cells among the four before each of them.
    BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, bits: int):
        code = np.zeros(len(row), np.int64)
        for b in range(bits):
            code |= ((row >> b) & 1) << (2 * b + 1) | ((column >> b) & 1) << (2 * b)
        order = np.argsort(code)
        code, top = code[order], value[order]
        self.bits, self.top, self.filled, self.first = bits, [top], [], []
        for _ in range(bits):
            quarter, code = code & 3, code >> 2
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            top = np.maximum.reduceat(top, starts)
            self.filled.append(np.bitwise_or.reduceat(1 << quarter, starts))
            self.first.append(starts)
            self.top.append(top)
            code = code[starts]

    def below(self, level: int, cells: np.ndarray, row_bit: np.ndarray, column_bit: int) -> np.ndarray:
        """The cells under ``cells`` of a level in the rows' and columns' halves; -1 where nothing is."""
        filled, quarter = self.filled[level - 1][cells], 2 * row_bit + column_bit
        there = (cells >= 0) & ((filled >> quarter) & 1 == 1)
        return np.where(there, self.first[level - 1][cells] + self.BEFORE[filled, quarter], -1)

    def bound(self, level: int, cells: np.ndarray) -> np.ndarray:
        return np.where(cells >= 0, self.top[level][cells], 0).sum(axis=1)

    def best(self, rows: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of all columns that may be among the k best and score ``least`` or more.

        Pending ranges of documents wait by level; the ones of highest bounds are opened, ``OPENED`` at a time.
        """
        columns, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        start = np.zeros((1, len(rows)), np.int64)
        pending = {self.bits: (np.zeros(1, np.int64), start, self.bound(self.bits, start))}
        while pending:
            bounds = np.concatenate([p[2] for p in pending.values()])
            line = max(least, 1) if len(bounds) <= OPENED else max(least, 1, int(np.partition(bounds, len(bounds) - OPENED)[len(bounds) - OPENED]))
            opened, waiting = {}, {}
            for level, (at, cells, bound) in pending.items():
                now, later = bound >= line, (bound < line) & (bound >= max(least, 1))
                if now.any():
                    opened[level] = at[now], cells[now]
                if later.any():
                    waiting[level] = at[later], cells[later], bound[later]
            pending = waiting
            for level, (at, cells) in opened.items():
                row_bit = (rows >> (level - 1)) & 1
                for column_bit in (0, 1):
                    under = self.below(level, cells, row_bit, column_bit)
                    bound = self.bound(level - 1, under)
                    keep = bound >= max(least, 1)
                    got = (2 * at + column_bit)[keep], under[keep], bound[keep]
                    if level == 1:
                        columns, scores = np.concatenate([columns, got[0]]), np.concatenate([scores, got[2]])
                    elif keep.any():
                        pending[level - 1] = tuple(np.concatenate(x) for x in zip(pending[level - 1], got)) if level - 1 in pending else got
            if len(scores) > k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                able = scores >= least
                columns, scores = columns[able], scores[able]
        return columns, scores


def _values(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A term's share of a document's score, in integers."""
    m = 50 + (50 * n * documents) // terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _best(held: dict, ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> dict:
    """An item's k best of those held and new ones: highest scores first, then smallest ids, nulls last."""
    if held:
        ids, known, scores = (np.concatenate([held[f], new]) for f, new in (("ids", ids), ("known", known), ("scores", scores)))
    order = np.lexsort((ids, ~known, -scores))[:k]
    return {"ids": ids[order], "known": known[order], "scores": scores[order]}


def search(found: DataFrame, items: list[tuple[int, list[int]]], weights: np.ndarray, documents: int, terms: int, k: int = K, block: int = BLOCK) -> DataFrame:
    """item (its place in ``items``), doc_id, score: each task's k best documents of an item."""
    shared = found.sparkSession.sparkContext.broadcast((items, weights))

    @tidy
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best: dict[int, dict] = {}
        # Heavy terms are neighbours, so that cells of a level hold like values.
        place = np.argsort(np.argsort(-weight, kind="stable"), kind="stable").astype(np.int64)

        def settle(parts: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(parts).combine_chunks()
            id_column = whole.column("doc_id").combine_chunks().cast(pa.int64())
            known, ids = np.asarray(id_column.is_valid()), id_column.fill_null(0).to_numpy(zero_copy_only=False)
            n = whole.column("n").to_numpy()
            lists = whole.column("terms").combine_chunks()
            document = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            term = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            tf_lists = whole.column("counts").combine_chunks()
            tf = tf_lists.values.to_numpy(zero_copy_only=False)[tf_lists.offsets[0].as_py() : tf_lists.offsets[-1].as_py()]
            if not len(term):
                return
            order = np.argsort(n, kind="stable")
            column = np.empty(len(n), np.int64)
            column[order] = np.arange(len(n))
            value = _values(n[document], tf, weight[term], documents, terms)
            bits = max(1, int(max(len(n), len(weight)) - 1).bit_length())
            grid = Grid(place[term], column[document], value, bits)
            for i, (_, rows) in enumerate(asked):
                before = best.get(i)
                least = int(before["scores"][-1]) if before and len(before["scores"]) == k else 1
                columns, scores = grid.best(place[rows], k, least)
                if len(columns):
                    at = order[columns]
                    best[i] = _best(before or {}, ids[at], known[at], scores, k)

        parts, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - rows)
                parts.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == block:
                    settle(parts)
                    parts, rows = [], 0
        if parts:
            settle(parts)
        for i, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b["ids"]), i, np.int64)), pa.array(b["ids"], mask=~b["known"]), pa.array(b["scores"])], ["item", "doc_id", "score"])

    return found.mapInArrow(ranked, "item long, doc_id long, score long")


def rank_items(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) the k best rows of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    asked = written(items.select("item_id", "text").distinct().withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)) + 64), "search-items")
    groups = max(1, -(-(asked.agg(F.sum("_bytes")).first()[0] or 0) // ITEM_BYTES))
    outs = []
    for g in range(groups):
        # Items of one group are within ITEM_BYTES by their hash, give or take; a longer item is a group's own cost.
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        listed = [(r["item_id"], sorted(set(terms_of(r["text"])))) for r in mine.collect()]
        outs.append(_ranked_group(spark, docs, listed, schema_of(asked, "item_id"), k))
    out = outs[0]
    for other in outs[1:]:
        out = out.unionByName(other)
    return out


def _ranked_group(spark: SparkSession, docs: DataFrame, items: list[tuple[object, list[str]]], id_schema: str, k: int) -> DataFrame:
    terms = sorted({t for _, ts in items for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    found = written(postings(docs, terms), "search-postings")
    total = found.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a number for each term of the group
    weights = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    places = [(i, [number[t] for t in ts]) for i, (_, ts) in enumerate(items)]
    per_task = search(found, [(i, rows) for i, rows in places if rows] or [(0, [])], weights, total["documents"], total["terms"], k)
    asked = [i for i, rows in places if rows]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    # By item and part first, so that no task meets all tasks' lists of an item.
    part = per_task.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS))).withColumn("r", first("item", "part")).where(F.col("r") <= k)
    top = part.select("item", "doc_id", "score").withColumn("rank", first("item")).where(F.col("rank") <= k)
    names = spark.createDataFrame([(j, items[i][0]) for j, i in enumerate(asked)], f"item long, {id_schema}")
    return top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY row),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT row, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT q.item_id, q.text, p.row, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * d.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.row = p.row, c GROUP BY ALL),
r AS (SELECT s.item_id, d.doc_id, s.score, row_number() OVER (PARTITION BY s.item_id, s.text ORDER BY s.score DESC, d.doc_id NULLS LAST) AS rank FROM s JOIN d USING (row) WHERE s.score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
