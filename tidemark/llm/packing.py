"""Packing into training sequences by vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. The next segment of an open
sequence is, of all that fit, the one whose demands have the largest weighted dot product with what is left of
the limits. Documents may be cut: whole sequences come off a long document first, and where nothing fits a gap
any more, one piece is cut to its size. What is left at a task's end is dealt out in powers of two, which need
no padding. Examples of instruction data (``pack_examples``) are never cut.

Each task packs its own rows, so nothing is shuffled, memory is bounded by the pool of open remainders, and a
lost task repeats with the same result. Sequence ids hold the task's number above their own.

Edge cases: a null or empty text is the end id alone; an empty table gives an empty table; repeated rows are
packed each for itself; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_tokens
from .common import schema_of, table, text_slices

SEQUENCE = 2048
SEGMENTS = 64
#: Tokens of remainders from which a task packs, and down to which it goes while more rows follow.
POOL_HIGH, POOL_LOW = 1_500_000, 400_000
POOL_ITEMS = 4000
TASK_BITS = 36


def dot_product_pick(demand: np.ndarray, left: np.ndarray, weight: np.ndarray, free: np.ndarray) -> int:
    """Row of ``demand`` that fits ``left`` and lies best along it, or -1; the first of equals."""
    fits = free.copy()
    for column, room in zip(demand.T, left):
        fits &= column <= room
    if not fits.any():
        return -1
    score = demand @ (weight * left)
    return int(np.argmax(np.where(fits, score, -1.0)))


class Packer:
    """Remainders of one task, and the sequences made of them."""

    def __init__(self, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int | None = None, cut: bool = True):
        self.limits = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.cut, self.items, self.tokens = cut, [], 0

    def add(self, key: object, start: int, length: int, loss: int) -> None:
        self.items.append((key, start, length, loss))
        self.tokens += length

    def pack(self, down_to: int) -> Iterator[list[tuple]]:
        """Sequences, as lists of (key, start, length, loss), until at most ``down_to`` tokens are left over."""
        items = self.items
        demand = np.asfortranarray(np.array([(n, 1, b) for _, _, n, b in items], float).reshape(-1, 3))
        weight = demand.mean(axis=0) / self.limits**2 if len(items) else np.ones(3)
        free = np.ones(len(items), bool)
        while self.tokens > down_to and free.any():
            left, chosen = self.limits.copy(), []
            while left[0] >= 1 and left[1] >= 1:
                # The last segment is kept for a piece that is cut to fill the rest.
                i = dot_product_pick(demand, left, weight, free) if not (self.cut and left[1] == 1) else -1
                if i < 0 and self.cut:
                    able = free & (demand[:, 0] >= left[0])
                    if left[2] < left[0] or not able.any():
                        break
                    i, gap = int(np.argmax(np.where(able, demand[:, 0], -1.0))), int(left[0])
                    key, start, length, loss = items[i]
                    part = min(loss, gap)
                    chosen.append((key, start, gap, part))
                    left -= (gap, 1, part)
                    items[i] = (key, start + gap, length - gap, loss - part)
                    demand[i] = length - gap, 1, loss - part
                    free[i] = length > gap
                    continue
                if i < 0:
                    break
                chosen.append(items[i])
                left -= demand[i]
                free[i] = False
            if not chosen:  # an example beyond the limits stands alone
                i = int(np.argmax(free))
                chosen, free[i] = [items[i]], False
            self.tokens -= sum(x[2] for x in chosen)
            yield from self.in_powers(chosen) if self.cut else [chosen]
        self.items = [x for x, f in zip(items, free) if f]

    def in_powers(self, chosen: list[tuple]) -> Iterator[list[tuple]]:
        """A sequence that is not full becomes several, each as long as a power of two."""
        total = sum(x[2] for x in chosen)
        if total == self.limits[0]:
            yield chosen
            return
        chosen = chosen[::-1]
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            part = []
            while want:
                key, start, length, loss = chosen.pop()
                take = min(length, want)
                part.append((key, start, take, min(loss, take)))
                if take < length:
                    chosen.append((key, start + take, length - take, loss - min(loss, take)))
                want -= take
            yield part


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, with_ids: bool = False, tokens: int = SEQUENCE, segments: int = SEGMENTS) -> DataFrame:
    """One row for each piece: its document, place in it, place in its sequence, CRC and, if asked for, ids."""
    end = int(end_id).to_bytes(4, "little")
    docs = docs.select("doc_id", "text")
    schema = f"{schema_of(docs, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens int" + ", ids binary" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", *["ids"] * with_ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_tokens.load(vocabulary), TaskContext.get().partitionId() << TASK_BITS
        packer, held, rows, made = Packer(tokens, segments), {}, [], 0

        def emit(pieces: list[tuple]) -> None:
            """pieces: (doc_id, doc_tokens, start, ids)."""
            nonlocal made
            offset, total = 0, sum(len(p[3]) for p in pieces) // 4
            for doc, of, start, ids in pieces:
                row = (doc, start, len(ids) // 4, zlib.crc32(ids), of, task | made, offset, total)
                rows.append((*row, ids) if with_ids else row)
                offset += len(ids) // 4
            made += 1

        def settle(down_to: int) -> None:
            for chosen in packer.pack(down_to):
                emit([(held[k][0], held[k][1], start, held[k][3][(start - held[k][2]) * 4 :][: n * 4]) for k, start, n, _ in chosen])
            still = {x[0] for x in packer.items}
            for k in [k for k in held if k not in still]:
                del held[k]

        def frame(id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, pa.int32(), *[pa.binary()] * with_ids]
            out = pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names)
            rows.clear()
            return out

        number, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in text_slices(batch, limit=2_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, packed in zip(part.column("doc_id").to_pylist(), encoder.encode_packed(texts)):
                    packed += end
                    n = len(packed) // 4
                    for start in range(0, n - tokens + 1, tokens):
                        emit([(doc, n, start, packed[start * 4 : (start + tokens) * 4])])
                    if rest := n % tokens:
                        held[number] = (doc, n, n - rest, packed[-rest * 4 :])
                        packer.add(number, n - rest, rest, rest)
                        number += 1
                if packer.tokens > POOL_HIGH or len(packer.items) > POOL_ITEMS:
                    settle(min(POOL_LOW, packer.tokens // 4))
                if rows:
                    yield frame(id_type)
        settle(0)
        if rows:
            yield frame(id_type)

    return docs.mapInArrow(run, schema)


def pack_examples(examples: DataFrame, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int | None = None) -> DataFrame:
    """Whole examples (example_id, tokens, loss_tokens) into sequences under the three limits, never cut.

    Null counts are 0; an example beyond a limit gets a sequence of its own.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, packer, made = TaskContext.get().partitionId() << TASK_BITS, Packer(tokens, segments, loss, cut=False), 0

        def frame(down_to: int) -> pd.DataFrame:
            nonlocal made
            rows = []
            for chosen in packer.pack(down_to):
                offset = 0
                for k, (key, _, n, b) in enumerate(chosen):
                    rows.append((key, task | made, k, offset, n, b))
                    offset += n
                made += 1
            out = pd.DataFrame(rows, columns=["example_id", "sequence_id", "segment", "offset", "tokens", "loss_tokens"])
            return out

        for batch in batches:
            for key, n, b in zip(batch["example_id"], batch["tokens"], batch["loss_tokens"]):
                packer.add(key, 0, int(n), int(b))
            if packer.tokens > POOL_HIGH or len(packer.items) > POOL_ITEMS:
                yield frame(min(POOL_LOW, packer.tokens // 4))
        yield frame(-1)

    # Ids travel as text: pandas would turn numbers beside nulls into floating ones.
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).cast("long").alias(c)
    picked = examples.select(F.col("example_id").cast("string").alias("example_id"), count("tokens"), count("loss_tokens"))
    packed = picked.mapInPandas(run, "example_id string, sequence_id long, segment int, offset long, tokens long, loss_tokens long")
    return packed.withColumn("example_id", F.col("example_id").cast(examples.schema["example_id"].dataType))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
