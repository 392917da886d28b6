"""Exact substring dedup: every byte covered by a 200-byte string that also starts elsewhere is removed.

Texts are parsed into phrases (see ``phrases``): a phrase is the stretch of the windows that share a trigger, so
each 200-byte window lies in one phrase whole, and two equal windows lie in phrases of equal core. The dictionary
holds each distinct phrase once, the parse how often it occurs. A phrase that occurs twice is repeated as a whole;
one whose core stands alone holds no repeat. What is left are different phrases around one core. Their suffixes
are sorted: a suffix array of the dictionary, by doubling, to a depth of 200 bytes, with the parse's counts summed
over equal ranks. Phrases overlap by a window, so the order of the parse beyond a phrase decides nothing here,
and no suffix array of the whole parse is needed. Cores with more than ``HOT`` phrases (a passage in very many
documents) are settled window by window in partial aggregates in place of one task's suffix array.

Phrases and windows are told apart by 64-bit and 128-bit hashes; texts that are equal share their result.

Edge cases: null and empty texts have no bytes and keep the hash of the empty string; texts below 200 bytes are
kept whole; repeated rows (of whatever doc_id) repeat each other's strings, so they go if they are 200 bytes long;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE, hold, schema_of, table, text_slices, tidy, with_columns, written
from .phrases import CORE, WINDOW, Block

#: Distinct phrases of one core that a task's suffix array takes: below 2**21 bytes, whatever the corpus's size.
HOT = 6000
#: Texts that a task remembers, phrases that it counts at once, and bytes of phrases that a task sorts, about.
MET, COUNTED, SORTED_BYTES = 200_000, 500_000, 1_000_000
#: Bytes of phrases whose suffixes are sorted at once, unless one core alone has more.
LOT = 250_000


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    """Slices of texts with their phrases: core, phrase, text (its place in the slice), at, width."""
    hold()
    for batch in batches:
        for part in text_slices(batch, limit=2 * SLICE):
            block = Block([(t or "").encode() for t in part.column("text").to_pylist()])
            doc, first, last, trigger = block.phrases()
            yield part, {
                "core": _i64(block.hashes(trigger, trigger + CORE)), "phrase": _i64(block.hashes(first, last + WINDOW)),
                "text": doc, "at": (first - block.offsets[doc]).astype(np.int32), "width": (last - first + 1).astype(np.int16),
            }


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """core, phrase, text_hash, at, width: the phrases of a batch's texts, by place in their text.

    A text that the task has met already gives nothing new (of the last texts, as many as ``MET`` are remembered).
    """
    met: dict[int, None] = {}
    for part, p in _phrases(batches):
        hashes = part.column("text_hash").to_numpy()
        new = np.array([h not in met and met.setdefault(h) is None for h in hashes.tolist()], bool)
        while len(met) > MET:
            del met[next(iter(met))]
        text = p.pop("text")
        if not (keep := new[text]).all():
            text, p = text[keep], {k: v[keep] for k, v in p.items()}
        yield pa.RecordBatch.from_pydict({"core": p["core"], "phrase": p["phrase"], "text_hash": hashes[text], "at": p["at"], "width": p["width"]})


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """core, phrase, times: the dictionary of each million phrases or so, each phrase once."""
    cores, phrases, held = [], [], 0

    def dictionary() -> pa.RecordBatch:
        core, phrase = np.concatenate(cores), np.concatenate(phrases)
        order = np.lexsort((core, phrase))
        core, phrase = core[order], phrase[order]
        starts = np.flatnonzero(np.concatenate([[True], (core[1:] != core[:-1]) | (phrase[1:] != phrase[:-1])]))
        return pa.RecordBatch.from_pydict({"core": core[starts], "phrase": phrase[starts], "times": np.diff(np.concatenate([starts, [len(core)]]))})

    for _, p in _phrases(batches):
        cores.append(p["core"])
        phrases.append(p["phrase"])
        held += len(p["core"])
        if held > COUNTED:
            yield dictionary()
            cores, phrases, held = [], [], 0
    if held:
        yield dictionary()


def _squeezer(columns: list[str]):
    """Texts packed under the name of the text column, other columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_slices(batch):
                packed = pa.array([packer.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())
                yield with_columns(part, columns, packed=packed)

    return tidy(run)


def suffix_ranks(raw: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Rank of the ``WINDOW`` bytes from each place on, equal for equal bytes in the same group (numbered from 0).

    Prefix doubling over the dictionary: 5 bytes first, then twice as many in each round; a window is two
    overlapping stretches of 160. Places with less than a window behind them get ranks without meaning.
    """
    n = len(raw)
    bits = np.uint64(n.bit_length())

    def rank(key: np.ndarray) -> np.ndarray:
        if n < 1 << 21:  # a key and its place fit into 64 bits, so the sort is in place
            key <<= bits
            key |= np.arange(n, dtype=np.uint64)
            key.sort()
            order = (key & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
            key >>= bits
        else:
            order = np.argsort(key)
            key = key[order]
        step = np.zeros(n, bool)
        np.not_equal(key[1:], key[:-1], out=step[1:])
        del key
        out = np.empty(n, np.uint32)
        out[order] = np.cumsum(step, dtype=np.uint32)
        return out

    def both(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        key = high.astype(np.uint64)
        key <<= bits
        key |= low
        return key

    def first(span: int) -> np.ndarray:
        key, wide = np.zeros(n, np.uint64), np.concatenate([raw, np.zeros(span, np.uint8)])
        for k in range(span):
            key <<= np.uint64(8)
            key |= wide[k : n + k]
        return key

    shifted = lambda r, by: np.concatenate([r[by:], np.zeros(min(by, n), r.dtype)])
    span = 5
    ranks = rank(both(rank(first(span)), groups))
    while span < WINDOW // 2:
        ranks = rank(both(ranks, shifted(ranks, span)))
        span *= 2
    return rank(both(ranks, shifted(ranks, WINDOW - span)))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _repeated(bytes_: list[bytes], cores: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    lengths = np.array([len(b) for b in bytes_], np.int64)
    offsets = np.cumsum(lengths) - lengths
    raw = np.frombuffer(b"".join(bytes_), np.uint8)
    _, group = np.unique(cores, return_inverse=True)
    ranks = suffix_ranks(raw, np.repeat(group.astype(np.uint32), lengths))
    windows = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[owner]
    total = np.bincount(ranks[place], times[owner], len(raw))
    again = total[ranks[place]] >= 2
    return np.split(again, np.cumsum(windows)[:-1])


def repeated_windows(bytes_: list[bytes], cores: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """Of each phrase of a dictionary: which of its windows occur twice at least, by the parse's counts.

    Different cores have no window in common, so they are sorted in lots of whole cores of about ``LOT`` bytes.
    """
    order = np.argsort(cores, kind="stable")
    ends = np.cumsum([len(bytes_[i]) for i in order])
    last = np.flatnonzero(np.append(cores[order][1:] != cores[order][:-1], True))  # phrase of each core
    out: list[np.ndarray] = [None] * len(order)
    start = 0
    while start < len(order):
        before = ends[start - 1] if start else 0
        fit = np.searchsorted(ends[last], before + LOT, "right") - 1
        stop = int(last[max(fit, np.searchsorted(last, start))]) + 1
        lot = order[start:stop]
        for i, flags in zip(lot, _repeated([bytes_[i] for i in lot], cores[lot], times[lot])):
            out[i] = flags
        start = stop
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """text_hash, first, last: starts of repeated windows, as runs, of the texts of ``docs`` (text, text_hash)."""
    shape = "core long, phrase long, text_hash long, at int, width short"
    counted = docs.mapInArrow(tidy(_counted), "core long, phrase long, times long").repartition("core")
    dictionary = counted.groupBy("core", "phrase").agg(F.sum("times").alias("times"))
    of_core = Window.partitionBy("core")
    dictionary = dictionary.withColumns({"all": F.sum("times").over(of_core), "phrases": F.count(F.lit(1)).over(of_core), "least": F.min("times").over(of_core)})
    # Either repeated as a whole, or beside another phrase of its core.
    dictionary = dictionary.where(F.col("all") >= 2).select("core", "phrase", "times", "phrases", ((F.col("phrases") > 1) & (F.col("least") == 1)).alias("mixed"))
    dictionary = written(dictionary, "suffix-dictionary")

    # Equal texts of several tasks stay in here; what they give is made distinct where it is gathered by text.
    met = written(docs.mapInArrow(tidy(_placed), shape).join(dictionary, ["core", "phrase"]), "suffix-met")
    whole = met.where("times >= 2").select("text_hash", F.col("at").alias("first"), (F.col("at") + F.col("width") - 1).alias("last"))

    # The bytes of each phrase that needs its suffixes sorted, from one of its occurrences.
    sources = met.where("mixed").groupBy("core", "phrase").agg(F.min(F.struct("text_hash", "at", "width", "times", "phrases")).alias("s")).select("core", "phrase", "s.*")
    wanted = sources.groupBy("text_hash").agg(F.collect_list(F.struct("core", "at", "width", "times", "phrases")).alias("cuts"))
    texts = docs.mapInArrow(_squeezer(["text_hash"]), "text_hash long, packed binary").join(wanted, "text_hash")

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for h, text, cuts in zip(batch["text_hash"], batch["packed"], batch["cuts"]):
                text = unpacker.decompress(text)
                out += [(h, c["core"], c["at"], c["times"], c["phrases"], text[c["at"] : c["at"] + c["width"] - 1 + WINDOW]) for c in cuts]
            yield pd.DataFrame(out, columns=["text_hash", "core", "at", "times", "phrases", "bytes"])

    phrases = texts.mapInPandas(tidy(cut), "text_hash long, core long, at int, times long, phrases long, bytes binary")
    phrases = written(phrases.dropDuplicates(["text_hash", "at"]), "suffix-phrases")
    span = "text_hash long, first int, last int"
    volume = phrases.where(F.col("phrases") <= HOT).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    groups = max(1, -(-int(volume) // SORTED_BYTES))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        again = repeated_windows(pdf["bytes"].tolist(), pdf["core"].to_numpy(), pdf["times"].to_numpy())
        for h, at, times, flags in zip(pdf["text_hash"], pdf["at"], pdf["times"], again):
            if times == 1:
                out += [(h, at + a, at + b - 1) for a, b in zip(*_runs(flags))]
        hold()
        return pd.DataFrame(out, columns=["text_hash", "first", "last"])

    sorted_ = phrases.where(F.col("phrases") <= HOT).withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(groups))).groupBy("bucket").applyInPandas(settle, span)

    def windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                block = Block(batch["bytes"].tolist())
                n = block.lengths - WINDOW + 1
                owner = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                place = start + block.offsets[owner]
                out = batch[["text_hash", "times"]].iloc[owner].reset_index(drop=True)
                yield out.assign(at=batch["at"].to_numpy()[owner] + start, one=_i64(block.hashes(place, place + WINDOW, 0)), two=_i64(block.hashes(place, place + WINDOW, 1)))

    hot = phrases.where(F.col("phrases") > HOT).mapInPandas(tidy(windows), "text_hash long, times long, at int, one long, two long")
    twice = hot.groupBy("one", "two").agg(F.sum("times").alias("n")).where("n >= 2").select("one", "two")
    counted_hot = hot.where("times = 1").join(twice, ["one", "two"], "left_semi").select("text_hash", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.unionByName(sorted_).unionByName(counted_hot)


def remove_repeats(docs: DataFrame, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or ``keep``), n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    kept_text decodes what is left of a cut character as U+FFFD.
    """
    keep = keep or ["doc_id"]
    docs = docs.select(*keep, *(["text"] if "text" not in keep else [])).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(docs.select("text", "text_hash").where(F.octet_length("text") >= WINDOW))
    spans = written(spans.groupBy("text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "suffix-spans")
    kept = [c for c in keep if c != "text"]
    squeezed = docs.mapInArrow(_squeezer([*kept, "text_hash"]), f"{schema_of(docs, *kept, 'text_hash')}, packed binary")
    new = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), **({"kept_text": pa.string()} if with_text else {})}
    out_shape = f"{schema_of(docs, *kept)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in text_slices(batch, "packed"):
                rows = []
                for text, spans in zip(part.column("packed").to_pylist(), part.column("spans").to_pylist()):
                    text = unpacker.decompress(text)
                    n, removed, runs, left = len(text), 0, 0, text
                    if spans:
                        change = np.zeros(n + 1, np.int32)
                        first, last = (np.array([s[c] for s in spans]) for c in ("first", "last"))
                        np.add.at(change, first, 1)
                        np.add.at(change, last + WINDOW, -1)
                        gone = np.cumsum(change[:-1]) > 0
                        removed, runs = int(gone.sum()), len(_runs(gone)[0])
                        left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    row = (n, removed, runs, hashlib.sha256(left).hexdigest())
                    rows.append((*row, left.decode("utf-8", "replace")) if with_text else row)
                yield with_columns(part, kept, **{c: pa.array(v, t) for (c, t), v in zip(new.items(), zip(*rows))})

    return squeezed.join(spans, "text_hash", "left").mapInArrow(tidy(remove), out_shape)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
