"""BPE encoding and decoding with a contiguous rank array per short word.

A word is held as its part ids (its boundaries) beside the ranks of adjacent pairs. The smallest rank is looked
for again and again, the boundary behind it is deleted, and the two ranks next to it are made anew. Words above
``LONG`` bytes, where that repeated scan would be quadratic, use the same merges from a heap over linked parts.

The special tokens' strings in a text become their ids, as the tokenizers library does by default.

Edge cases: null and empty text give no ids and the hash of the empty string; texts are processed whole; repeated
rows give repeated results; a null doc_id stays null; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import hold, schema_of, table, text_slices, with_columns

#: Fixed pattern: pre-tokenisation of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256
#: Entries of a generation of the word cache; two generations are kept, so memory is bounded.
CACHE = 400_000
NONE = 1 << 60
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + n): b for n, b in enumerate(others)}


class RankArrayBpe:
    """A byte-level BPE vocabulary file, its encoder and its decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in word) for word, i in vocab.items()}
        self.first = [0] * 256
        for word, i in vocab.items():
            if len(word) == 1:
                self.first[letters[word]] = i
        # A pair of ids, and the rank with the merged id below it, are one integer each.
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[a] << ID_BITS | vocab[b], rank << ID_BITS | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(PATTERN)
        self.young: dict[str, bytes] = _Missing(self)
        self.old: dict[str, bytes] = {}
        self.newline = self.packed[self.merge(b"\n")[0]]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        first, pairs = self.first, self.pairs
        ids = [first[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        get = pairs.get
        found = [get(a << ID_BITS | b, NONE) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == NONE:
                break
            i = found.index(best)
            ids[i] = new = best & ID_MASK
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << ID_BITS | new, NONE)
            if i < len(found):
                found[i] = get(new << ID_BITS | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := get(ids[i] << ID_BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            new, j = best & ID_MASK, after[i]
            if gone[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], after[i] = new, after[j]
            gone[j] = 1
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := get(ids[a] << ID_BITS | ids[b])) is not None:
                    heapq.heappush(heap, (p, a, ids[a], ids[b]))
        return [x for x, g in zip(ids, gone) if not g]

    def _pack(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in self.merge(word.encode())])

    def _chunk(self, key: str) -> bytes:
        """A chunk that stood after one space, or with its newline before it."""
        if (end := key[-1:]) in (",", ".") and key[-2:-1].isalpha():
            return self.young[key[:-1]] + self.young_end[end]
        text = " " + key if key[:1] != "\n" else key[1:]
        lead = self.newline if key[:1] == "\n" else b""
        if key[1:].isalpha() and (key[0] == "\n" or key[0].isalpha()):
            return lead + self._pack(text)
        return lead + b"".join(map(self._pack, self.split.findall(text)))

    @property
    def young_end(self) -> dict[str, bytes]:
        if not hasattr(self, "_ends"):
            self._ends = {c: self._pack(c) for c in ",."}
        return self._ends

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        flat = text.replace("\n", " ")
        plain = flat.isprintable() and "  " not in flat and flat[0] != " " and flat[-1] != " " and not any(s in text for s in self.special)
        if plain:
            # Each space is followed by a word: a pre-token starts there whatever stands around.
            return b"".join(map(self.young.__getitem__, ("\n" + text).replace("\n", " \n")[1:].split(" ")))[4:]
        out = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            out += [self.packed[self.special[part]]] if part in self.special else map(self._pack, self.split.findall(part))
        return b"".join(out)

    def decode_packed(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I")
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Missing(dict):
    """Chunk to packed ids in two generations: a full young one becomes the old one."""

    def __init__(self, bpe: RankArrayBpe):
        self.bpe = bpe

    def __missing__(self, key: str) -> bytes:
        bpe = self.bpe
        value = bpe.old.get(key)
        if value is None:
            value = bpe._chunk(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                bpe.old = dict(self)
                self.clear()
            self[key] = value
        return value


def load(path: str) -> RankArrayBpe:
    """One encoder for each vocabulary file and worker process."""
    return hold(("RankArrayBpe", path), lambda: RankArrayBpe(path))


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in text_slices(batch):
                sizes, ids, decoded = [], [], []
                for text in part.column("text").to_pylist():
                    packed = bpe.encode_packed(text or "")
                    sizes.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode_packed(packed).encode()).hexdigest())
                yield with_columns(part, ["doc_id"], n_tokens=pa.array(sizes, pa.int64()), ids_sha256=pa.array(ids), decoded_sha256=pa.array(decoded))

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"{schema_of(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
