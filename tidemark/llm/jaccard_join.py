"""N-gram Jaccard self-join by parity sketches.

A text's set holds its distinct five-word shingles. Every shingle flips one bit of a wide, sparse bit sketch, so
the sketches of two sets differ in at most as many bits as the sets' symmetric difference has members, and a
part of the sketch that no differing shingle falls into is equal in both. For a similarity of s the symmetric
difference of sets of sizes a and b is at most (1-s)/(1+s) * (a+b). Sizes are dealt into bands; in a band the
sketch has a fixed number of parts, and a set gives one key for each of its first non-empty parts, one more than
the largest difference that a partner may have. If no key met, each of those parts would hold a differing
shingle, which is one too many: so every linked pair meets in a key (pigeonhole). Wide parts are kept as the XOR
of their members' hashes.

Passages that many texts share make common keys. Every set gives ``spare`` keys more than it needs, so linked pairs
meet in that many more, and a set may leave out its common keys if they are no more than that: the pair still
meets in a key that isn't common. Pairs that met are first held against the Hamming bound of short sketches, then
verified on the shingle sets themselves.

Identical sets are one node from the start. In a key of few nodes, these are compared with some centres
first, and where that leaves different components, across them. Nodes that cannot do without their common keys are
compared block by block, in memory. So no link between components is lost and no group is ever spelt out in pairs.

Edge cases: a null or empty text or one of white space alone has no shingles and stands alone; fewer than five
words are one shingle; a null doc_id takes part and counts as larger than all others; repeated rows are repeated
in the result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, hold, table, text_slices, tidy, with_columns, written
from .components import connected_components, forest
from .shingles import mix, shingle_sets

#: Similarity as a fraction of integers: 80 of 100.
NUMERATOR, DENOMINATOR = 80, 100
#: Ratio of a band's largest size to its smallest.
BAND = 1.4
#: Centres with which the nodes of a key are compared before pairs across components are listed.
CENTRES = 3
#: Nodes that share a key, from which on the key counts as common.
COMMON = 24
#: Nodes in a block of a bundle, and shingles of all of them together, at most.
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Shingles that a task of a bundle's comparison, a bucket of keys and a block of keys hold, about.
TASK_SHINGLES, BUCKET_SHINGLES, HELD_KEYS = 500_000, 500_000, 500_000
#: Shingles of a set for each key that it may leave out.
SPARE = 12
_U = np.uint64
KEY_BYTES = 5


def largest_difference(total: int) -> int:
    """Most members that the symmetric difference of two linked sets of ``total`` members together can have."""
    return total * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def band_tops(size: int) -> list[tuple[int, int]]:
    """(band, top size) of the bands in which a set of ``size`` meets partners: its own, and those of larger partners."""
    out, band, top, before = [], 0, 4, 0
    while True:
        if before < size * DENOMINATOR // NUMERATOR and size <= top:
            out.append((band, top))
        if before >= size * DENOMINATOR // NUMERATOR:
            return out
        before, band, top = top, band + 1, max(top + 1, int(top * BAND))


def spare(size: int) -> int:
    """Keys that a set gives beyond those it needs, and may leave out where they are common."""
    return size // SPARE


def part_keys(members: np.ndarray) -> np.ndarray:
    """The keys of one sorted set of shingle hashes."""
    n, out = len(members), []
    for band, top in band_tops(n):
        parts = max(int(1.1 * (largest_difference(2 * top) + spare(top))) + 8, 1024 if top <= 64 else 0)
        partner = min(top, n * DENOMINATOR // NUMERATOR)
        need = largest_difference(n + partner) + 1 + spare(partner)
        place = ((members >> _U(32)) * _U(parts)) >> _U(32)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sketch = np.bitwise_xor.reduceat(mix(members), starts)
        out.append(mix(sketch ^ mix(place[starts] + _U((band + 1) << 40)))[:need])
        if len(starts) < need:  # too few parts hold anything (next to impossible): its shingles are keys besides
            out.append(mix(members ^ _U(band + 1)))
    return np.concatenate(out)


def short_sketch(members: np.ndarray) -> bytes:
    """One bit for each of four times as many places as members, at least; each member flips the bit of its place."""
    bits = max(256, 1 << (4 * len(members) - 1).bit_length())
    odd = np.bincount((members & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches; the longer is folded onto the shorter, which keeps parities."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def numbered(docs: DataFrame) -> DataFrame:
    """ref, doc_id, text: written once, so that every pass finds the same reference at a text however it is split."""
    return written(docs.select(F.monotonically_increasing_id().alias("ref"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "jaccard-texts")


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of bounded bytes with the sets of their texts."""
    hold()
    for batch in batches:
        for part in text_slices(batch):
            yield part, list(shingle_sets(part.column("text").to_pylist()))


def _identity(members: np.ndarray) -> tuple[int, int]:
    return int(members.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(members)).astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs`` (ref, doc_id, text): its set's identity (128 bits), size and short sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            same = np.array([_identity(s) for s in sets], np.int64).reshape(-1, 2)
            sketches = pa.array([short_sketch(s) for s in sets], pa.binary())
            yield with_columns(part, ["ref", "doc_id"], sum=pa.array(same[:, 0]), check=pa.array(same[:, 1]), size=pa.array([len(s) for s in sets], pa.int64()), sketch=sketches)

    return docs.mapInArrow(tidy(run), "ref long, doc_id long, sum long, check long, size long, sketch binary")


def _blob(keys: np.ndarray, rest: list[np.ndarray]) -> bytes:
    """Keys cut to KEY_BYTES, then two bytes for each row number."""
    cut = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    return cut.tobytes() + b"".join(r.astype("<u2").tobytes() for r in rest)


def _unblob(blob: bytes, columns: int) -> tuple[np.ndarray, ...]:
    n = len(blob) // (KEY_BYTES + 2 * columns)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8, n * KEY_BYTES).reshape(n, KEY_BYTES)
    rest = np.frombuffer(blob, "<u2", n * columns, n * KEY_BYTES).reshape(columns, n)
    return wide.view("<u8").reshape(-1), *rest


def met_in_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, a, b): references that share a key, each with one centre; key is 0 where a key has only these two.

    A block's keys travel as one binary value for each bucket. What a block holds twice is linked to one of
    its rows there, so a key that all documents share reaches its bucket once for each block.
    """
    shift = 64 - (buckets - 1).bit_length() if buckets > 1 else 63
    buckets = 1 << (64 - shift)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, rows, base, held = set(), [], [], None, 0
        for part, sets in _sets(batches):
            for ref, s in zip(part.column("ref").to_pylist(), sets):
                if ref >> 16 != base or held > HELD_KEYS:
                    if held:
                        yield block(base << 16, np.concatenate(keys), np.concatenate(rows))
                    seen, keys, rows, base, held = set(), [], [], ref >> 16, 0
                if len(s) and (same := _identity(s)) not in seen:
                    seen.add(same)
                    keys.append(part_keys(s))
                    rows.append(np.full(len(keys[-1]), ref & 0xFFFF, np.uint16))
                    held += len(keys[-1])
        if held:
            yield block(base << 16, np.concatenate(keys), np.concatenate(rows))

    def block(base: int, keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        centre = rows[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        more = ~first & (rows != centre)
        limits = np.arange(1, buckets, dtype=np.uint64) << _U(shift)
        at, near = np.searchsorted(keys[first], limits), np.searchsorted(keys[more], limits)
        cut = lambda x: (x << _U(64 - shift)) >> _U(64 - 8 * KEY_BYTES)
        out = []
        for b, (k, r, k2, c2, r2) in enumerate(zip(np.split(keys[first], at), np.split(rows[first], at), np.split(keys[more], near), np.split(centre[more], near), np.split(rows[more], near))):
            if len(k):
                out.append((b, _blob(cut(k), [r]), _blob(cut(k2), [c2, r2])))
        number, own, others = zip(*out)
        arrays = [pa.array(number, pa.int32()), pa.array([base] * len(out), pa.int64()), pa.array(own, pa.binary()), pa.array(others, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "block", "keys", "near"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        keys, refs, near = [], [], []
        for block, blob, more in zip(group["block"], group["keys"], group["near"]):
            k, r = _unblob(blob, 1)
            keys.append(k)
            refs.append(r.astype(np.int64) | block)
            k, c, r = _unblob(more, 2)
            near.append((k, c.astype(np.int64) | block, r.astype(np.int64) | block))
        keys, refs = np.concatenate(keys), np.concatenate(refs)
        order = np.argsort(keys, kind="stable")
        keys, refs = keys[order], refs[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        near_key, near_centre, near_row = (np.concatenate([x[i] for x in near]) for i in range(3))
        at = np.searchsorted(keys[starts], near_key)
        total = sizes + np.bincount(at, minlength=len(sizes))
        common = total > COMMON
        # A common key: its rows. Any other: its centres with each of its rows, or its one pair.
        many = np.repeat(common, sizes)
        k, a, b = [keys[many], near_key[common[at]]], [refs[many], near_row[common[at]]], [refs[many], near_row[common[at]]]
        rare = ~common[at]
        keys, refs = np.concatenate([keys[~many], near_key[rare]]), np.concatenate([refs[~many], near_row[rare]])
        order = np.argsort(keys, kind="stable")
        keys, refs = keys[order], refs[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        name = lambda x: (x.astype(np.int64) << 16 | int(group["bucket"].iloc[0])) + 1
        k = [name(x) for x in k]
        for turn in range(CENTRES if len(keys) else 0):
            # Centres are least in an order of all rows, so near documents mostly find the same few.
            rank = mix(refs.astype(np.uint64) + _U(turn << 60)) >> _U(1) if turn else refs.astype(np.uint64)
            best = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            at = at[np.concatenate([[True], np.diff(np.searchsorted(starts, at, "right")) > 0])]
            centre = np.repeat(refs[at], sizes)
            pick = np.repeat(sizes > (2 if turn else 1), sizes) & (refs != centre)
            k.append(np.where(np.repeat(sizes > 2, sizes), name(keys), 0)[pick])
            a.append(centre[pick])
            b.append(refs[pick])
        k, a, b = map(np.concatenate, (k, a, b))
        hold()
        return pd.DataFrame({"key": k, "a": a, "b": b}).drop_duplicates()

    sent = docs.mapInArrow(tidy(send), "bucket int, block long, keys binary, near binary")
    return sent.groupBy("bucket").applyInPandas(meet, "key long, a long, b long")


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def node_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node, members: the sets of the nodes in ``wanted``, made anew from the text that each is named after."""

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_slices(batch):
                packed = pa.array([packer.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("ref"), packed], ["node", "packed"])

    def to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in text_slices(batch, "packed", SLICE // 4):
                texts = [unpacker.decompress(t).decode() for t in part.column("packed").to_pylist()]
                members = pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), members], ["node", "members"])

    found = docs.select("ref", "text").mapInArrow(tidy(squeeze), "node long, packed binary").join(wanted, "node")
    return found.mapInArrow(tidy(to_sets), "node long, members binary")


def links_between(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs i < j of some sets, by their incidence matrix a stretch of columns at a time."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        common += part @ part.T
    total = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(DENOMINATOR * common >= NUMERATOR * total, 1))


def _compared(dealt: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b), a forest of them, among the nodes of each (bundle, class, low, high) of ``dealt`` (with node, size).

    The groups are dealt into tasks by their bytes, so a task holds about ``TASK_SHINGLES`` of them.
    """
    volume = dealt.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-int(volume) // TASK_SHINGLES))
    task = F.pmod(F.xxhash64("bundle", "class", "low", "high"), F.lit(tasks))
    sets = dealt.join(members, "node").select(task.alias("task"), "bundle", "class", "low", "high", "node", "members")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["bundle", "class", "low", "high"], sort=False):
            i, j = links_between([np.frombuffer(m, np.uint64) for m in g["members"]])
            if len(i):
                node, label = g["node"].to_numpy(), forest(len(g), i, j)
                out.append(pd.DataFrame({"a": node, "b": node[label]})[label != np.arange(len(g))])
        hold()
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    return sets.groupBy("task").applyInPandas(compare, "a long, b long")


def bundle_links(common: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b), a spanning forest of them, between nodes that cannot do without their common keys.

    Nodes that common keys join are a bundle (such as thousands of copies with some words changed). A bundle is
    dealt into blocks. Each block is compared in itself and with the bundle's first, which joins most near copies,
    so a node is sent twice. What is still apart then is dealt anew by its component, and blocks of different
    components are compared with each other.
    """
    stars = common.join(common.groupBy("key").agg(F.min("node").alias("centre")), "key").select(F.col("node").alias("a"), F.col("centre").alias("b")).where("a <> b").distinct()
    bundles = connected_components(stars, "jaccard-bundles").withColumnRenamed("component", "bundle")
    # Sizes of linked sets are in one class or in two neighbouring ones.
    step = math.log(DENOMINATOR / NUMERATOR)
    sized = bundles.join(nodes.select("node", "size"), "node").withColumn("class", F.floor(F.log(F.col("size").cast("double")) / step + 1e-9).cast("int"))
    placed = written(sized.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1))), "jaccard-placed")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    counts = written(placed.groupBy("bundle", "class").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")).where("n > 1").drop("n"), "jaccard-parts")
    dealt = placed.join(counts, ["bundle", "class"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = dealt.withColumn("low", F.lit(0)).withColumn("high", F.explode(F.when(F.col("part") == 0, F.sequence(F.least(F.lit(1), F.col("parts") - 1), F.col("parts") - 1)).otherwise(F.array("part"))))
    links = written(_compared(pairs.select("bundle", "class", "low", "high", "node", "size"), members), "jaccard-bundled")
    apart = written(_apart(placed, counts.where("parts > 2"), links), "jaccard-apart")
    return links if apart.isEmpty() else links.unionByName(_compared(apart, members))


def _apart(placed: DataFrame, counts: DataFrame, links: DataFrame) -> DataFrame:
    """bundle, class, low, high, node, size: blocks of components of a bundle that have yet to meet each other.

    What is used several times is written first: unfolded, the plan has hundreds of nodes, which fill the driver's memory.
    """
    by = ["bundle", "class"]
    classes = connected_components(links, "jaccard-bundled-classes")
    labelled = placed.join(counts.select(*by), by).join(classes, "node", "left").withColumn("label", F.coalesce("component", "node"))
    several = labelled.groupBy(*by).agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select(*by)
    left = written(labelled.join(several, by).drop("component"), "jaccard-several")
    # Large components fill blocks of their own; the small ones share blocks, in which their pairs are compared as well.
    filled = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = left.groupBy(*by, "label").agg(filled.alias("own"), F.count(F.lit(1)).alias("held"), F.sum("size").alias("volume"))
    sizes = sizes.withColumn("small", (F.col("held") < BLOCK // 2) & (F.col("volume") < BLOCK_SHINGLES // 2))
    shared = sizes.where("small").groupBy(*by).agg(F.ceil(F.greatest(F.sum("held") / BLOCK, F.sum("volume") / BLOCK_SHINGLES)).cast("int").alias("shared"))
    left = left.join(sizes.select(*by, "label", "own", "small"), [*by, "label"]).join(shared, by, "left")
    left = left.withColumn("owner", F.when(~F.col("small"), F.col("label")))
    left = left.withColumn("part", F.when(F.col("small"), F.pmod(F.xxhash64("label"), F.col("shared"))).otherwise(F.pmod(F.xxhash64("node"), F.col("own"))).cast("int"))
    left = written(left.select(*by, "node", "size", "owner", F.xxhash64("owner", "part").alias("name")), "jaccard-blocks")
    block = left.select(*by, "owner", "name").distinct()
    other = block.select(*by, F.col("owner").alias("owner2"), F.col("name").alias("name2"))
    # Blocks of one large component need no look at each other; a shared block is looked at in itself too.
    meet = block.join(other, by).where("name <= name2 and not (owner <=> owner2 and owner is not null)")
    ends = meet.select(*by, F.col("name").alias("low"), F.col("name2").alias("high"), F.explode(F.array_distinct(F.array("name", "name2"))).alias("name"))
    return left.select(*by, "node", "size", "name").join(ends, [*by, "name"]).select(*by, "low", "high", "node", "size")


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) that size and the Hamming bound of short sketches leave over."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "sketch_a"):
                size_a, size_b, sketch_a, sketch_b = (part.column(c).to_pylist() for c in ("size_a", "size_b", "sketch_a", "sketch_b"))
                keep = [sketch_distance(x, y) <= largest_difference(m + n) for x, y, m, n in zip(sketch_a, sketch_b, size_a, size_b)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("size_a", "size_b") * DENOMINATOR >= F.greatest("size_a", "size_b") * NUMERATOR)
    return sized.mapInArrow(tidy(near), "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def verified(close: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs that link, by their sets."""
    held = lambda c: members.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}"))

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "set_a", 4 * SLICE):
                keep = []
                for x, y in zip(part.column("set_a"), part.column("set_b")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return close.join(held("a"), "a").join(held("b"), "b").mapInArrow(tidy(link), "a long, b long")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """ref, doc_id, n_shingles, label of every row of ``docs`` (ref, doc_id, text): rows of one label are linked."""
    rows = written(signatures(docs), "jaccard-rows")
    same = rows.where("size > 0").groupBy("sum", "check").agg(F.min("ref").alias("node"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = written(same, "jaccard-nodes")
    rows = written(rows.drop("sketch").join(nodes.select("sum", "check", "node"), ["sum", "check"], "left").select("ref", "doc_id", "size", "node"), "jaccard-rows")
    nodes = nodes.drop("sum", "check")
    volume = nodes.agg(F.sum("size")).first()[0] or 0
    buckets = min(1 << 16, max(64, int(volume) // BUCKET_SHINGLES))
    met = met_in_keys(docs, buckets)
    of = lambda c: rows.select(F.col("ref").alias(c), F.col("node").alias(f"node_{c}"))
    met = written(met.join(of("a"), "a").join(of("b"), "b").select("key", F.col("node_a").alias("a"), F.col("node_b").alias("b"), (F.col("a") == F.col("b")).alias("common")).where("common or a <> b").distinct(), "jaccard-met")

    common = met.where("common").select("key", F.col("a").alias("node"))
    bound = common.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(nodes.select("node", "size"), "node").where(F.col("n") > F.floor(F.col("size") / SPARE)).select("node")
    common = written(common.join(bound, "node", "left_semi"), "jaccard-common")
    tried = written(_pairs(met.where("not common").select("a", "b")), "jaccard-tried")
    close = written(near_pairs(tried, nodes), "jaccard-close")
    members = written(node_sets(ends(close).unionByName(common.select("node")).distinct(), docs), "jaccard-sets")
    links = written(verified(close, members).unionByName(bundle_links(common, nodes, members)), "jaccard-links")
    classes = connected_components(links, "jaccard-classes")
    # Keys of more than two nodes (COMMON at most), where the centres may have missed links between the others.
    wide = met.where("key <> 0 and not common")
    inside = wide.select("key", F.col("a").alias("node")).unionByName(wide.select("key", F.col("b").alias("node"))).distinct()
    labelled = inside.join(classes, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    split = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    left = written(labelled.join(split.select("key"), "key", "left_semi"), "jaccard-left")
    other = left.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
    more = left.withColumnRenamed("node", "a").join(other, "key").where("a < b and label <> label_b").select("a", "b").distinct()
    more = written(near_pairs(more.join(tried, ["a", "b"], "left_anti"), nodes), "jaccard-more")
    if not more.isEmpty():
        new = written(verified(more, node_sets(ends(more).distinct(), docs)), "jaccard-links")
        if not new.isEmpty():
            classes = connected_components(links.unionByName(new), "jaccard-classes")
    return rows.join(classes, "node", "left").select("ref", "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("label"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    placed = jaccard_classes(numbered(docs))
    least = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates: the least doc_id stays, nulls last.

    Of rows with that doc_id the first in the table stays. Rows are told apart by their place, so those that share a
    doc_id but not their text, and those without one, are decided each for itself. Texts without words all stay.
    """
    held = written(docs.withColumn("_ref", F.monotonically_increasing_id()), "jaccard-held")
    texts = held.select(F.col("_ref").alias("ref"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = jaccard_classes(texts)
    first = placed.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref"))["ref"].alias("_ref"))
    stay = first.select("_ref").unionByName(placed.where("label is null").select(F.col("ref").alias("_ref")))
    return held.join(stay, "_ref", "left_semi").drop("_ref")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (n - c) UNION SELECT y, x FROM p WHERE 100 * c >= 80 * (n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, sh
"""
