"""Spelling variants of a corpus' words by walks of a distributed trie, one edit at most.

Words, with how often they occur, form two tries: one of the words and one of the words read from their end. A
state is (word, position, node, edits). Until its edit a state lies on its word's own path, so these states are
the trie's rows themselves. Two words that differ in one place agree on the half before it or on the half behind it,
so edits are made in the second half of a word only, where nodes have few children, and one of the tries meets every
pair. A state makes its edit by a join of its node with the edges there: another character goes in for its own, or
its own is left out (what one word lacks the other has too much, so insertions need no states of their own). Each
further level joins the states with the edges (node, next four characters) below; most end at the first. A state that
comes to a word's end there has found a near word, which is compared once more by its letters, as nodes are hashes.

A node has at most as many edges of two characters as the alphabet allows (116 * 116), so no join meets all pairs of
a group: what a state can meet does not grow with the corpus. Words of more than ``LONG`` letters, for which a row
for each level would carry the whole word, meet by hashes of the word without one letter instead: rows of a few bytes
for each letter. Forms are at least ``RATIO`` times as frequent as their word, so the way to a root is as many joins
long as the largest count has digits, at most.

Edge cases: null and empty texts have no words; a null doc_id counts as the empty string where runs are altered;
repeated rows are counted like others; of equal counts the smaller word in code-point order is the form; words
without a near word have form, form_n null, n_near 0 and themselves as root; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy, written
from .shingles import mix

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, ALTERED, RATIO = 7, 2, 31, 10
#: Letters up to which a word goes through the tries, and characters that a state reads at a level.
LONG, STEP = 256, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUES = np.random.default_rng(20240507).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A trie's row: a word (read from its end in the second trie), a depth in its second half, the node there, the three
#: characters that follow (0: the end) and the nodes two and four characters on.
TRIE = "word string, n long, turned boolean, length int, depth int, node long, c int, x int, y int, next2 long, next4 long, drops boolean"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least 7 letters that occur twice or more, after the runs that 31 divides lost a letter."""
    # A run below that length cannot become a word.
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    raw = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("raw"))
    ascii_only = F.octet_length("raw") == F.length("raw")
    run = raw.select("id", F.when(ascii_only, F.lower("raw")).otherwise(F.translate("raw", _UPPER, _LOWER)).alias("run"))
    hashed = run.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % ALTERED == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _paths(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with zeros behind, lengths, and the hash of every prefix."""
    letters = np.array(words, dtype=np.str_)
    codes = letters.view(np.uint32).reshape(len(words), -1).astype(np.uint8)
    codes = np.pad(codes, ((0, 0), (0, STEP + 1)))
    node = np.zeros((len(words), codes.shape[1]), np.uint64)
    for d in range(codes.shape[1] - 1):
        node[:, d + 1] = node[:, d] * _BASE + _VALUES[codes[:, d]]
    return codes, np.array([len(w) for w in words]), node


def _rows(words: list[str], turned: bool) -> dict[str, np.ndarray]:
    """A trie's rows for some words: every depth of the second half, the end included."""
    codes, length, prefix = _paths([w[::-1] for w in words] if turned else words)
    node = mix(prefix + np.uint64(turned)).view(np.int64)
    # The first trie has edits at places from length // 2, the second at those before.
    half = (length + 1) // 2 if turned else length // 2
    depth = np.arange(codes.shape[1])
    row, d = np.nonzero((depth >= half[:, None]) & (depth <= length[:, None]))
    c, x = codes[row, d], codes[row, d + 1]
    since = np.zeros(codes.shape, np.int32)  # where the run of equal letters began
    for i in range(1, codes.shape[1]):
        since[:, i] = np.where(codes[:, i] == codes[:, i - 1], since[:, i - 1], i)
    on = lambda k: node[row, np.minimum(d + k, length[row])]
    # Of equal letters in a row the last is left out, by the trie that reaches it, or else by the other.
    drops = (c != 0) & (c != x) & (np.full(len(d), not turned) | (since[row, d] >= half[row]))
    return {"row": row, "length": length[row], "depth": d, "node": node[row, d], "c": c, "x": x, "y": codes[row, np.minimum(d + 2, codes.shape[1] - 1)], "next2": on(2), "next4": on(STEP), "drops": drops}


@tidy
def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"length": pa.int32(), "depth": pa.int32(), "c": pa.int32(), "x": pa.int32(), "y": pa.int32()}
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            for turned in (False, True):
                words = part.column("word").to_pylist()
                got = _rows(words, turned)
                row = pa.array(got.pop("row"))
                names = pa.array([w[::-1] for w in words] if turned else words)
                out = {"word": names.take(row), "n": part.column("n").take(row), "turned": pa.array(np.full(len(row), turned))}
                out |= {k: pa.array(v.astype(np.int32) if k in kinds else v) for k, v in got.items()}
                yield pa.RecordBatch.from_arrays([out[c.split()[0]] for c in TRIE.split(", ")], [c.split()[0] for c in TRIE.split(", ")])


def trie(words: DataFrame) -> DataFrame:
    return words.where(F.length("word") <= LONG).mapInArrow(_grow, TRIE)


def _label(position: Column) -> Column:
    """What a state reads next: an edge's key is its node and these characters."""
    return F.xxhash64("node", F.substring("word", position + 1, F.lit(STEP)))


def edited(rows: DataFrame) -> DataFrame:
    """The states after their edit, by a join of each node's rows with the edges of two characters there."""
    edges = rows.groupBy(F.col("node").alias("_node"), F.col("c").alias("_c"), F.col("x").alias("_x")).agg(F.first("next2").alias("to"))
    # Of two words with different letters in one place the one with the smaller letter finds the other.
    other = (F.col("x") == F.col("_x")) & (F.col("c") < F.col("_c"))
    without = F.col("drops") & (F.col("x") == F.col("_c")) & (F.col("y") == F.col("_x"))
    met = rows.where("c > 0").join(edges, (F.col("node") == F.col("_node")) & (other | without))
    # An edge may serve both edits, which go on from different places.
    read = F.explode(F.array_compact(F.array(F.when(other, 2), F.when(without, 3))))
    met = met.select("word", "n", "turned", "length", "depth", "to", read.alias("read"))
    return met.select("word", "n", "turned", "length", F.least(F.col("depth") + F.col("read"), F.col("length")).alias("position"), F.col("to").alias("node"))


def near_by_tries(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): near words of up to LONG letters, each pair once."""
    rows = written(trie(words), "spelling-trie")
    below = rows.where((F.col("c") > 0) & (F.col("depth") >= 2 + F.floor((F.col("length") + F.col("turned").cast("int")) / 2)))
    edges = written(below.select(_label(F.col("depth")).alias("edge"), F.col("next4").alias("to")).groupBy("edge").agg(F.first("to").alias("to")), "spelling-edges")
    state, ended = written(edited(rows), "spelling-states"), []
    while True:
        ended.append(state.where("position = length"))
        on = state.where("position < length")
        if on.isEmpty():
            break
        moved = on.select("*", _label(F.col("position")).alias("edge")).join(edges, "edge")
        state = written(moved.select("word", "n", "turned", "length", F.least(F.col("position") + STEP, F.col("length")).alias("position"), F.col("to").alias("node")), "spelling-states")
    ends = rows.where("c = 0").select("node", F.col("word").alias("b"), F.col("n").alias("n_b"))
    found = reduce(DataFrame.unionByName, ended).select("node", "turned", F.col("word").alias("a"), F.col("n").alias("n_a")).join(ends, "node")
    forth = lambda c: F.when(F.col("turned"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    return found.select(forth("a"), "n_a", forth("b"), "n_b").where(F.levenshtein("a", "b", 1) == 1)


@tidy
def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A long word's keys: without a letter, with its place; the same for each run of equal letters, at -1; whole, at -2."""
    for batch in batches:
        for id_, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            values = _VALUES[np.frombuffer(word.encode("latin-1"), np.uint8)]
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(word), _BASE)]))
            before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1])])
            # Letters behind the one that is left out move up by one place.
            short = before[:-1] * _BASE + (before[-1] - before[1:])
            place = np.arange(len(word))
            last = np.append(values[1:] != values[:-1], True)
            key = np.concatenate([mix(short + mix(place.astype(np.uint64))), mix(short[last]), mix(before[-1:] * _BASE)]).view(np.int64)
            at = np.concatenate([place, np.full(last.sum(), -1), [-2]])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.array(np.full(len(key), id_))], ["key", "at", "id"])


def near_by_keys(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): near words of which one has more than LONG letters, each pair once."""
    long = words.where(F.length("word") >= LONG).select(F.xxhash64("word").alias("id"), "word", "n")
    keys = written(long.select("id", "word").mapInArrow(_without_one, "key long, at long, id long"), "spelling-keys")
    a, b = (keys.select(F.col("id").alias(s), "key", F.col("at").alias(f"at_{s}")) for s in "ab")
    same_place = (F.col("at_a") == F.col("at_b")) & (F.col("at_a") >= 0) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "key").where(same_place | ((F.col("at_a") == -1) & (F.col("at_b") == -2))).select("a", "b").distinct()
    named = lambda s: long.select(F.col("id").alias(s), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"))
    found = pairs.join(named("a"), "a").join(named("b"), "b").where("greatest(length(word_a), length(word_b)) > " + str(LONG))
    return found.select(F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b").where(F.levenshtein("a", "b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form (word, form)."""
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("_then"))
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        ends = written(ends.join(step, "root", "left").select("word", F.coalesce("_then", "root").alias("root"), F.col("_then").isNotNull().alias("_moved")), "spelling-roots")
        if ends.where("_moved").isEmpty():
            return ends.drop("_moved")
        ends = ends.drop("_moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text)."""
    words = written(vocabulary(docs), "spelling-words")
    pairs = near_by_tries(words)
    if not words.where(F.length("word") > LONG).isEmpty():
        pairs = pairs.unionByName(near_by_keys(words))
    pairs = written(pairs, "spelling-pairs")
    near = pairs.select(F.col("a").alias("word"), "n_b", "b").unionByName(pairs.select(F.col("b").alias("word"), F.col("n_a").alias("n_b"), F.col("a").alias("b")))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("form"))).alias("best"))
    held = words.join(best, "word", "left")
    is_form = -F.col("best.n") >= RATIO * F.col("n")
    held = written(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "spelling-forms")
    ended = roots(held.where("form IS NOT NULL").select("word", "form"))
    return held.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))


#: CRC-32 byte by byte; words meet by what is left of them without one letter.
OP12_SQL = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT id, run, count(*) AS k FROM r GROUP BY ALL),
x AS (SELECT run, k, hex(encode(id || ':' || run)) AS hx, octet_length(encode(id || ':' || run)) AS len FROM g),
h AS (SELECT run, k, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(len), lambda i: CAST('0x' || substring(hx, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(t[CAST(xor(c & 255, b) + 1 AS BIGINT)], c >> 8)), 4294967295) AS h FROM x, tab),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, n, p, left(word, p - 1) || substring(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
e AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n AS n FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
s AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(m := -n, f := b)) AS best FROM e GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN -s.best.m >= 10 * w.n THEN s.best.f END AS form, CASE WHEN -s.best.m >= 10 * w.n THEN -s.best.m END AS form_n FROM w LEFT JOIN s USING (word)),
c AS (SELECT word, word AS now, 0 AS hops FROM f UNION ALL SELECT c.word, f.form, hops + 1 FROM c JOIN f ON f.word = c.now WHERE f.form IS NOT NULL),
o AS (SELECT word, arg_max(now, hops) AS root FROM c GROUP BY word)
SELECT f.word, f.form, o.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN o USING (word)
"""
