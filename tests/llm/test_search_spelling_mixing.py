"""Ranked search, spelling variants and mixing against brute force, with the edge cases that their docstrings define."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import mixing, ranked_search, spelling

DOCS = "doc_id long, text string, source string, key long, size long, node long, item long, word string, n long, place long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def row(doc_id, text, source="s"):
    return (doc_id, text, source, 1, 2, 3, 4, "w", 5, 6)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(150)]
    texts += texts[:9] + [None, "", "  ", "X" * 3000, "Ab, aB; AB É é ß1 2x 字 \x00 😀", "long " * 40_000]
    out = [row(i, t, ["s", "a", "é", "", None][i % 5]) for i, t in enumerate(texts)]
    return out + [out[0], out[0], row(7, "abc another text", None), row(None, texts[1]), row(-3, texts[2], "only")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def ranked_by_loops(rows, items, k):
    terms = [collections.Counter(TERM.findall(lower(r[1] or ""))) for r in rows]
    n = [sum(t.values()) for t in terms]
    documents, length = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for c in terms for t in c)
    out = []
    for item_id, text in items:
        found = []
        for r, c, size in zip(rows, terms, n):
            score = 0
            for t in set(TERM.findall(lower(text or ""))) & c.keys():
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * documents // length)))
            if score > 0:
                found.append((-score, r[0] is None, r[0] or 0, r[0]))
        out += [(item_id, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, block", [(50, 16_384), (3, 16), (1, 7)])
def test_ranked_search(spark, docs, rows, monkeypatch, k, block):
    rng = random.Random(k)
    items = [(i, " ".join(rng.sample((rows[i][1] or "x").split() or ["y"], 1) + rng.choices(rows[(i * 7) % 150][1].split(), k=6))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "ab"), (23, "no such words qqq"), (None, rows[3][1]), (5, "字 x long"), (24, rows[4][1]), (24, rows[4][1])]
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 1500)  # several groups of items
    real = ranked_search.search
    monkeypatch.setattr(ranked_search, "search", lambda *a: real(*a, block=block))
    asked = spark.createDataFrame([(i, t, "w", 1) for i, t in items], "item_id long, text string, doc_id string, item long")
    got = [tuple(r) for r in ranked_search.rank_items(docs, asked, k).collect()]
    assert sorted(got, key=str) == ranked_by_loops(rows, items[:-1], k)


def test_ranked_search_of_nothing(spark, docs):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "abc")], "item_id long, text string")
    assert ranked_search.rank_items(none, items).count() == 0
    assert ranked_search.rank_items(docs, items.limit(0)).count() == 0
    assert ranked_search.rank_items(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 16)
    for text in ("ab cd " * 20, "x" * 100, " " * 50, "", "a" * 15 + " b" + "c" * 40 + ",d"):
        assert [t.decode() for p in ranked_search.term_bytes(text.encode()) for t in p] == TERM.findall(text)


def words_by_loops(rows):
    n = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def variants_by_loops(n):
    forms, near = {}, {}
    for w in n:
        around = [o for o in n if one_apart(w, o)]
        best = min(around, key=lambda o: (-n[o], o), default=None)
        near[w] = len(around)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], near[w], n[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def misspelt(seed):
    """Words of few letters, so that edits coincide, with variants at every place; some of them long."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀÿ") for _ in range(rng.randint(7, 12))) for _ in range(25)]
    base += ["".join(rng.choice("ab") for _ in range(size)) for size in (40, 70, 256, 257, 258, 700)] + ["a" * 300]
    texts = []
    for i, w in enumerate(base):
        texts.append(" ".join([w.upper() if i % 3 == 0 else w] * rng.choice([2, 3, 30, 250])))
        for _ in range(12):
            p, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            texts.append(" ".join([w[:p] + ("" if kind == 0 else rng.choice("abcÀ")) + w[p + (kind < 2) :]] * rng.choice([2, 2, 4, 25])))
    return [row(i, f"1{t}-short, {t}") for i, t in enumerate(texts)] + [row(None, texts[0]), row(3, None), row(4, ""), row(5, "× ÷" * 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed):
    rows = misspelt(seed)
    rows += rows[:5]
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    want = variants_by_loops(words_by_loops(rows))
    assert sorted(got, key=str) == want and sum(w[4] for w in want) > 200 and any(len(w[0]) > 256 and w[1] for w in want)


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([row(1, "a b c"), row(2, None)], DOCS)).count() == 0


def mixed_by_loops(rows, weights=(3, 1, 2)):
    sized = [(r[0], r[2], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16)) for r in rows]
    sources = sorted({s[1] for s in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[2] for x in sized if x[1] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        free = [s for s in sources if s not in full]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in free)
        more = {s for s in free if weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    return size, {s: 2.0 * size[s] if s in full else weight[s] * level for s in sources}


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    size, target = mixed_by_loops(rows)
    assert len(got) == len(rows)
    taken = collections.Counter()
    longest = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_is_nested(docs):
    small, large = ({(r["doc_id"], r["source"], r["size"]): r["taken"] for r in mixing.mix(docs, share=share).collect()} for share in (0.4, 0.7))
    assert all(large[k] >= v for k, v in small.items()) and sum(large.values()) > sum(small.values())


def test_mixing_of_equal_rows_and_nothing(spark):
    same = spark.createDataFrame([row(1, "a b c", "x")] * 200 + [row(2, "d " * 600, "y")], DOCS).repartition(4)
    got = mixing.mix(same, share=0.25).where("source = 'x'").collect()
    assert {r["target"] for r in got} == {225.0} and sum(r["taken"] for r in got) == 225
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    empty = mixing.mix(spark.createDataFrame([row(1, None), row(2, " "), row(3, "", None)], DOCS)).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0)] * 3


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 50), min_size=1, max_size=9))
def test_targets(spark, sizes):
    rows = [row(i, "w " * n, f"s{i}") for i, n in enumerate(sizes)]
    _, want = mixed_by_loops(rows)
    by_source = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    assert {r["source"]: r["target"] for r in mixing.targets(by_source).collect()} == pytest.approx(want)
