"""The dealt operators against brute force on small fixtures, with the edge cases that their docstrings define."""

import collections
import hashlib
import itertools
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, common, components, embedding_dedup, html_extract, jaccard_join, packing, sharding, suffix_dedup, token_counts, topk_search, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, node long"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 200)) for _ in range(40)]
    passage = words(rng, 70)
    near = []
    for t in base[:12]:
        w = t.split()
        for k in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "x" * (k + 1)
        near.append(" ".join(w))
    out = base + near + base[:5] + [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(5)]
    return out + ["", " ", None, None, "a", "A b\tc\nd", "<|endoftext|> x  y", "x" * 5000, "ab " * 3000, "É ß 字 😀 don't\r\n\n z", "Stop. Go, now. "]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 0, 0, 0) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "lone words here and there", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 8).collect()
    assert len(got) == docs.count()

    def jump(key, n):
        key, b, j = key & (2**64 - 1), -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    texts = dict(rows_of(docs))
    slots = collections.defaultdict(list)
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"] or 0, 8), jump(r["doc_id"] or 0, 9))
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, 8).count() == 0


def test_sharding_of_one_key_and_clashing_columns(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    one = sharding.shard_documents(rows, 8).collect()
    assert len({r["shard"] for r in one}) == 1 and sorted(r["slot"] for r in one) == list(range(5000))
    again = {(r["text_crc32"], r["slot"]) for r in sharding.shard_documents(rows.repartition(7), 8).collect()}
    assert again == {(r["text_crc32"], r["slot"]) for r in one}
    odd = spark.createDataFrame([(1, "a", "b", 7, 8), (1, "c", "d", 7, 9), (None, "e", None, 7, 9)], "k long, Shard string, _bucket string, slot int, _row int")
    out = sharding.assign_shards(odd, "k", 4, ["k", "slot", "_row"], "_row")
    assert out.columns == ["k", "_bucket", "_row", "shard", "grown_shard", "slot"]
    assert {(r["k"], r["_bucket"], r["_row"]) for r in out.collect()} == {(1, "b", 8), (1, "d", 9), (None, None, 9)}
    assert sorted(r["slot"] for r in out.where("k = 1").collect()) == [0, 1] or out.select("shard").distinct().count() == 1


def test_sharding_many_shards_and_keys(spark):
    keys = spark.createDataFrame([(k,) for k in (-1, 0, 1, 2**63 - 1, -(2**63), 123456789)], "k long")
    got = {r["k"]: r["j"]["shard"] for r in keys.select("k", sharding.jump_hash(keys["k"], 500).alias("j")).collect()}
    for key, shard in got.items():
        k, b, j = key & (2**64 - 1), -1, 0
        while j < 500:
            b, k = j, (k * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / ((k >> 33) + 1)))
        assert shard == b


def test_bpe(docs, empty):
    library = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want[(i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())] += 1
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_round_trip(docs, BYTE).collect())
    assert got == want
    assert bpe.bpe_round_trip(empty, BYTE).count() == 0


def test_packing(docs, empty):
    library = Tokenizer.from_file(WORD)
    got = packing.pack_documents(docs, WORD, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [0, *itertools.accumulate(r["length"] for r in parts)][:-1]
        total = sum(r["length"] for r in parts)
        assert total <= 2048 and total & (total - 1) == 0 and len(parts) <= packing.SEGMENTS
    counts = collections.Counter(i for i, _ in rows_of(docs))
    for i, t in rows_of(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert sum(r["length"] for r in by_doc[i]) == counts[i] * len(ids) and all(r["doc_tokens"] == len(ids) for r in by_doc[i])
        for r in by_doc[i]:
            assert bytes(r["ids"]) == struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])
    assert packing.pack_documents(empty, WORD).count() == 0


def test_packing_examples_keeps_limits(spark):
    rng = random.Random(1)
    rows = [(i, n := rng.randint(1, 900), rng.randint(0, n), "more") for i in range(400)] + [(None, 5000, 1, ""), (7, None, None, None)]
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long, offset string").repartition(2), 2048, 5, 1000).collect()
    assert collections.Counter(r["example_id"] for r in got) == collections.Counter(r[0] for r in rows)
    sums = collections.defaultdict(list)
    for r in got:
        sums[r["sequence_id"]].append(r)
    assert all(len(s) == 1 or (sum(r["tokens"] for r in s) <= 2048 and sum(r["loss_tokens"] for r in s) <= 1000 and len(s) <= 5) for s in sums.values())
    assert len(sums) < 200


def test_jaccard(docs, empty):
    sets = []
    for i, t in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[root(b)] = root(a)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    want = collections.Counter((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == want
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(5)
    for n in (5, 9, 12, 30, 64, 100, 250, 700):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, n // 9) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(drop), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert len(np.intersect1d(jaccard_join.part_keys(a), jaccard_join.part_keys(b))) > 0


def repeats(texts):
    seen = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not p for p, g in zip(b"\0" + gone, gone)), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [8192, 0])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = rows_of(docs)
    want = collections.Counter((i, *w) for (i, _), w in zip(rows, repeats([(t or "").encode() for _, t in rows])))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_ranks_tell_windows_apart():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[1500:2000] = raw[100:600]
    ranks = suffix_dedup.suffix_ranks(raw, np.zeros(len(raw), np.uint32))
    places = {}
    for k in range(len(raw) - 199):
        assert places.setdefault(raw[k : k + 200].tobytes(), ranks[k]) == ranks[k]
    assert len(set(places.values())) == len(places)


@pytest.mark.parametrize("cores, most", [(40, 25_000_000), (1, 90_000_000)])
def test_suffix_sort_of_a_large_group_takes_little_memory(cores, most):
    rng = np.random.default_rng(4)
    base = [rng.integers(97, 123, 340, dtype=np.uint8).tobytes() for _ in range(cores)]
    owner = rng.integers(0, cores, 7000)
    phrases = [base[c][:k] + rng.integers(97, 123, 300 - k, dtype=np.uint8).tobytes() for c, k in zip(owner, rng.integers(150, 300, len(owner)).tolist())]
    times = rng.integers(1, 3, len(owner))
    tracemalloc.start()
    got = suffix_dedup.repeated_windows(phrases, owner * 7 - 3, times)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    count = collections.Counter()
    for p, n in zip(phrases, times.tolist()):
        for k in range(len(p) - 199):
            count[hash(p[k : k + 200])] += n
    assert [g.tolist() for g in got] == [[count[hash(p[k : k + 200])] >= 2 for k in range(len(p) - 199)] for p in phrases]
    assert peak < most


def test_suffix_ranks_beyond_what_keys_and_places_share():
    raw = np.tile(np.arange(97, 117, dtype=np.uint8), (1 << 21) // 20 + 30)
    raw[-500:] = 120
    ranks = suffix_dedup.suffix_ranks(raw, np.zeros(len(raw), np.uint32))[: len(raw) - 199]
    plain = len(raw) - 500 - 199
    assert len(np.unique(ranks[:plain])) == 20 and (ranks[:plain] == np.resize(ranks[:20], plain)).all()
    assert len(np.unique(ranks[plain:-301])) == 199 and len(np.unique(ranks[-301:])) == 1


def test_toxicity(spark, empty):
    rng = random.Random(9)
    bad = ["vilest", "rotten", "scummy"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        t = words(rng, rng.randint(20, 120)).split()
        if toxic:
            for _ in range(max(2, len(t) // 30)):
                t.insert(rng.randrange(len(t)), rng.choice(bad) + rng.choice(["", "s", "ly"]))
        rows.append((i, " ".join(t), "en", "s", 0, 0, 0, 0))
        labels.append((i, int(toxic), "x"))
    rows += [(1000, None, None, None, None, None, None, None), (1001, "", "", "", 0, 0, 0, 0), (None, "a b c", "", "", 0, 0, 0, 0), rows[0]]
    labels += [(None, 1, ""), (5, None, ""), labels[0]]
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: y for i, y, _ in labels if y is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (1000, 1001))
    assert toxicity.toxicity(empty, known).count() == 0
    assert toxicity.toxicity(docs, known.limit(0)).where("predicted = 1").count() == 0


EMB = "vec_id long, embedding array<float>, label int, rep string, copies int"


def vectors(spark, dim=8):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, dim))
    x = np.concatenate([base, base + 0.08 * rng.standard_normal((12, dim)), base[:4] + 0.08 * rng.standard_normal((4, dim)), base[:3]]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], i % 2, "r", 1) for i in range(len(x))]
    n = len(rows)
    rows += [(n, None, 0, "", 0), (n + 1, [0.0] * dim, 0, "", 0), (n + 2, [float("nan")] + [1.0] * (dim - 1), 0, "", 0), (n + 3, [None] + [1.0] * (dim - 1), 0, "", 0)]
    rows += [(n + 4, rows[0][1], None, "", 0), (None, rows[0][1], 0, "", 0), (n + 5, [], 0, "", 0), (n + 6, [float("inf")] * dim, 0, "", 0), rows[1], (n + 7, [1.0, 2.0], 0, "", 0)]
    return spark.createDataFrame(rows, EMB), rows


@pytest.mark.parametrize("block", [1024, 3])
def test_embedding_dedup(spark, block):
    df, rows = vectors(spark)
    ok = [r[0] is not None and r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    least = {}
    for k, r in enumerate(rows):
        if ok[k]:
            least[root(k)] = min(r[0], least.get(root(k), r[0]))
    want = collections.Counter((r[0], links[k], least[root(k)] if ok[k] else r[0]) for k, r in enumerate(rows))
    got = embedding_dedup.near_duplicates(df, block=block).collect()
    found = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert sum((found & want).values()) >= 0.95 * len(rows) and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_topk(spark):
    df, rows = vectors(spark)
    ints = {}
    for r in rows:
        if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]):
            ints.setdefault(r[0], []).append(np.floor(256 * np.array(r[1])).astype(int))
    got = collections.defaultdict(list)
    base = topk_search.integer_vectors(df)
    for r in topk_search.top_k(base, base.where("vec_id % 5 = 0"), 5, query_block=3, row_block=10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in [i for i in ints if i % 5 == 0]:
        scores = sorted((-int(v @ ints[q][0]), i) for i in ints for v in ints[i] if i != q and len(v) == len(ints[q][0]))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk_search.top_k(base.limit(0), base.limit(0)).count() == 0


def test_sorted_lists_keep_all_winners():
    rng = np.random.default_rng(8)
    rows = rng.integers(-99, 99, (500, 16))
    queries = rows[:40]
    for q, at in zip(queries, topk_search.SortedLists(rows).candidates(queries.astype(float), np.full(40, 6))):
        assert set(np.argsort(-(rows @ q), kind="stable")[:6]) <= set(at)


def test_html(spark):
    page = '<html><head><title>t</title><style>x</style></head><body><nav><p>menu</p></nav><article><header>top</header><h1>A &amp; B</h1><p>one\n two<b> bold</b><p>three<br>four</p><div class="ad box">buy</div><div class="comments"><p>reader</p></div><script>var t="</p>";</script><form>f</form></article><footer>end</footer>'
    rows = [(1, "http://a.b/x", page, "m"), (2, None, None, "m"), (3, "http://a.b/y", "", "m"), (4, "nonsense", "just words < here", "m"), (5, "http://c.d/1", "<html><body><div class='top'>Site</div><div class='story'><p>p one here</p><p>two &lt;</p></div></body></html>", "m"), (6, "http://c.d/2", "<html><body><div class='top'>Site</div><div class='story'><p>other text now</p></div></body></html>", "m"), (1, "http://a.b/x", page, "m")]
    got = {(r["page_id"], r["url"]): r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, main string")).collect()}
    assert got[1, "http://a.b/x"] == "A & B\n\none two bold\n\nthree four"
    assert got[2, None] == "" and got[3, "http://a.b/y"] == "" and got[4, "nonsense"] == "just words < here"
    assert got[5, "http://c.d/1"] == "p one here\n\ntwo <" and got[6, "http://c.d/2"] == "other text now"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_has_groups_and_slots():
    pages = [f"<ul>{'<li>x</li>' * n}</ul><p>{'note' if n % 2 else 'text %d' % n}</p>{'<hr><b>q</b>' if n > 2 else ''}" for n in range(2, 6)]
    wrapper, _ = html_extract.infer(pages)
    assert '"+"' in wrapper and '"?"' in wrapper and '"#"' in wrapper


CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokenizer string, old_tokens long"


def test_rollup_counts_a_batch_once_whoever_commits_it(spark, tmp_path):
    path = str(tmp_path / "r")
    rollup = token_counts.Rollup(spark, path)
    assert rollup.totals().count() == 0 and not rollup.committed("a")
    rows = spark.createDataFrame([("insert", "s", "en", "t", 5, None, None), ("insert", "s", "en", "t", 7, None, None), ("delete", "s", "en", "t", 5, None, None)], CHANGES)
    sums = spark.createDataFrame([("s", "en", "t", 1, 7)], "source string, lang string, tokenizer string, documents long, tokens long")
    # A writer that broke off before its record leaves a folder that nobody counts; two that commit at once count as one.
    sums.write.parquet(f"{path}/data-broken")
    assert rollup.apply("a", rows) and not rollup.apply("a", rows)
    rollup._commit("a", sums, [])
    assert [(r["documents"], r["tokens"]) for r in rollup.totals().collect()] == [(1, 7)]
    rollup.apply("b", rows)
    rollup.compact(["a", "b"], "ab")
    rollup.compact(["a", "b"], "ab")
    assert [(r["documents"], r["tokens"]) for r in rollup.totals().collect()] == [(2, 14)]


def test_ids_above_2_to_the_53_beside_nulls(spark):
    ids = [2**53 + 1, 2**53 + 3, None, -(2**62) - 1]
    text = "some words of a text that is long enough to hold a few shingles in it"
    df = spark.createDataFrame([(i, f"{text} {k}" if k else text) for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, toxic int")
    for out in (bpe.bpe_round_trip(df, BYTE), suffix_dedup.remove_repeats(df), packing.pack_documents(df, WORD), toxicity.toxicity(df, labels), jaccard_join.jaccard_components(df), sharding.shard_documents(df, 8)):
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(ids)
    pages = df.select(df["doc_id"].alias("page_id"), F.lit("http://a.b/").alias("url"), df["text"].alias("html"))
    assert {r["page_id"] for r in html_extract.extract(pages).collect()} == set(ids)
    examples = spark.createDataFrame([(i, 10, 5) for i in ids], "example_id long, tokens long, loss_tokens long").coalesce(1)
    assert {r["example_id"] for r in packing.pack_examples(examples).collect()} == set(ids)


def test_toxicity_vectors_have_rank_and_know_misspellings(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(800):
        t = words(rng, rng.randint(30, 80)).split()
        if i % 3 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["scummiest", "rottenly", "vilenesses"]))
        rows.append((i, " ".join(t)))
        labels.append(int(i % 3 == 0))
    bags, y = [toxicity.bag(t) for _, t in rows], np.array(labels)
    vectors, weights, _ = toxicity.train_vectors(bags, y)
    held = vectors[np.abs(vectors).sum(axis=1) > 0]
    assert np.linalg.matrix_rank(held, tol=1e-2) > 1 and np.linalg.matrix_rank(weights) > 1
    projected, bias = toxicity.train(bags, y)
    score = lambda t: bias + sum(projected[k] @ v for k, v in [toxicity.shares(toxicity.bag(t))])
    clean = [words(rng, 50) for _ in range(40)]
    assert np.mean([score(t) < 0 for t in clean]) > 0.9
    # None of these spellings was seen; they share n-grams with words that were.
    assert np.mean([score(t + " sccummiest rotttenly vileneses scummmiest") > 0 for t in clean]) > 0.9


def test_html_long_unbalanced_pages_and_joined_class_words(spark):
    long = "<div class='a'><p title=\"open>text " * 120_000
    rows = [(1, "http://x.y/1", long), (2, "http://x.y/2", "<article><div class='side-by-side'>one</div><p class='alert-level'>two</p><section class='search-results-study'>three</section><div class='site-footer'>no</div></article>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "one\n\ntwo\n\nthree" and got[1]


def test_jaccard_large_bundles_in_blocks(spark, monkeypatch):
    """Near copies in blocks of few, so that both passes over blocks take part."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "COMMON", 2)
    monkeypatch.setattr(jaccard_join, "SPARE", 10_000)
    rng = random.Random(11)
    bases = [words(rng, 60).split() for _ in range(3)]
    rows = []
    for k in range(90):
        t = list(bases[k % 3])
        t[rng.randrange(60)] = f"w{k}"
        rows.append((k, " ".join(bases[(k + 1) % 3][:12] + t) if k % 5 == 0 else " ".join(t)))
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, z = label[a], label[b]
            label = [min(x, z) if v in (x, z) else v for v in label]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(enumerate(label))


def test_jaccard_plans_stay_small_for_the_driver(spark, monkeypatch):
    """No plan that is written unfolds into hundreds of nodes, of which the driver's memory would be full."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "COMMON", 2)
    monkeypatch.setattr(jaccard_join, "SPARE", 10_000)
    nodes = {}

    def counted(df, label):
        nodes[label] = max(nodes.get(label, 0), len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return common.written(df, label)

    monkeypatch.setattr(jaccard_join, "written", counted)
    monkeypatch.setattr(components, "written", counted)
    rng = random.Random(11)
    bases = [words(rng, 60).split() for _ in range(3)]
    rows = [(k, " ".join([*bases[k % 3][: k % 50], f"w{k}", *bases[k % 3][k % 50 + 1 :]])) for k in range(60)]
    assert jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60
    assert "jaccard-apart" in nodes and max(nodes.values()) <= 100, nodes


def test_one_of_each_group_whatever_its_doc_id(spark):
    base = " ".join(f"word{k}" for k in range(30))
    rows = [(7, base, "x"), (7, "quite another text of the same id and more words", "y"), (None, base, "z"), (None, "a lone text without an id at all here", "u"), (3, base + " tail", "v"), (9, None, "n"), (9, "", "e")]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["source"] for r in got) == ["e", "n", "u", "v", "y"]


def test_token_counts(docs, empty, tmp_path):
    library = Tokenizer.from_file(WORD)
    want = collections.Counter()
    seen, n = set(), collections.Counter()
    for r in docs.collect():
        if r["text"] is None or r["text"] not in seen:
            seen.add(r["text"])
            tokens = len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
            want[r["source"], r["lang"]] += tokens
            n[r["source"], r["lang"]] += 1
    got = token_counts.token_counts(docs, WORD, path=str(tmp_path / "r")).collect()
    assert {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in got} == {k: (n[k], want[k]) for k in want}
    assert {r["tokenizer"] for r in got} == {"word_bpe_49k/2"}
    rollup = token_counts.Rollup(docs.sparkSession, str(tmp_path / "r"))
    assert rollup.committed("1") and not rollup.committed("9")
    rollup.compact(["1", "2", "3"], "all")
    for all_ in (rollup.totals(["all"]), rollup.totals()):
        assert sorted(map(tuple, all_.collect()), key=str) == sorted(map(tuple, got), key=str)
    assert not rollup.apply("1", docs.sparkSession.createDataFrame([("insert", "s", "en", "t", 5, None, None)], CHANGES)) and rollup.committed("2")
    assert token_counts.token_counts(empty, WORD, path=str(tmp_path / "e")).count() == 0


def test_wrapper_of_all_pages_and_whole_pages(spark):
    menu = "".join(f"<b>m{k}</b><i>n{k % 7}</i>" + "<u>x</u>" * (k % 3) for k in range(900))
    long = [f"<html><body><div class='links'>{menu}</div><div class='story'><p>whole story {k} told here</p></div></body></html>" for k in range(8)]
    rows = [(k, "http://l.m/1", p) for k, p in enumerate(long)]
    elements = {}
    signatures = html_extract.host_signatures(spark.createDataFrame([("l.m", p) for _, _, p in rows], "host string, html string"))
    assert signatures.count() == 1
    for r in html_extract.host_elements(html_extract.host_votes(signatures)).collect():
        elements[r["host"]] = r["main"]
    assert elements == {"l.m": "<div.story"}
    # Every shape of a host takes part, however many there are, in wrappers of a bounded number of shapes.
    many = [("t.m", f"<body>{'<hr><em>e</em>' * (k % 2)}<div class='all'><div class='t{k}'><p>text {k} {j}</p></div></div><i>foot</i></body>") for k in range(200) for j in range(2)]
    signatures = html_extract.host_signatures(spark.createDataFrame(many, "host string, html string").repartition(5))
    votes = html_extract.host_votes(signatures)
    assert votes.where("element = ''").count() == 4 and {r["main"] for r in html_extract.host_elements(votes).collect()} == {"<div.all"}
    assert {r["element"] for r in votes.collect()} >= {f"<div.t{k}" for k in range(200)}


def test_html_takes_slots_of_the_hosts_element(spark):
    story = lambda k: f"<div class='story'><h2>Title {k}</h2><p><em>Posted by the desk</em></p><p>Unlike words number {k} of a long story</p></div>"
    rows = [(k, "http://h.i/1", f"<body><nav class='main-nav'><a>Home</a></nav>{story(k)}<article class='comment'><p>reader {k} says</p></article></body>") for k in range(5)]
    rows += [(9, "http://j.k/1", "<body><nav class='main-nav'><a>Home</a></nav><p>only text</p></body>"), (10, "http://j.k/2", "<body><article class='comment'>no</article><p>more text</p></body>")]
    copies = [(20 + k, "http://c.o/1", f"<body><article><p>{'One article copied with care. ' * 5}</p><b>{k} May</b></article></body>") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\n\nPosted by the desk\n\nUnlike words number {k} of a long story" for k in range(5))
    assert got[9] == "only text" and got[10] == "more text"
    assert all("One article copied with care." in got[20 + k] and f"{k} May" in got[20 + k] for k in range(5))


def test_jaccard_does_not_lean_on_the_order_of_rows(spark):
    rng = random.Random(7)
    rows = []
    for k in range(40):
        t = words(rng, 120).split()
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join([*t[:60], "changed", *t[61:]]))]
    # Every evaluation of this input deals its rows anew.
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("by", F.udf(lambda i: random.SystemRandom().random(), "double")("doc_id")).repartition(4, "by")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(80)}


def test_token_counts_of_all_documents_and_steady_survivors(spark):
    rows = [(5, "same words here", "en", "a"), (2, "same words here", "fr", "b"), (2, "same words here", None, "b"), (None, "same words here", "de", "c"), (9, "alone", "en", "a"), (9, None, "en", "a")]
    library = Tokenizer.from_file(WORD)
    size = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in rows}
    every = collections.defaultdict(lambda: (0, 0))
    for _, t, lang, source in rows:
        n, total = every[source, lang]
        every[source, lang] = (n + 1, total + size[t])
    for turned in (rows, rows[::-1]):
        docs = spark.createDataFrame(turned, "doc_id long, text string, lang string, source string").coalesce(1)
        got = token_counts.token_counts(docs, WORD, all_inserts=True).collect()
        by = lambda version: {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in got if r["tokenizer"] == version}
        assert by("word_bpe_49k/1") == every
        assert by("word_bpe_49k/2") == {("b", "fr"): (1, size["same words here"] + 1), ("a", "en"): (2, size["alone"] + size[None] + 2)}
