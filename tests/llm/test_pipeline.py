"""The pipeline's stages on the smallest tables, each against what its operator says of its own input."""

import corpus_pipeline as P
from tidemark.llm import jaccard_join, suffix_dedup
from tidemark.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = P.drop_toxic(spark, docs, sf_dir).cache()
    assert clean.columns == P.COLUMNS and 0.5 * len(before) < clean.count() <= len(before)
    assert all(before[r["doc_id"]] == r["text"] for r in clean.collect())
    single = P.drop_near_duplicates(spark, clean, sf_dir).cache()
    want = {r["component_id"] for r in jaccard_join.jaccard_components(clean).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want) and single.columns == P.COLUMNS
    cut = P.drop_repeated_passages(spark, single, sf_dir)
    left = {r["doc_id"]: r for r in cut.collect()}
    for r in suffix_dedup.remove_repeats(single).collect():
        assert (r["doc_id"] in left) == (r["n_removed"] < r["n_bytes"] or r["n_bytes"] == 0)
    assert all(r["n_chars"] == len(r["text"]) for r in left.values()) and cut.columns == P.COLUMNS
    packed = P.pack(spark, cut, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)
    assert P.STAGES[0][0] == "toxicity" and len(P.STAGES) == 4
