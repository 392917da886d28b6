"""Trees by counts against the tree that looks at every node's rows, and ranks by ranges against sorted lists."""

import numpy as np
import pytest

from tidemark.operators import evaluation as E
from tidemark.operators import modeling as L
from tidemark.operators import trees as T

NAMES = ["a", "b", "c"]


def grow(x, y, depth, min_leaf):
    """Nested tuples (feature, cut, left, right) or a share of positives."""
    if depth == 0 or len(y) < 2 * min_leaf or len(set(y)) < 2:
        return round(float(y.mean()), 9) if len(y) else 0.5
    best = None
    for f, name in enumerate(NAMES):
        for cut in np.unique(np.quantile(x[:, f], (0.25, 0.5, 0.75))):
            left = x[:, f] < cut
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            score = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or (round(score, 9), name, cut) < best[:3]:
                best = (round(score, 9), name, cut, left)
    if best is None:
        return round(float(y.mean()), 9)
    _, name, cut, left = best
    return name, round(float(cut), 9), grow(x[left], y[left], depth - 1, min_leaf), grow(x[~left], y[~left], depth - 1, min_leaf)


def nested(tree, at=1):
    n = tree[at]
    return round(n.probability, 9) if n.feature is None else (n.feature, round(n.cut, 9), nested(tree, 2 * at), nested(tree, 2 * at + 1))


@pytest.mark.parametrize("depth, min_leaf", [(2, 5), (3, 40)])
def test_tree_equals_brute_force(spark, depth, min_leaf):
    rng = np.random.default_rng(depth)
    x = np.column_stack([rng.integers(0, 6, 600), rng.standard_normal(600), rng.integers(0, 2, 600)]).astype(float)
    y = (rng.random(600) < 0.2 + 0.5 * (x[:, 0] > 2) * (x[:, 1] > 0)).astype(float)
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double").repartition(4).cache()
    tree = T.fit_tree(df, NAMES, "y", depth, min_leaf)
    assert nested(tree) == grow(x, y, depth, min_leaf)
    scores = df.withColumn("s", T.tree_score(tree)).agg({"s": "avg", "y": "avg"}).first()
    assert abs(scores["avg(s)"] - scores["avg(y)"]) < 1e-9
    leaf = T.fit_tree(df.where("a < 0"), NAMES, "y")
    assert nested(leaf) == 0.5


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(2)
    groups = {"skew": np.concatenate([np.full(900, 7.0), rng.standard_normal(300)]), "even": rng.permutation(1000).astype(float), "one": np.array([4.0]), None: rng.integers(0, 3, 50).astype(float)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    run = {(r["g"], r["v"]): (r["_upto"], r["_all"]) for r in E.running_counts(df, ["g"], "v").collect()}
    for g, values in groups.items():
        for v in set(values.tolist()):
            assert run[g, v] == ((values <= v).sum(), len(values))
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    low, high = E.nearest_rank(df, ["g"], "v", shares).collect(), E.nearest_rank(df, ["g"], "v", shares, upper=True).collect()
    between = L.interpolated(df, ["g"], "v", shares).collect()
    for g, values in groups.items():
        s = np.sort(values)
        for rows_, want in ((low, lambda q: s[int((len(s) - 1) * q)]), (high, lambda q: s[max(1, int(np.ceil(len(s) * q))) - 1]), (between, lambda q: np.quantile(s, q))):
            got = next(r for r in rows_ if r["g"] == g)
            assert all(abs(got[k] - want(q)) < 1e-9 for k, q in shares.items())
    whole = E.nearest_rank(df, [], "v", {"p50": 0.5}).first()["p50"]
    every = np.sort(np.concatenate(list(groups.values())))
    assert whole == every[int((len(every) - 1) * 0.5)]
    assert E.nearest_rank(df.limit(0), ["g"], "v", shares).count() == 0
