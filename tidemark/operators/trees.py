"""Shallow decision trees and stumps by counts: one partial aggregate a level, whatever the number of rows.

The cut points of a node are the quartiles of its own rows. A level counts, for every node, feature and cut point, the rows
and the positives to its left; gini impurities and the choice of splits follow from these few numbers on the driver.
Rows are never moved to nodes: the splits so far, as one expression, say where a row is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import modeling as L

QUARTERS = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


@dataclass
class Node:
    """A leaf until it is split; rows below ``cut`` of ``feature`` go left (2 * number), others right."""

    number: int
    rows: int
    positives: float
    feature: str | None = None
    cut: float = 0.0

    @property
    def probability(self) -> float:
        """Share of positives; one half without rows."""
        return self.positives / self.rows if self.rows else 0.5


def _gini(rows: int, positives: float) -> float:
    return 2 * positives * (1 - positives / rows)


def _place(tree: dict[int, Node], at: int = 1) -> Column:
    """Number of the node that a row falls into."""
    node = tree[at]
    if node.feature is None:
        return F.lit(at)
    return F.when(F.col(node.feature) < node.cut, _place(tree, 2 * at)).otherwise(_place(tree, 2 * at + 1))


def cut_points(rows: DataFrame, features: list[str]) -> DataFrame:
    """node, feature and quartiles of each node's rows (``rows`` has a column node)."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    long = rows.select("node", F.inline(pairs))
    return L.interpolated(long, ["node", "feature"], "value", QUARTERS)


def candidates(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """node, feature, cut, rows, positives, left and left_positives of every cut point of every node."""
    cuts = cut_points(rows, features).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.array(*QUARTERS)))).alias("cuts"))
    held = rows.join(F.broadcast(cuts), "node")  # a row for each node
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"), F.first("cuts").alias("cuts")]
    for k, f in enumerate(features):
        for q in range(len(QUARTERS)):
            below = F.col(f) < F.element_at(F.element_at("cuts", F.lit(f)), q + 1)
            sums += [F.count(F.when(below, 1)).alias(f"l{k}_{q}"), F.coalesce(F.sum(F.when(below, F.col(label))), F.lit(0.0)).alias(f"p{k}_{q}")]
    found = held.groupBy("node").agg(*sums)
    each = [F.struct(F.lit(f).alias("feature"), F.element_at(F.element_at("cuts", F.lit(f)), q + 1).alias("cut"), F.col(f"l{k}_{q}").alias("left"), F.col(f"p{k}_{q}").alias("left_positives")) for k, f in enumerate(features) for q in range(len(QUARTERS))]
    return found.select("node", "rows", "positives", F.inline(F.array(*each))).distinct()


def impurity(rows: Column, positives: Column, left: Column, left_positives: Column) -> Column:
    """Gini impurity of both sides, times their rows."""
    side = lambda n, p: F.coalesce(2 * p * (1 - F.try_divide(p, n)), F.lit(0.0))
    return side(left, left_positives) + side(rows - left, positives - left_positives)


def fit_tree(rows: DataFrame, features: list[str], label: str, max_depth: int = 2, min_leaf: int = 20) -> dict[int, Node]:
    """A tree by node number (root 1), equal to the one that grows by looking at every node's own rows.

    Of cuts of equal impurity the first feature by name counts, then the smallest cut. A node of fewer than twice
    ``min_leaf`` rows, of one class, or without a cut that leaves ``min_leaf`` rows on both sides stays a leaf. Rows with a
    null feature or label take no part.
    """
    rows = rows.select(*features, F.col(label).cast("double").alias(label)).na.drop()
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0.0)).alias("p")).first()
    tree, open_ = {1: Node(1, total["n"], total["p"])}, [1]
    for _ in range(max_depth):
        able = [i for i in open_ if tree[i].rows >= 2 * min_leaf and 0 < tree[i].positives < tree[i].rows]
        if not able:
            break
        placed = rows.withColumn("node", _place(tree)).where(F.col("node").isin(able))
        best: dict[int, tuple] = {}
        for c in candidates(placed, features, label).collect():  # three cuts of each feature of a level's nodes
            right = c["rows"] - c["left"]
            if min(c["left"], right) < min_leaf:
                continue
            score = _gini(c["left"], c["left_positives"]) + _gini(right, c["positives"] - c["left_positives"])
            found = (score, c["feature"], c["cut"], c["left"], c["left_positives"])
            best[c["node"]] = min(best.get(c["node"], found), found)
        open_ = []
        for i, (_, feature, cut, left, positives) in best.items():
            tree[i].feature, tree[i].cut = feature, cut
            tree[2 * i] = Node(2 * i, left, positives)
            tree[2 * i + 1] = Node(2 * i + 1, tree[i].rows - left, tree[i].positives - positives)
            open_ += [2 * i, 2 * i + 1]
    return tree


def tree_score(tree: dict[int, Node]) -> Column:
    """A row's share of positives: that of its leaf."""
    leaves = [n for n in tree.values() if n.feature is None]
    place = _place(tree)
    return reduce(lambda other, n: F.when(place == n.number, n.probability).otherwise(other), leaves, F.lit(None).cast("double"))


def stumps(rows: DataFrame, features: list[str], label: str, k: int = 8) -> DataFrame:
    """feature, threshold (its median), direction and accuracy of the k best stumps, all counted in one aggregate."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    middle = {r["feature"]: r["q2"] for r in L.interpolated(rows.select(F.inline(pairs)), ["feature"], "value", {"q2": 0.5}).collect()}
    out = []
    for f, threshold in middle.items():
        for name, high in (("gte_positive", 1.0), ("lt_positive", 0.0)):
            call = F.when(F.col(f) >= threshold, high).otherwise(1 - high)
            out.append(F.struct(F.lit(f).alias("feature"), F.lit(threshold).alias("threshold"), F.lit(name).alias("direction"), F.avg((call == F.col(label)).cast("double")).alias("accuracy")))
    found = rows.agg(F.array(*out).alias("s")).select(F.inline("s"))
    return found.orderBy(F.desc("accuracy"), "feature", "direction").limit(k)
