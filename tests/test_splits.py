"""Exact trees against a plain search over all boundaries, and MLlib's trees against them where its bins hold every value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import models, splits


def gini(zero, one):
    return 1 - (zero**2 + one**2) / (zero + one) ** 2


def plain(x, y, names, depth, leaf, balanced=True):
    """{node: (feature, threshold, n, share)} by looking at every boundary of every feature."""
    weight = [len(y) / (2 * max((y == c).sum(), 1)) if balanced and (y == c).any() else 1.0 for c in (0, 1)]
    both = lambda rows: ((y[rows] == 0).sum() * weight[0], (y[rows] == 1).sum() * weight[1])
    out, waiting = {}, [(1, np.arange(len(y)), 0)] if len(y) else []
    for node, rows, level in waiting:
        zero, one = both(rows)
        best = None
        for k in range(x.shape[1] if level < depth else 0):
            for low, high in zip(values := np.unique(x[rows, k]), values[1:]):
                left, right = rows[x[rows, k] <= low], rows[x[rows, k] > low]
                if min(len(left), len(right)) >= leaf:
                    a, b = both(left), both(right)
                    gain = round(gini(zero, one) - (sum(a) * gini(*a) + sum(b) * gini(*b)) / (zero + one), 10)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, k, (low + high) / 2, left, right
        out[node] = (names[best[1]] if best else None, best[2] if best else None, len(rows), one / (zero + one))
        if best:
            waiting += [(2 * node, best[3], level + 1), (2 * node + 1, best[4], level + 1)]
    return out


def data(seed=3, n=400):
    draw = np.random.Generator(np.random.PCG64(seed))
    x = draw.integers(0, 20, (n, 3)).astype(float)
    y = ((x[:, 0] > 11) & (x[:, 1] < 8) | (draw.random(n) < 0.08)).astype(int)
    return x, y


NAMES = ["a", "b", "c"]


@pytest.mark.parametrize("depth,leaf,balanced", [(0, 1, True), (2, 5, True), (4, 3, False)])
def test_tree_is_that_of_a_plain_search(spark, depth, leaf, balanced):
    x, y = data(depth)
    x[::37, 1] = -np.inf  # missing below
    rows = [(*(None if np.isneginf(v) else float(v) for v in row), int(c)) for row, c in zip(x, y)] + [(1.0, 2.0, 3.0, None)]
    table = spark.createDataFrame(rows, "a double, b double, c double, y int")
    nodes = splits.grow(table, NAMES, "y", depth, leaf, balanced)
    found = {r.node: (r.feature, r.threshold, r.n, r.share) for r in nodes.collect()}
    wanted = plain(x, y, NAMES, depth, leaf, balanced)
    assert found.keys() == wanted.keys()
    for node, (feature, threshold, n, share) in wanted.items():
        assert found[node][:3] == (feature, threshold, n) and found[node][3] == pytest.approx(share, abs=1e-12)
    scored = splits.score(nodes, table.where("y is not null"))
    assert {r.leaf: r.n for r in scored.groupBy("leaf").agg(F.count("*").alias("n")).collect()} == {k: v[2] for k, v in wanted.items() if v[0] is None}


def test_mllib_agrees_where_its_bins_hold_every_value(spark):
    x, y = data(9, 600)
    table = spark.createDataFrame([(*map(float, row), int(c)) for row, c in zip(x, y)], "a double, b double, c double, y int")
    whole = splits.grow(table, NAMES, "y", 2, 5)
    nodes = splits.merged(whole)
    assert 1 < nodes.count() < whole.count()
    mine = {r.feature: r.importance for r in splits.importances(nodes).collect()}
    weighted = models.balance_weights(table, "y")
    for kind, more in (("tree", {}), ("forest", {"trees": 1, "bootstrap": False, "subset": "all"})):
        model = models.tree_pipeline(NAMES, "y", kind, depth=2, leaf=5, **more).fit(weighted)
        tree = model.stages[-1].trees[0] if kind == "forest" else model.stages[-1]
        root = next(r for r in nodes.collect() if r.node == 1)
        assert NAMES[tree._call_java("rootNode").split().featureIndex()] == root.feature
        assert tree._call_java("rootNode").split().threshold() == root.threshold
        theirs = {r.feature: r.importance for r in models.importances(model, NAMES, table).collect() if r.importance > 0}
        assert theirs.keys() == mine.keys() and all(theirs[f] == pytest.approx(mine[f], abs=1e-9) for f in mine)
        scored = splits.score(nodes, models.predict(model, weighted).withColumnRenamed("score", "theirs"))
        assert scored.where(F.abs(F.col("score") - F.col("theirs")) > 1e-9).count() == 0


def test_one_class_no_rows_and_refusals(spark):
    table = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1)], "a double, y int")
    (only,) = splits.grow(table, ["a"], "y", 3, 1).collect()
    assert (only.node, only.feature, only.n, only.share) == (1, None, 3, 1.0)
    empty = splits.grow(table.where("false"), ["a"], "y")
    assert empty.count() == 0 and splits.importances(empty).count() == 0 and splits.score(empty, table).where("score is not null").count() == 0
    with pytest.raises(ValueError):
        splits.grow(table.withColumn("y", F.lit(2)), ["a"], "y")
    with pytest.raises(ValueError):
        splits.grow(table, [], "y")
