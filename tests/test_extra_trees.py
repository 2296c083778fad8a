"""Trees grown in Spark against the same draws evaluated node by node over plain rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrier.plans import extra_trees as E

COLUMNS = ["a", "b", "c", "d.e", "same"]


def data(spark, n=600, parts=5):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 4, n), rng.random(n), rng.normal(size=n), rng.integers(0, 2, n), np.ones(n)]).astype(float)
    y = ((x[:, 0] + 2 * x[:, 3] + x[:, 1] > 2.4) ^ (rng.random(n) < 0.05)).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, `d.e` double, same double, y int").repartition(parts)


def gini(y):
    return 2 * y.mean() * (1 - y.mean()) * len(y) if len(y) else 0.0


def test_every_node_against_plain_rows(spark):
    x, y, df = data(spark)
    model = E.train(df, COLUMNS, "y", n_trees=4, depth=5, seed=5)
    k, seen = max(1, math.isqrt(len(COLUMNS))), 0

    def walk(node, rows, level):
        nonlocal seen
        seen += 1
        assert model.value[node] == pytest.approx(y[rows].mean())
        rng = np.random.default_rng([5, node])
        features = rng.permutation(len(COLUMNS))[: 2 * k]
        places, best, used = rng.random(len(features)), None, 0
        for f, place in zip(features, places, strict=True):
            lo, hi = x[rows, f].min(), x[rows, f].max()
            if hi > lo and used < k:
                used += 1
                at = min(lo + place * (hi - lo), np.nextafter(hi, -np.inf))
                left, right = rows[x[rows, f] <= at], rows[x[rows, f] > at]
                after = gini(y[left]) + gini(y[right])
                if best is None or after < best[0] - 1e-9:
                    best = (after, f, at, left, right)
        if best is None or gini(y[rows]) == 0 or len(rows) < 2 or level == 5:
            assert model.feature[node] == -1
            return
        assert (model.feature[node], model.threshold[node]) == (best[1], best[2])
        walk(model.left[node], best[3], level + 1)
        walk(model.left[node] + 1, best[4], level + 1)

    for tree in range(4):
        walk(tree, np.arange(len(x)), 0)
    assert seen == len(model.feature)


def test_partitions_do_not_matter_and_models_are_kept(spark, tmp_path):
    x, y, df = data(spark)
    one, other = (E.train(df.repartition(p), COLUMNS, "y", n_trees=27, depth=4) for p in (1, 7))
    assert (one.feature == other.feature).all() and (one.threshold == other.threshold).all()
    E.save(one, str(tmp_path / "m"))
    again = E.load(str(tmp_path / "m"))
    scored = E.predict(df.drop("same").withColumn("extra", F.lit("x")), again, ["id"]).toPandas().set_index("id").sort_index()
    without = x.copy()
    without[:, 4] = 0  # a missing feature counts as 0
    assert np.allclose(scored["probability"], one.probability(without))


def test_accuracy_on_unseen_rows(spark):
    x, y, df = data(spark, n=1500)
    model = E.train(df.where("id % 3 <> 0"), COLUMNS, "y", n_trees=30, depth=8)
    p = model.probability(x[::3])
    assert ((p > 0.5) == y[::3]).mean() > 0.88  # a twentieth of the labels are turned over


def test_degenerate_rows(spark):
    schema = "a double, y int"
    with pytest.raises(ValueError, match="both classes"):
        E.train(spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, None)], schema), ["a"], "y", n_trees=2)
    with pytest.raises(ValueError, match="both classes"):
        E.train(spark.createDataFrame([], schema), ["a"], "y", n_trees=2)
    same = E.train(spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 0), (1.0, 0)], schema), ["a"], "y", n_trees=2)
    assert (same.feature == -1).all() and (same.value == 0.25).all()
    assert E.predict(spark.createDataFrame([], schema), same, []).count() == 0
    gaps = E.train(spark.createDataFrame([(None, 0), (float("nan"), 0), (9.0, 1)], schema), ["a"], "y", n_trees=3)
    assert gaps.probability(np.array([[0.0], [9.0]])).tolist() == [0.0, 1.0]
