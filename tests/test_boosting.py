"""Boosted trees against the same rules over plain rows, and their accuracy beside MLlib's."""

import numpy as np
import pytest

from harrier.plans import boosting as B
from harrier.plans import models

COLUMNS = ["a", "b", "c"]


def data(spark, n=900, parts=4):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 5, n), rng.normal(size=n), rng.random(n)]).astype(float)
    y = ((x[:, 0] * x[:, 2] + x[:, 1] > 1) ^ (rng.random(n) < 0.03)).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, y int").repartition(parts)


def test_trees_against_plain_rows(spark, monkeypatch):
    x, y, df = data(spark)
    monkeypatch.setattr(B, "REFRESH", 2)
    model = B.train(df, COLUMNS, "y", "id", n_trees=4, depth=3, rows_share=1.0, columns_share=1.0)
    bins, margin = B.binned(x, model.edges), np.zeros(len(x))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def gain_of(rows, left):
            parts = [(g[r].sum(), h[r].sum()) for r in (rows[left], rows[~left], rows)]  # noqa: B023
            if min(parts[0][1], parts[1][1]) < 1:
                return -np.inf
            return sum(s * a * a / (b + 1) for s, (a, b) in zip((1, 1, -1), parts, strict=True))

        def walk(node, rows, level):
            assert tree.value[node] == pytest.approx(-g[rows].sum() / (h[rows].sum() + 1), abs=1e-5)  # noqa: B023
            best = max(gain_of(rows, bins[rows, f] <= c) for f in range(3) for c in range(B.BINS))
            if level == 3 or best <= 1e-6:
                assert tree.feature[node] == -1  # noqa: B023
                return
            left = bins[rows, tree.feature[node]] <= tree.cut[node]  # noqa: B023
            assert gain_of(rows, left) == pytest.approx(best, abs=1e-4)
            walk(tree.left[node], rows[left], level + 1)  # noqa: B023
            walk(tree.left[node] + 1, rows[~left], level + 1)  # noqa: B023

        walk(0, np.arange(len(x)), 0)
        margin = margin + model.rate * np.array(tree.value)[tree.leaves(bins)]
    scored = B.predict(df, model, ["id"]).toPandas().set_index("id").sort_index()
    assert np.allclose(scored["probability"], 1 / (1 + np.exp(-margin)))


def test_partitions_do_not_matter_and_rows_are_sampled(spark):
    _, _, df = data(spark, n=300)
    one, other = (B.train(df.repartition(p), COLUMNS, "y", "id", n_trees=3, depth=3) for p in (1, 6))
    assert one == other
    keys = np.arange(20_000)
    seen = [B.sampled(keys, t, 0.9, 1) for t in range(2)]
    assert all(abs(s.mean() - 0.9) < 0.01 for s in seen) and (seen[0] != seen[1]).mean() > 0.15


def test_accuracy_beside_mllib(spark):
    x, y, df = data(spark, n=1500)
    learn, unseen = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    ours = B.predict(unseen, B.train(learn, COLUMNS, "y", "id", n_trees=25, depth=4, rate=0.3), ["y"]).toPandas()
    model, _ = models.train(learn, COLUMNS, "y", "gradient_boosting")
    theirs = models.predict(unseen, model, COLUMNS, ["y"]).toPandas()
    right = lambda d: ((d["probability"] > 0.5) == d["y"]).mean()
    print("boosting", right(ours), "mllib", right(theirs))
    assert right(ours) > 0.88 and right(ours) > right(theirs) - 0.03


def test_degenerate_rows(spark):
    schema = "id int, a double, y int"
    with pytest.raises(ValueError, match="both classes"):
        B.train(spark.createDataFrame([], schema), ["a"], "y", "id", n_trees=1)
    same = B.train(spark.createDataFrame([(i, None, i % 2) for i in range(8)], schema), ["a"], "y", "id", n_trees=2, rows_share=1.0)
    assert all(t.feature == [-1] for t in same.trees)
    assert B.predict(spark.createDataFrame([], schema), same, ["id"]).count() == 0
