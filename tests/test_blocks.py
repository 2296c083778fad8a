"""Descent of trees over whole columns against a walk of each row."""

import numpy as np
import pytest

from harrier.plans import blocks


@pytest.mark.parametrize("kind", [np.int16, np.float64])
@pytest.mark.parametrize("nodes", [0, 5, 200])  # none, within and beyond the nodes compared at once
def test_descend_against_a_walk(kind, nodes):
    rng = np.random.default_rng(nodes)
    values = rng.integers(0, 50, (4, 3000)).astype(kind).T
    feature, bound, left = [-1, -1], [0, 0], [0, 0]  # two roots
    for _ in range(nodes):
        node = int(rng.choice(np.flatnonzero(np.array(feature) < 0)[1:] if feature[1] < 0 else np.flatnonzero(np.array(feature) < 0)))
        if node:
            feature[node], bound[node], left[node] = int(rng.integers(4)), int(rng.integers(50)), len(feature)
            feature, bound, left = feature + [-1, -1], bound + [0, 0], left + [0, 0]

    def walk(row):
        at = 1
        while feature[at] >= 0:
            at = left[at] + int(row[feature[at]] > bound[at])
        return at

    got = blocks.descend(values, 1, np.array(feature), np.array(bound, dtype=np.float64 if kind is np.float64 else np.int64), np.array(left))
    assert got.tolist() == [walk(r) for r in values]
    assert blocks.descend(values[:0], 1, np.array(feature), np.array(bound), np.array(left)).tolist() == []
