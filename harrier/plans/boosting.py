"""Second-order boosted trees for a binary label, with sampling of rows and of features for each tree.

Values are cut at quantiles that one sketch per feature gives; each level of a tree is one pass in which the tasks add up gradients
and second derivatives of the logistic loss by node, feature and bin, Spark sums them, and the driver picks splits from the sums
(nodes x features x bins numbers, whatever the rows). Sums are of fixed-point numbers, so for given
cuts the model doesn't depend on how rows are partitioned (the sketch's cuts may, within its error). Which rows a tree sees follows from the hash of a row's key and the tree's number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.plans import blocks
from harrier.plans.models import SEED, align
from harrier.sources.store import shared_folder

BINS, ACCURACY = 64, 10_000
#: Gradients are summed in units of 2**-24: 2**38 rows fit into 64 bits.
UNIT = float(1 << 24)
#: So many trees' margins are added anew in each pass before they are written into the rows.
REFRESH = 20


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1; the right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])  # bins up to it go left
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        return blocks.descend(bins, 0, np.array(self.feature), np.array(self.cut), np.array(self.left))


@dataclass
class Boosted:
    columns: list[str]
    edges: list[list[float]]
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        return self.rate * sum((np.array(t.value)[t.leaves(bins)] for t in self.trees[first:]), np.zeros(len(bins)))


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The bin of each value: how many edges lie below it."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).T


def sampled(keys: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Whether a tree sees a row: a mix of the key's hash, the tree and the seed against the share."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((tree * 0x9E3779B97F4A7C15 + seed) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def derivatives(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """First and second derivative of the logistic loss, in fixed point (whole numbers in doubles)."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(np.stack([p - y, p * (1 - p)]) * UNIT)


def best_splits(sums: np.ndarray, allowed: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """feature, bin and gain of the best split of each node (the first of equal ones), and the value of the node as a leaf.

    sums: nodes x features x bins x (gradient, second derivative). Both sides need at least ``least`` of the second.
    """
    left = sums.cumsum(axis=2)[:, :, :-1] / UNIT
    total = sums[:, :1].sum(axis=2, keepdims=True) / UNIT
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = score(left) + score(right) - score(total)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least) & allowed[None, :, None], gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    value = -total[:, 0, 0, 0] / (total[:, 0, 0, 1] + penalty)
    return at // gain.shape[2], at % gain.shape[2], flat[np.arange(len(flat)), at], value


#: The arrays of a block: hashed keys, labels, bins (features by rows) and margins.
BLOCK, KINDS = ("key", "y", "bins", "margin"), (np.int64, np.int8, np.int16, np.float64)


def _sums(rows: DataFrame, model: Boosted, tree: Tree, nodes: range, first: int, share: float, seed: int) -> np.ndarray:
    number, width, bins = len(model.trees), len(model.columns), max(len(e) for e in model.edges) + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, len(nodes), width, bins), dtype=np.int64)
        for key, y, b, margin in blocks.arrays(batches, KINDS):
            b = b.reshape(width, -1)
            node = tree.leaves(b.T) - nodes.start
            here = np.flatnonzero((node >= 0) & sampled(key, number, share, seed))
            if len(here):
                b = b.take(here, axis=1)
                d, at = derivatives(margin[here] + model.margin(b.T, first), y[here]), node[here] * bins
                for f in range(width):
                    for i in (0, 1):  # a block's sums of whole numbers are exact in doubles
                        out[i, :, f] += np.bincount(at + b[f], weights=d[i], minlength=len(nodes) * bins).astype(np.int64).reshape(len(nodes), bins)
        g, h = out.reshape(2, -1)
        seen = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (seen, g[seen], h[seen])], ["slot", "g", "h"])

    table = rows.mapInArrow(task, "slot long, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros((len(nodes) * width * bins, 2), dtype=np.int64)
    out[table["slot"], 0], out[table["slot"], 1] = table["g"], table["h"]
    return out.reshape(len(nodes), width, bins, 2)


def train(
    df: DataFrame, columns: Sequence[str], label: str, key: str, n_trees: int = 100, depth: int = 6, rate: float = 0.1,
    rows_share: float = 0.9, columns_share: float = 0.9, penalty: float = 1.0, least: float = 1.0, seed: int = SEED,
) -> Boosted:
    """Boosted trees over aligned features (missing ones count as 0), from a probability of a half on; rows without a label are left out.

    ``key`` is a column that tells rows apart; rows of one key are sampled together. Needs rows of both classes.
    """
    carried = align(df.where(F.col(f"`{label}`").isNotNull()), columns, [label, key] if key != label else [label])
    features = [f"f{i}" for i in range(len(columns))]
    rows = carried.select(F.xxhash64(F.col(f"`{key}`")).alias("key"), F.col(f"`{label}`").cast("int").alias("y"), *(F.col(f"`{c}`").alias(f) for c, f in zip(columns, features, strict=True)))
    if rows.select(F.countDistinct("y")).first()[0] != 2:
        raise ValueError("training needs rows of both classes")
    shared_folder(df.sparkSession)
    at = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    cuts = rows.agg(*(F.percentile_approx(f, at, F.lit(ACCURACY)).alias(f) for f in features)).first()
    model = Boosted(list(columns), [sorted(set(e)) for e in cuts], rate)
    edges = model.edges

    def block(batch: list[np.ndarray]) -> list[np.ndarray]:
        key, y, *x = batch
        return [key, y.astype(np.int8), np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x, strict=True)]).astype(np.int16), np.zeros(len(y))]

    rows, first = blocks.pack(rows, block, BLOCK).checkpoint(), 0
    for t in range(n_trees):
        if t - first == REFRESH:
            rows, first = _with_margin(rows, model, first).checkpoint(), t
        rng = np.random.default_rng([seed, t])
        allowed = np.zeros(len(columns), dtype=bool)
        allowed[rng.permutation(len(columns))[: max(1, round(columns_share * len(columns)))]] = True
        tree, nodes = Tree(), range(1)
        for level in range(depth + 1):
            feature, cut, gain, value = best_splits(_sums(rows, model, tree, nodes, first, rows_share, seed), allowed, penalty, least)
            begin = len(tree.feature)
            for i, node in enumerate(nodes):
                tree.value[node] = float(value[i])
                if level < depth and gain[i] > 1e-9:
                    tree.feature[node], tree.cut[node], tree.left[node] = int(feature[i]), int(cut[i]), len(tree.feature)
                    for a, x in ((tree.feature, -1), (tree.cut, 0), (tree.left, 0), (tree.value, 0.0)):
                        a.extend((x, x))
            nodes = range(begin, len(tree.feature))
            if not len(nodes):
                break
        model.trees.append(tree)
    return model


def _with_margin(rows: DataFrame, model: Boosted, first: int) -> DataFrame:
    width = len(model.columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.arrays(batches, KINDS):
            new = [*block[:3], block[3] + model.margin(block[2].reshape(width, -1).T, first)]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in new], list(BLOCK))

    return rows.mapInArrow(task, rows.schema)


def predict(df: DataFrame, model: Boosted, keep: Sequence[str], name: str = "probability") -> DataFrame:
    """``keep`` and the probability of the positive class."""

    @F.pandas_udf("double")
    def probability(x: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-model.margin(binned(x.to_numpy(), model.edges)))) if len(x) else np.zeros(0))

    rows = align(df, model.columns, keep)
    return rows.select(*(F.col(f"`{k}`") for k in keep), probability(F.struct(*(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(model.columns)))).alias(name))
