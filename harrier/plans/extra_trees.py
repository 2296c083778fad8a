"""Extremely randomised trees, grown level by level over rows that stay in Spark.

For each open node of all trees a seeded draw names features and, once the range of each among the node's rows is known,
a threshold for each. Two passes a level over the rows give the ranges and then the class counts beside each threshold;
both are combined in the tasks and summed in Spark, and only these statistics (a few numbers for each open node, never rows)
reach the driver, which keeps the best split by Gini impurity. Every tree sees all rows. Results depend on rows and seed
alone, not on their partitions, as sums are of whole numbers and ranges are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.plans import blocks
from harrier.plans.models import SEED, align
from harrier.sources.store import shared_folder

#: Trees whose statistics are gathered in one pass.
TREES_A_PASS = 25


@dataclass
class ExtraTrees:
    """Nodes of all trees in flat arrays: roots come first; a leaf has feature -1; the right child follows the left one."""

    columns: list[str]
    n_trees: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray  # share of positives

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node of a tree that each row ends in."""
        return blocks.descend(x, tree, self.feature, self.threshold, self.left)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sum((self.value[self.leaves(x, t)] for t in range(self.n_trees)), np.zeros(len(x))) / self.n_trees


def _drawn(seed: int, node: int, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a node in random order (twice as many as wanted, since some may be constant) and the places of their thresholds."""
    rng = np.random.default_rng([seed, node])
    features = rng.permutation(width)[: 2 * k]
    return features, rng.random(len(features))


#: The arrays of a block: features (features by rows) and labels.
BLOCK, KINDS = ("x", "y"), (np.float64, np.int8)


def _met(batches: Iterator[pa.RecordBatch], model: ExtraTrees, trees: range, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block and tree that has rows in open nodes: features, labels, and those rows with the places of their nodes, by place."""
    for x, y in blocks.arrays(batches, KINDS):
        x = x.reshape(len(model.columns), -1)
        for t in trees:
            p = place.take(model.leaves(x.T, t))
            order = np.argsort(p, kind="stable")  # of 16 bits: by radix
            order = order[np.count_nonzero(p < 0) :]
            if len(order):
                yield x, y, order, p.take(order).astype(np.int64)


def _places(model: ExtraTrees, open_nodes: np.ndarray) -> np.ndarray:
    place = np.full(len(model.feature), -1, dtype=np.int16 if len(open_nodes) < 2**15 else np.int32)
    place[open_nodes] = np.arange(len(open_nodes))
    return place


def _ranges(rows: DataFrame, model: ExtraTrees, trees: range, open_nodes: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest value of each candidate feature among the rows of each open node; infinite where there are none."""
    place, width = _places(model, open_nodes), candidates.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(candidates.T.shape, np.inf), np.full(candidates.T.shape, -np.inf)
        for x, _, row, p in _met(batches, model, trees, place):
            flat, n = x.ravel(), x.shape[1]
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            node = p[starts]
            for j in range(width):
                values = flat.take(candidates[:, j].take(p) * n + row)
                lo[j, node] = np.minimum(lo[j, node], np.minimum.reduceat(values, starts))
                hi[j, node] = np.maximum(hi[j, node], np.maximum.reduceat(values, starts))
        lo, hi = lo.T.ravel(), hi.T.ravel()
        seen = np.flatnonzero(np.isfinite(lo))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (seen, lo[seen], hi[seen])], ["slot", "lo", "hi"])

    out = rows.mapInArrow(task, "slot long, lo double, hi double").groupBy("slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    table = out.toPandas()  # two numbers for each candidate of an open node
    lo, hi = np.full(candidates.size, np.inf), np.full(candidates.size, -np.inf)
    lo[table["slot"]], hi[table["slot"]] = table["lo"], table["hi"]
    return lo.reshape(-1, width), hi.reshape(-1, width)


def _counts(rows: DataFrame, model: ExtraTrees, trees: range, open_nodes: np.ndarray, candidates: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """(rows, positives) to the left of each threshold and, in the last place, of each node in all."""
    place = _places(model, open_nodes)
    shape = (len(open_nodes), candidates.shape[1] + 1, 2)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape, dtype=np.int64)
        for x, y, row, p in _met(batches, model, trees, place):
            flat, n = x.ravel(), x.shape[1]
            code = p * 4 + y.take(row)
            for j in range(shape[1] - 1):
                left = flat.take(candidates[:, j].take(p) * n + row) <= thresholds[:, j].take(p)
                cells = np.bincount(code + 2 * left, minlength=4 * shape[0]).reshape(-1, 2, 2)  # node, left, class
                sums[:, j, 0] += cells[:, 1].sum(axis=1)
                sums[:, j, 1] += cells[:, 1, 1]
            sums[:, -1, 0] += cells.sum(axis=(1, 2))
            sums[:, -1, 1] += cells[:, :, 1].sum(axis=1)
        flat = sums.reshape(-1, 2)
        seen = np.flatnonzero(flat[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (seen, flat[seen, 0], flat[seen, 1])], ["slot", "n", "pos"])

    table = rows.mapInArrow(task, "slot long, n long, pos long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toPandas()
    sums = np.zeros((shape[0] * shape[1], 2), dtype=np.int64)
    sums[table["slot"], 0], sums[table["slot"], 1] = table["n"], table["pos"]
    return sums.reshape(shape)


def impurity(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, 2 * pos * (n - pos) / np.maximum(n, 1), 0.0)


def choose(counts: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the candidate with the least impurity after its split (the first of equal ones), and whether it lowers impurity."""
    n, pos = counts[:, :-1, 0], counts[:, :-1, 1]
    total, positives = counts[:, -1:, 0], counts[:, -1:, 1]
    after = np.where(usable & (n > 0) & (n < total), impurity(n, pos) + impurity(total - n, positives - pos), np.inf)
    best = after.argmin(axis=1)
    least = after[np.arange(len(after)), best]
    return best, np.isfinite(least) & (impurity(total, positives)[:, 0] > 0)


def train(df: DataFrame, columns: Sequence[str], label: str, n_trees: int = 300, depth: int = 12, least_rows: int = 2, seed: int = SEED) -> ExtraTrees:
    """Trees of at most the given depth over aligned features (missing ones count as 0); rows without a label are left out.

    A node is split on one of sqrt(features) features that differ within it, of up to twice as many drawn; it stays a leaf where
    all that were drawn are constant, one class is left, or fewer than ``least_rows`` rows. Needs rows of both classes.
    """
    labelled = align(df.where(F.col(f"`{label}`").isNotNull()), columns, [label])
    rows = labelled.select(F.col(f"`{label}`").cast("int").alias("y"), *(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(columns)))
    shared_folder(df.sparkSession)
    packed = blocks.pack(rows, lambda batch: [np.stack(batch[1:]), batch[0].astype(np.int8)], BLOCK).checkpoint()  # features are computed once, not in each pass
    if rows.select(F.countDistinct("y")).first()[0] != 2:
        raise ValueError("training needs rows of both classes")
    width = len(columns)
    k = max(1, math.isqrt(width))
    model = ExtraTrees(list(columns), n_trees, np.full(n_trees, -1), np.zeros(n_trees), np.zeros(n_trees, dtype=np.int64), np.zeros(n_trees))
    for first in range(0, n_trees, TREES_A_PASS):
        trees = range(first, min(n_trees, first + TREES_A_PASS))
        open_nodes = np.arange(trees.start, trees.stop)
        for level in range(depth + 1):
            drawn = [_drawn(seed, int(node), width, k) for node in open_nodes]
            candidates, places = np.stack([f for f, _ in drawn]), np.stack([p for _, p in drawn])
            lo, hi = _ranges(packed, model, trees, open_nodes, candidates)
            differs = hi > lo
            usable = differs & (np.cumsum(differs, axis=1) <= k)
            with np.errstate(invalid="ignore"):
                thresholds = np.where(usable, np.minimum(lo + places * (hi - lo), np.nextafter(hi, -np.inf)), 0.0)
            counts = _counts(packed, model, trees, open_nodes, candidates, thresholds)
            total, positives = counts[:, -1, 0], counts[:, -1, 1]
            model.value[open_nodes] = positives / np.maximum(total, 1)
            best, splits = choose(counts, usable)
            splits &= (total >= least_rows) & (level < depth)
            parents, chosen = open_nodes[splits], best[splits]
            if not len(parents):
                break
            begin = len(model.feature)
            children = begin + np.arange(2 * len(parents))
            model.feature[parents], model.threshold[parents] = candidates[splits, chosen], thresholds[splits, chosen]
            model.left[parents] = children[::2]
            model.feature = np.concatenate([model.feature, np.full(len(children), -1)])
            model.threshold, model.value = (np.concatenate([a, np.zeros(len(children))]) for a in (model.threshold, model.value))
            model.left = np.concatenate([model.left, np.zeros(len(children), dtype=np.int64)])
            open_nodes = children
    return model


def predict(df: DataFrame, model: ExtraTrees, keep: Sequence[str], name: str = "probability") -> DataFrame:
    """``keep`` and the mean over trees of the share of positives in a row's leaf."""

    @F.pandas_udf("double")
    def probability(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.probability(x.to_numpy()) if len(x) else np.zeros(0))

    rows = align(df, model.columns, keep)
    return rows.select(*(F.col(f"`{k}`") for k in keep), probability(F.struct(*(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(model.columns)))).alias(name))


def save(model: ExtraTrees, path: str) -> None:
    """The nodes as a table and, beside it, the feature columns in order."""
    spark = SparkSession.active()
    nodes = pd.DataFrame({"node": np.arange(len(model.feature)), "feature": model.feature, "threshold": model.threshold, "left": model.left, "value": model.value})
    spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(model.n_trees, model.columns)], "n_trees int, columns array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/columns")


def load(path: str) -> ExtraTrees:
    spark = SparkSession.active()
    nodes, head = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node"), spark.read.json(f"{path}/columns").first()
    return ExtraTrees(list(head["columns"]), int(head["n_trees"]), *(nodes[c].to_numpy() for c in ("feature", "threshold", "left", "value")))
