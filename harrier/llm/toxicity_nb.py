"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

N-grams are taken of the text's letters, lower-cased, with one blank for every run of other characters: those of
``LENGTHS`` characters that have blanks at their ends only, and every whole word with its two blanks. A document's
features are which n-grams it has. Each is scaled by r = log of the smoothed share of toxic learning documents
that have it over that of the others, and weighted by a logistic regression on the scaled features.

The model is fitted on a bounded sample: at most ``LEARN_ROWS`` documents of each class, those with the smallest
hashes of their ids. The intercept is then set so that a probability of 0.5 parts the classes best (by F1, each class
weighing what it does among all rows that may be learned from), as scored by models that haven't seen the row (``FOLDS``).
Tasks count n-grams and Spark sums them; the ``FEATURES`` n-grams that tell the classes apart best are kept. With
no rows of one class, scores are the share of label 1 (0.5 without any). Null and empty texts have no n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.arrowtext import mix64, prefix_hash, row_blocks, span_hash, text_buffers
from harrier.llm.sampling import sampled_rows

LEARN_ROWS = 3_000
FEATURES = 6_000
LENGTHS = (4, 5, 6, 7)
SMOOTHING = 0.5
L2 = 2e-3
ROUNDS = 400
FOLDS = 3
_BITS = 22
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    if not _FOLD:
        fold = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                y = x.lower()
                fold[c] = ord(y) if len(y) == 1 else c
        _FOLD.append(fold)
    return _FOLD[0]


def gram_blocks(column: pa.Array) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, row after the last, (hash, row of the block) arrays for each kind of n-gram) of a text column."""
    fold = _fold()
    _, offsets = text_buffers(column)
    for row, stop in row_blocks(offsets):
        texts = [t or "" for t in column.slice(row, stop - row).to_pylist()]
        ends = np.cumsum([len(t) + 2 for t in texts])  # a blank before and after each
        codes = fold[np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le", "replace"), dtype=np.uint32)]
        blank = codes == 32
        use = np.ones(len(codes), dtype=bool)
        use[1:] = ~(blank[1:] & blank[:-1])
        use[ends[:-1]] = True
        owner = np.repeat(np.arange(stop - row), np.diff(np.r_[0, ends]))[use]
        codes, blank = codes[use], blank[use]
        yield row, stop, _grams(codes, blank, owner)


def _grams(codes: np.ndarray, blank: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    prefix = prefix_hash(mix64(codes.astype(np.uint64)))
    blanks = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    for n in LENGTHS:
        if len(codes) < n:
            continue
        start = np.flatnonzero(blanks[n - 1 : -1] == blanks[1 : len(codes) - n + 2])  # no blank strictly inside
        yield span_hash(prefix, start, start + n), owner[start]
    at = np.flatnonzero(blank)
    size = np.diff(at)
    whole = np.flatnonzero(size > 1)
    yield span_hash(prefix, at[whole], at[whole + 1] + 1) ^ np.uint64(1 << 40), owner[at[whole]]


def documents_having(grams: Iterator[tuple[np.ndarray, np.ndarray]], known: "Features | None" = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, or (row, feature number) pairs of known n-grams."""
    rows, found = [], []
    for hashes, owner in grams:
        if known is not None:
            hashes, owner = known.look_up(hashes, owner)
        rows.append(owner)
        found.append(hashes)
    row, value = np.concatenate([np.zeros(0, dtype=np.int64), *rows]), np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


class Features:
    """Known n-grams, found by a table of bits and then by binary search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.hashes >> np.uint64(64 - _BITS)] = True

    def look_up(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(64 - _BITS)])
        if not len(self.hashes) or not len(maybe):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        hashes = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        right = self.hashes[at] == hashes
        return at[right], owner[maybe[right]]


@dataclass
class Model:
    bias: float
    features: Features | None = None
    weight: np.ndarray | None = None

    def score(self, n: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(n, self.bias)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, self.weight[feature], n))))


def _regression(n: int, row: np.ndarray, feature: np.ndarray, ratio: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept, by accelerated gradient descent on the mean logistic loss."""
    x = ratio[feature]
    weight, bias, old_w, old_b = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    bound = 0.25 * max(1.0, float(np.bincount(row, x * x, n).mean()) + 1) + L2
    for t in range(1, ROUNDS + 1):
        ahead_w, ahead_b = weight + (t - 1) / (t + 2) * (weight - old_w), bias + (t - 1) / (t + 2) * (bias - old_b)
        slope = (1 / (1 + np.exp(-(ahead_b + np.bincount(row, ahead_w[feature] * x, n)))) - label) / n
        grad = np.bincount(feature, slope[row] * x, len(ratio)) + L2 * ahead_w
        old_w, old_b = weight, bias
        weight, bias = ahead_w - grad / bound, ahead_b - slope.sum() / bound
    return weight * ratio, bias


def best_cut(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The margin that parts the classes with the best F1: halfway between the rows on both sides; of ties the middle one."""
    order = np.argsort(-margin, kind="stable")
    m, y, w = margin[order], label[order], weight[order]
    tp, fp = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * tp / (tp + fp + (w * y).sum())
    f1[:-1][m[:-1] == m[1:]] = -1  # rows of one margin go together
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(best[len(best) // 2])
    return float((m[k] + m[min(k + 1, len(m) - 1)]) / 2)


def learn(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = LEARN_ROWS, size: int = FEATURES) -> Model:
    """Fits on at most ``limit`` rows of each class of ``labelled`` (key and label 0 or 1, one row a key)."""
    labelled = labelled.select(F.col(key), F.col(label).cast("int").alias("__label")).where("__label IN (0, 1)")
    totals = {r["__label"]: r["count"] for r in labelled.groupBy("__label").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Model(bias=n1 / (n0 + n1) if n0 + n1 else 0.5)
    both = [labelled.where(F.col("__label") == k).orderBy(F.xxhash64(key), key).limit(limit) for k in (0, 1)]
    rows = sampled_rows(docs, both[0].unionByName(both[1]), key, 2 * limit, F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for row, _, grams in gram_blocks(batch.column(1)):
                owner, hashes = documents_having(grams)
                own, place = np.unique(hashes, return_inverse=True)
                ones = np.bincount(place, toxic[row + owner], len(own)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(ones), pa.array(np.bincount(place, minlength=len(own)).astype(np.int32) - ones)], names=["gram", "n1", "n0"])

    sums = rows.select("__label", "__text").mapInArrow(count, "gram long, n1 int, n0 int").groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    m1, m0 = min(n1, limit), min(n0, limit)
    share1, share0 = (F.col("n1") + SMOOTHING) / (m1 + 2 * SMOOTHING), (F.col("n0") + SMOOTHING) / (m0 + 2 * SMOOTHING)
    mean = (F.col("n1") + F.col("n0") + 2 * SMOOTHING) / (m1 + m0 + 4 * SMOOTHING)
    gain = (F.col("n1") * F.log(share1 / mean) + F.col("n0") * F.log(share0 / mean)).alias("gain")
    best = sums.where("n1 + n0 >= 3").select("gram", F.log(share1 / share0).alias("ratio"), gain).orderBy(F.desc("gain"), "gram").limit(size).toPandas()
    if not len(best):
        return Model(bias=n1 / (n0 + n1))
    best["gram"] = best["gram"].to_numpy().view(np.uint64)
    best = best.sort_values("gram")
    known = docs.sparkSession.sparkContext.broadcast(Features(best["gram"].to_numpy()))

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, grams in gram_blocks(batch.column(2)):
                owner, feature = documents_having(grams, known.value)
                first = np.searchsorted(owner, np.arange(stop - row + 1))
                lists = pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(first, first[1:], strict=False)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), batch.column(1).slice(row, stop - row), lists], names=["key", "label", "features"])

    found = rows.select(F.xxhash64(key).alias("key"), "__label", "__text").mapInArrow(having, "key long, label int, features binary").toPandas()
    found = found.sort_values(["key", "features"], kind="stable")
    lists = [np.frombuffer(x, dtype=np.int32) for x in found["features"]]
    label_of = found["label"].to_numpy(dtype=float)
    ratio, row = best["ratio"].to_numpy(), np.repeat(np.arange(len(found)), [len(x) for x in lists])
    feature, fold, margin = np.concatenate(lists), np.arange(len(found)) % FOLDS, np.zeros(len(found))
    # folds are dealt within each class
    for k in (0, 1):
        fold[label_of == k] = np.arange(int((label_of == k).sum())) % FOLDS
    for k in range(FOLDS):
        seen = fold != k
        number = np.cumsum(seen) - 1
        own = seen[row]
        weight, bias = _regression(int(seen.sum()), number[row[own]], feature[own], ratio, label_of[seen])
        margin[~seen] = (bias + np.bincount(row, weight[feature], len(found)))[~seen]
    share = np.where(label_of == 1, n1 / max(label_of.sum(), 1), n0 / max((1 - label_of).sum(), 1))
    weight, bias = _regression(len(found), row, feature, ratio, label_of)
    return Model(float(bias - best_cut(margin, label_of, share)), known.value, weight)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``score``, the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, grams in gram_blocks(batch.column(len(keep))):
                owner, feature = documents_having(grams, shared.value.features or Features(np.zeros(0, dtype=np.uint64)))
                scores = shared.value.score(stop - row, owner, feature.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, stop - row) for k in range(len(keep))), pa.array(scores)], names=[*keep, "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
