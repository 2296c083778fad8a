"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is the logistic function of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

the sum-of-squares identity for all pairwise interactions <v_i, v_j> x_i x_j, in time linear in the features.
Words (split at white space, lower-cased) are hashed to ``WORD_BUCKETS``; each document's weigh 1/sqrt(distinct
words). Structure statistics (shares of byte classes, word lengths, repetition) and the metadata column of lengths
are cut at quantiles of the learning sample, one indicator for each cut interval.

Learning takes at most ``LEARN_ROWS`` labelled documents, those whose ids have the smallest hashes, so the model
doesn't depend on how rows are partitioned. Without rows of both classes every score is the share of label 1
among the learning rows (0.5 without any). Null and empty texts have no words and are scored by their statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.arrowtext import NOT_SPACE, byte_table, text_buffers, with_text, word_blocks
from harrier.llm.sampling import sampled_rows

#: Labelled documents that the model is fitted on.
LEARN_ROWS = 12_000
WORD_BUCKETS = 1 << 13
FACTORS = 8
BINS = 10
EPOCHS = 6
#: Small samples are gone over more often, up to so many batches.
LEAST_BATCHES = 1_200
STEP = 0.15
BATCH = 128
L2 = 1e-5

_CLASSES = [
    byte_table(bytes(range(65, 91))),
    byte_table(bytes(range(97, 123))),
    byte_table(bytes(range(48, 58))),
    byte_table(b" \t\x0b\x0c\r"),
    byte_table(b"\n"),
    byte_table(b".,;:'\"-()?"),
    byte_table(b"!#$%&*+/<=>@[\\]^_`{|}~"),
    byte_table(bytes(range(128, 256))),
]
N_STATS = len(_CLASSES) + 6


@dataclass
class Rows:
    """Features of documents: words as CSR (``first``, ``bucket``) and a matrix of statistics."""

    first: np.ndarray
    bucket: np.ndarray
    stats: np.ndarray


def features(column: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[int, int, Rows]]:
    """The features of each block of rows; n_chars: the metadata length, NaN where it is missing."""
    data, offsets = text_buffers(column)
    for row, stop, words in word_blocks(column, NOT_SPACE):
        at = offsets[row : stop + 1] - offsets[row]
        block = data[offsets[row] : offsets[stop]]
        n, size = stop - row, np.diff(at)
        stats = np.zeros((n, N_STATS))
        for k, table in enumerate(_CLASSES):
            total = np.concatenate([[0], np.cumsum(table[block], dtype=np.int64)])
            stats[:, k] = np.diff(total[at]) / np.maximum(size, 1)
        count = np.diff(words.first)
        doc = np.repeat(np.arange(n, dtype=np.uint64), count)
        keys, times = np.unique((doc << np.uint64(48)) | (words.hashes >> np.uint64(16)), return_counts=True)
        owner = (keys >> np.uint64(48)).astype(np.int64)
        first = np.searchsorted(owner, np.arange(n + 1))
        distinct = np.diff(first)
        most = np.zeros(n)
        np.maximum.at(most, owner, times)
        k = len(_CLASSES)
        stats[:, k] = np.log1p(count)
        stats[:, k + 1] = size / np.maximum(count, 1)
        stats[:, k + 2] = distinct / np.maximum(count, 1)
        stats[:, k + 3] = most / np.maximum(count, 1)
        stats[:, k + 4] = np.log1p(distinct)
        stats[:, k + 5] = np.log1p(np.where(np.isnan(n_chars[row:stop]), size, np.maximum(n_chars[row:stop], 0)))
        yield row, stop, Rows(first, (keys & np.uint64(WORD_BUCKETS - 1)).astype(np.int32), stats)


@dataclass
class Model:
    """bias, weights and factors over word buckets followed by ``BINS`` indicators for each statistic."""

    bias: float
    weight: np.ndarray | None = None
    factor: np.ndarray | None = None
    cuts: np.ndarray | None = None

    def design(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CSR arrays (row begins, feature, value) of words and indicators together."""
        n, words = len(rows.stats), np.diff(rows.first)
        bins = np.stack([np.searchsorted(self.cuts[k], rows.stats[:, k], side="right") for k in range(N_STATS)], axis=1)
        bins += WORD_BUCKETS + np.arange(N_STATS) * BINS
        first = rows.first + np.arange(n + 1) * N_STATS
        feature = np.empty(first[-1], dtype=np.int32)
        value = np.empty(first[-1])
        of_stats = (first[:-1, None] + np.arange(N_STATS)).ravel()
        is_word = np.ones(len(feature), dtype=bool)
        is_word[of_stats] = False
        feature[of_stats], value[of_stats] = bins.ravel(), 1 / np.sqrt(N_STATS)
        feature[is_word], value[is_word] = rows.bucket, np.repeat(1 / np.sqrt(np.maximum(words, 1)), words)
        return first, feature, value

    def margin(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and the factor sums of each row."""
        vx = self.factor[feature] * value[:, None]
        sums = np.add.reduceat(vx, first[:-1], axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), first[:-1])
        linear = np.add.reduceat(self.weight[feature] * value, first[:-1])
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, rows: Rows) -> np.ndarray:
        if self.weight is None:
            return np.full(len(rows.stats), self.bias)
        return 1 / (1 + np.exp(-self.margin(*self.design(rows))[0]))


def fit(rows: Rows, label: np.ndarray, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss, in batches of a fixed order."""
    if len(label) == 0 or label.min() == label.max():
        return Model(bias=float(label.mean()) if len(label) else 0.5)
    rng = np.random.default_rng(seed)
    size = WORD_BUCKETS + N_STATS * BINS
    cuts = np.quantile(rows.stats, np.arange(1, BINS) / BINS, axis=0).T
    share = label.mean()
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), cuts)
    first, feature, value = model.design(rows)
    seen_w, seen_v = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    for _ in range(max(EPOCHS, -(-LEAST_BATCHES * BATCH // len(label)))):
        order = rng.permutation(len(label))
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            begin = np.concatenate([[0], np.cumsum(first[batch + 1] - first[batch])])
            f, x = feature[at], value[at]
            margin, sums = model.margin(begin, f, x)
            slope = (1 / (1 + np.exp(-margin)) - label[batch]) / len(batch)
            each = np.repeat(slope, np.diff(begin)) * x
            own, place = np.unique(f, return_inverse=True)
            grad_w = np.bincount(place, each, len(own)) + L2 * model.weight[own]
            v = model.factor[f]
            dv = each[:, None] * (np.repeat(sums, np.diff(begin), axis=0) - v * x[:, None])
            grad_v = np.stack([np.bincount(place, dv[:, k], len(own)) for k in range(FACTORS)], axis=1) + L2 * model.factor[own]
            seen_w[own] += grad_w**2
            seen_v[own] += grad_v**2
            model.weight[own] -= STEP * grad_w / np.sqrt(seen_w[own])
            model.factor[own] -= STEP * grad_v / np.sqrt(seen_v[own])
            model.bias -= STEP * slope.sum() * 0.5
    return model


def learn(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", label: str = "quality", limit: int = LEARN_ROWS) -> Model:
    """Fits on at most ``limit`` rows of ``labelled`` (key and label 0 or 1, one row a key).

    Tasks turn the texts into features; the driver gets those of the ``limit`` sampled rows and no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for row, stop, rows in features(batch.column(2), lengths):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), batch.column(1).slice(row, stop - row), pa.array([rows.bucket[a:b].tobytes() for a, b in zip(rows.first, rows.first[1:], strict=False)], type=pa.binary()), pa.array([s.tobytes() for s in rows.stats], type=pa.binary())],
                    names=["key", "label", "words", "stats"],
                )

    chosen = labelled.select(F.col(key), F.col(label).cast("double").alias("__label")).where("__label IS NOT NULL")
    sample = sampled_rows(docs, chosen, key, limit, F.col(text).alias("__text"), F.col(n_chars).cast("long").alias("__n_chars"))
    sample = sample.select(F.xxhash64(key).alias("key"), "__label", "__text", "__n_chars")
    found = sample.mapInArrow(run, "key long, label double, words binary, stats binary").toPandas()
    found = found.sort_values(["key", "stats", "words"], kind="stable")
    words = [np.frombuffer(x, dtype=np.int32) for x in found["words"]]
    first = np.concatenate([[0], np.cumsum([len(x) for x in words], dtype=np.int64)]).astype(np.int64)
    stats = np.stack([np.frombuffer(x) for x in found["stats"]]) if len(found) else np.zeros((0, N_STATS))
    return fit(Rows(first, np.concatenate([np.zeros(0, dtype=np.int32), *words]), stats), found["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``score``, the probability of label 1. The model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    rows, place = with_text(docs, keep, text, F.col(n_chars).cast("long").alias("__n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(batch.num_columns - 1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for row, stop, rows in features(batch.column(place), lengths):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, stop - row) for k in range(len(keep))), pa.array(shared.value.score(rows))], names=[*keep, "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
