"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (of 1 to 3 letters, a blank standing for word ends)
of a text or of a language. A document gets the language whose profile is nearest by out-of-place distance: the
sum, over the document's profile, of how far each n-gram's rank is from its rank in the language's profile, or the
profile size where the language lacks it. Frequencies of equal size rank in code point order, so results don't
depend on the order of rows.

A text that is null or has no letter gets ``und`` and score 0; so does every text if no profile could be learned.
Ties between languages go to the first in alphabetical order. Repeated rows are treated each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.llm.sampling import sampled_rows

PROFILE = 300
#: Documents of which the profiles are learned, over all languages.
LEARN_ROWS = 20_000
#: Distinct n-grams of a language and a task are sent on in pieces of a document group of this many characters.
GROUP_CHARS = 4_000_000


def _fold(limit: int = 0x110000) -> np.ndarray:
    """The code point that each code point counts as: lower-case letters as they are, all other characters a blank."""
    fold = np.full(limit, 32, dtype=np.uint64)
    for c in range(limit):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            fold[c] = ord(y) if len(y) == 1 else c
    return fold


_FOLD: list[np.ndarray] = []


def ngrams(text: str) -> np.ndarray:
    """The n-grams of a text as packed 21-bit code points; none if it has no letter."""
    if not _FOLD:
        _FOLD.append(_fold())
    codes = _FOLD[0][np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), dtype=np.uint32)]
    blank = codes == 32
    codes = codes[np.r_[True, ~(blank[1:] & blank[:-1])]]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.uint64)
    s = np.uint64(21)
    two = (codes[:-1] << s) | codes[1:]
    three = (two[:-1] << s) | codes[2:]
    return np.concatenate([codes[codes != 32], two, three])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    at = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, dtype=np.int64)
    return grams[at], np.diff(np.r_[at, len(grams)])


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, in order of rank."""
    if len(grams) > size:
        least = -np.partition(-counts, size - 1)[size - 1]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


def learn(docs: DataFrame, learnable: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = LEARN_ROWS, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language, from ``learnable`` (key and language, one row a key): at most ``limit`` of its documents.

    N-grams are counted in the tasks and summed by Spark; only the ``size`` first of each language come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pd.DataFrame({"lang": batch.column(1).to_pandas(), "text": batch.column(0).to_pandas()})
            for name, texts in rows.groupby("lang")["text"]:
                step = max(1, GROUP_CHARS // max(1, int(texts.str.len().mean())))
                for i in range(0, len(texts), step):
                    parts = [ngrams(t) for t in texts.iloc[i : i + step]]
                    grams, counts = counted(np.concatenate(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), type=pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    rows = sampled_rows(docs, learnable.select(key, F.col(lang).alias("__lang")), key, limit, text)
    grams = rows.where(F.col(text).isNotNull() & F.col("__lang").isNotNull()).select(text, "__lang").mapInArrow(run, "lang string, gram long, n long")
    totals = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = totals.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= size)
    best = first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("best"))
    return {r.lang: np.array([x.gram for x in r.best], dtype=np.int64).astype(np.uint64) for r in best.collect()}


class Classifier:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        self.sorted = []
        for name in self.names:
            order = np.argsort(profiles[name])
            self.sorted.append((profiles[name][order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text) if text else np.zeros(0, dtype=np.uint64)
        if not len(grams) or not self.names:
            return "und", 0.0
        profile = top(*counted(grams), self.size)
        rank, distances = np.arange(len(profile)), []
        for grams, ranks in self.sorted:
            at = np.minimum(np.searchsorted(grams, profile), max(len(grams) - 1, 0))
            distances.append(int(np.where(grams[at] == profile, np.abs(ranks[at] - rank), self.size).sum()) if len(grams) else self.size * len(profile))
        best = int(np.argmin(distances))
        return self.names[best], 1.0 - distances[best] / (self.size * len(profile))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """The columns in ``keep``, ``lang_pred`` and ``score`` (1: all ranks agree, 0: nothing in common)."""
    table = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(table.value, size)
        for batch in batches:
            column = batch.column(len(keep))
            found = [classifier.predict(x.as_py()) for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
