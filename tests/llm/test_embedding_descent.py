"""Embedding near-dedup: rounds of descent find links that the start in buckets lacks."""

import numpy as np
from pyspark.sql import functions as F

from harrier.llm import embedding_dedup


def test_descent_finds_links_that_the_start_lacks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "GROUP", 8)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 24))
    x[1000:] = x[:1000] + rng.normal(size=(1000, 24)) * 0.27  # each row has a near copy
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True)}
    vectors = spark.createDataFrame([(i, i, None, 0, "1", v.tobytes()) for i, v in enumerate(x)], "id long, centre long, owner long, salt long, label string, vector binary").cache()
    codes = embedding_dedup.bucketed(vectors, 0.93, 0.2)
    units, _ = embedding_dedup.met(codes, None, ["label", "code"], vectors.select("id", "centre", "vector"))
    units = units.cache()
    links = lambda lists: {(min(r.a, r.b), max(r.a, r.b)) for r in lists.where(F.col("cosine") >= 0.93).collect()}
    start, after = links(embedding_dedup.started(units, 0.93)), links(embedding_dedup.neighbour_lists(units, vectors.select("id", "vector"), 0.93))
    print(len(want), len(start), len(after))
    assert start <= after <= want
    assert len(want - start) > 20 and len(want - after) <= 0.1 * len(want - start)
