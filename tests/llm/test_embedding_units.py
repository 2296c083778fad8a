"""Embedding near-dedup: isolated pairs, and units of a dense group."""

import numpy as np
from pyspark.sql import functions as F

from harrier.llm import embedding_dedup


def test_embedding_pairs_that_stand_alone_are_found(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "GROUP", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 48))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    for i in range(0, 240, 2):  # 120 pairs of cosine 0.932 among 6,000 vectors
        off = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = 0.932 * x[i] + np.sqrt(1 - 0.932**2) * off / np.sqrt(off @ off)
    table = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).where("n_links > 0").collect()}
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert {i: n for i, (n, _) in got.items()} == {i: int(n) for i, n in enumerate(want) if n}
    assert all(got[i + 1][1] == i for i in range(0, 240, 2))


def test_embedding_units_stay_small_in_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rows = spark.range(400).select("id", F.lit(0).cast("long").alias("family"), F.col("id").alias("centre"), F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("salt"))
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    units, _ = embedding_dedup.met(rows, pairs, ["family"], rows.select("id", "centre"))
    sides = units.groupBy("unit", "side").count().collect()
    assert max(r["count"] for r in sides) <= 64 and len({r.unit for r in sides}) == 13 * 14 // 2
