"""Queries that do the whole job where a query with SQL works on a part, against brute force."""

import numpy as np

from harrier.plans import models
from harrier.queries import policy


def test_nearest_vectors_of_every_fiftieth_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1600, 8)).astype(np.float32)
    x[300:340] = x[100]  # ties, of which the smallest ids count
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    odd = [(2000, None, 0), (2001, [1.0, 2.0], 0), (2002, [float("nan")] * 8, 0)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in policy.QUERIES["nearest_vectors_full"](spark, str(tmp_path)).collect()}
    want = {}
    for q in range(0, 1600, 50):
        distance = ((x[q].astype(float) - x.astype(float)) ** 2).sum(axis=1)
        distance[q] = np.inf
        want |= {(q, r + 1): int(i) for r, i in enumerate(np.lexsort((np.arange(1600), distance))[:5])}
    assert got == want and len({q for q, _ in got}) == 32
