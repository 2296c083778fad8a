"""Exact quantiles against numpy, with brackets narrowed several times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrier.plans import quantiles as Q

WANTED = {"low": 0.01, "mid": 0.5, "high": 0.95, "all": 1.0}


def groups():
    rng = np.random.default_rng(3)
    yield "even", rng.random(7000)
    yield "heavy tail", np.exp(rng.normal(0, 12, 5000))
    yield "ties", np.concatenate([np.full(4000, 5.0), rng.random(3000) * 10, np.full(1500, -1.0)])
    yield "few", np.array([3.0, 1.0])
    yield "one", np.array([2.5])
    yield "signs", np.concatenate([rng.normal(0, 1e-300, 400), rng.normal(0, 1e300, 400), [0.0, -0.0]])
    yield None, rng.integers(0, 3, 3000).astype(float)


@pytest.mark.parametrize("few", [5, 10_000])
def test_quantiles_of_groups(spark, few):
    want = {k: v for k, v in groups()}
    rows = [(k, float(x)) for k, v in want.items() for x in v] + [("even", None), ("even", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in Q.quantiles(df, ["g"], "x", WANTED, few=few).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        for name, q in WANTED.items():
            assert got[k][name] == pytest.approx(np.quantile(v, q), rel=1e-12), (k, name)


def test_without_keys_and_without_rows(spark):
    df = spark.range(1, 20_001).select(F.col("id").cast("double").alias("x"))
    assert Q.quantiles(df, [], "x", {"m": 0.5}, few=10).collect() == [(10_000.5,)]
    assert Q.quantiles(df.where("x < 0").withColumn("g", F.lit(1)), ["g"], "x", {"m": 0.5}).collect() == []


def test_ties_round_as_in_sql(spark):
    """0.95 of (301.42, 304.08) at 0.75 is 303.415 in SQL, which a sum of rounded products misses; 1.005 is less than its text."""
    import duckdb

    from harrier.plans.metrics import latency_summary

    rng = np.random.default_rng(1)
    groups = {g: np.round(rng.exponential(50, rng.integers(2, 60)), 2) * 2 for g in range(1500)} | {-1: np.array([1.005]), -2: np.array([301.42] * 5 + [304.08]), -3: np.array([-1.5, 2.25])}
    df = spark.createDataFrame([(g, "ok", float(x)) for g, v in groups.items() for x in v], "g long, outcome string, ms double")
    got = {r.g: (r.median_ms, r.p95_ms, r.min_ms, r.max_ms) for r in latency_summary(df, ["g"], ["ms"]).collect()}
    t = df.toPandas()  # noqa: F841
    want = duckdb.sql("SELECT g, round(quantile_cont(ms, 0.5), 2), round(quantile_cont(ms, 0.95), 2), round(min(ms), 2), round(max(ms), 2) FROM t GROUP BY g").fetchall()
    assert got == {g: tuple(rest) for g, *rest in want}
