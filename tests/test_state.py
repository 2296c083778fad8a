"""The keyed table under a stream, and guarded stages with observed counters."""

import datetime
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrier.plans import guarded
from harrier.sources import store
from harrier.streaming import incremental
from harrier.streaming.keyed_table import KeyedTable

SCHEMA = "url string, ts timestamp, seq long, label string, source string"


def events(spark, *rows):
    at = lambda d: datetime.datetime(2024, 1, d)
    return spark.createDataFrame([(u, at(d), s, label, "") for u, d, s, label in rows], SCHEMA)


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=8, keep=2)
    with pytest.raises(ValueError):
        table.read()
    first = events(spark, *((f"u{i}", 1, i, "phish") for i in range(60)), (None, 1, 99, "phish"))
    assert table.apply(first, 0) == list(range(8))
    before = files(f"{tmp_path}/t/data")
    change = events(spark, ("u7", 2, 100, "benign"), ("u7", 3, 101, ""), ("u7", 3, 101, ""))
    assert len(table.apply(change, 1)) == 1
    after = files(f"{tmp_path}/t/data")
    assert len(after) == len(before) + 1 and all(after[f] == m for f, m in before.items())
    got = {r.url: r for r in table.read().collect()}
    assert len(got) == 60 and (got["u7"].label, got["u7"].created_at.day, got["u7"].updated_at.day) == ("benign", 1, 3)
    # the same batch again, and an empty one
    assert table.apply(change, 1) == [] and files(f"{tmp_path}/t/data") == after
    assert table.apply(change.limit(0), 2) == [] and table.read().count() == 60
    # what no kept manifest names is gone
    assert table.versions() == [1, 2] and {r.label for r in table.read(1).where("url = 'u7'").collect()} == {"benign"}
    table.apply(events(spark, ("u7", 4, 102, "phish")), 3)
    table.apply(events(spark, ("u7", 5, 103, "benign")), 4)
    assert table.versions() == [3, 4] and len(files(f"{tmp_path}/t/data")) == 9  # eight live, one of the version before


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    def broken(old, new, key):
        raise RuntimeError("merge")

    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    table.apply(events(spark, ("a", 1, 1, "phish")), 0)
    failing = KeyedTable(spark, str(tmp_path / "t"), buckets=4, merge=broken)
    with pytest.raises(RuntimeError):
        failing.apply(events(spark, ("a", 2, 2, "benign")), 1)
    assert [r.label for r in table.read().collect()] == ["phish"]
    table.apply(events(spark, ("a", 2, 2, "benign")), 1)
    assert [r.label for r in table.read().collect()] == ["benign"]


def test_stream_into_the_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    batches = [
        [("a", 1, 1, "phish"), ("b", 1, 2, "benign"), ("a", 1, 1, "phish")],
        [("a", 5, 3, "benign"), ("b", 1, 2, "benign")],
        [("c", 1, 4, "phish"), ("a", 6, 5, "")],  # c is later than the watermark allows
    ]
    def run():
        stream = incremental.landed(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
        table.ingest(stream, str(tmp_path / "cp"), late="1 day").awaitTermination()

    for rows in batches:  # one run each, as an arrival
        events(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    want = [r for rows in batches for r in rows if r[0] != "c"]
    want = {tuple(r) for r in store.upsert_urls(events(spark, *want)).collect()}
    assert {tuple(r) for r in table.read().collect()} == want
    versions = table.versions()
    run()
    assert table.versions()[-1] >= versions[-1] and {tuple(r) for r in table.read().collect()} == want


def scores():
    """Closures, since workers don't import the tests."""

    def thirds(rows: pd.DataFrame) -> pd.Series:
        if (rows["x"] % 3 == 0).any():
            raise ValueError("a third")
        return rows["x"] / 2

    def short(rows: pd.DataFrame) -> pd.Series:
        return rows["x"][:-1]

    return thirds, short


def test_guarded_stages(spark, tmp_path):
    thirds, short = scores()
    df = spark.createDataFrame([(i, "clash") for i in range(10)] + [(None, "null")], "x long, value string")
    done = guarded.guarded_stages(df, {"half": (thirds, ["x"]), "short": (short, ["x"])})
    totals = guarded.save_counted(done, str(tmp_path / "out"), ["half", "short"])
    assert totals == {"attempts": 11, "stored": 0, "half_ok": 7, "short_ok": 0}
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    for r in rows:
        if r.x is None:
            assert r.half is None and r.half_error is None
        else:
            assert (r.half, r.half_error) == ((None, "ValueError: a third") if r.x % 3 == 0 else (r.x / 2, None))
        assert r.short_error == "ValueError: 0 values for 1 rows" and r.value in ("clash", "null")
    assert guarded.save_counted(guarded.guarded(df.limit(0), "half", thirds, ["x"]), str(tmp_path / "none"), ["half"]) == {"attempts": 0, "stored": 0, "half_ok": 0}


def test_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(rows: pd.DataFrame) -> pd.Series:
        seen.add(len(rows))
        return rows["x"]

    df = spark.range(100).select(F.col("id").alias("x"))
    assert guarded.save_counted(guarded.guarded(df, "s", count, ["x"], "long"), str(tmp_path / "out"), ["s"])["stored"] == 100
    assert seen.value == 100
