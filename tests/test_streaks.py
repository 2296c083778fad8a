"""Failure streaks of one long log, cut into segments, against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from harrier.sources import feeds


def stop_of(rows, n):
    streak = 0
    for seq, ok in rows:
        streak = streak if ok is None else 0 if ok else streak + 1
        if ok is False and streak >= n:
            return seq
    return None


@pytest.mark.parametrize(("share", "n", "segments"), [(0.5, 9, 64), (0.9, 40, 64), (1.0, 150, 64), (1.0, 500, 7), (0.0, 1, 64), (0.3, 2, 1)])
def test_stop_equals_a_loop(spark, share, n, segments):
    random.seed(n)
    rows = [(i * 3, None if random.random() < 0.02 else random.random() >= share) for i in range(400)]
    log = spark.createDataFrame(random.sample(rows, len(rows)), "seq long, fine boolean")
    assert feeds.first_streak(log, F.col("fine"), n, segments=segments).first()[0] == stop_of(rows, n)


def test_empty_logs_and_kept_rows(spark):
    log = spark.createDataFrame([(i, i % 10 < 5, "x") for i in range(100)], "seq long, fine boolean, __n string")
    kept = feeds.until_failures(log, F.col("fine"), 3)
    assert kept.columns == log.columns and sorted(r.seq for r in kept.collect()) == list(range(8))
    assert feeds.until_failures(log.limit(0), F.col("fine"), 3).count() == 0
    assert feeds.until_failures(log, F.col("fine"), 6).count() == 100
