"""Stages that fail row by row: an error column in place of a failed job, and counters taken while the rows are written.

A stage is a function from a pandas frame of its columns to a series of as many values. It is called once a batch; a batch
in which it raises is halved until the bad rows stand alone, so they cost some calls each and no other row its value. An error is the
exception's type and message. A value that is NaN is null. A stage that gives too few or too many values fails its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Score = Callable[[pd.DataFrame], pd.Series]
#: Characters of an error's text.
ERROR_CHARS = 500


def _called(score: Score, rows: pd.DataFrame) -> pd.Series:
    values = pd.Series(score(rows))
    if len(values) != len(rows):
        raise ValueError(f"{len(values)} values for {len(rows)} rows")
    return values.reset_index(drop=True)


def attempt(score: Score, rows: pd.DataFrame) -> pd.DataFrame:
    """value and error of each row."""
    values: list[object] = []
    errors: list[str | None] = []
    waiting = [rows.reset_index(drop=True)]
    while waiting:
        part = waiting.pop()
        try:
            values += _called(score, part).tolist()
            errors += [None] * len(part)
        except Exception as e:  # some row's fault: halves, down to the row
            if len(part) > 1:
                middle = len(part) // 2
                waiting += [part.iloc[middle:].reset_index(drop=True), part.iloc[:middle].reset_index(drop=True)]
            elif len(part):
                values.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:ERROR_CHARS])
    return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})


def guarded(df: DataFrame, name: str, score: Score, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """df with the stage's value as ``name`` and its error as ``name_error``; one of both is null."""

    @F.pandas_udf(f"value {kind}, error string")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return attempt(score, rows)

    out = df.withColumn("__out", run(F.struct(*(F.col(f"`{c}`") for c in columns))))
    return out.withColumns({name: F.col("__out.value"), f"{name}_error": F.col("__out.error")}).drop("__out")


def guarded_stages(df: DataFrame, stages: Mapping[str, tuple[Score, Sequence[str]]]) -> DataFrame:
    """All stages, each guarded for itself: a row that fails in one goes on to the others."""
    return reduce(lambda out, s: guarded(out, s[0], *s[1]), stages.items(), df)


def failed(stage: str) -> Column:
    return F.col(f"{stage}_error").isNotNull()


def save_counted(df: DataFrame, path: str, stages: Sequence[str], mode: str = "errorifexists") -> dict[str, int]:
    """Writes df as Parquet and returns attempts, stored (rows without any error) and ``<stage>_ok``, observed in the same pass."""
    seen = Observation()
    clean = ~reduce(lambda a, b: a | b, map(failed, stages))
    counts = [F.count(F.lit(1)).alias("attempts"), F.count_if(clean).alias("stored"), *(F.count_if(~failed(s)).alias(f"{s}_ok") for s in stages)]
    df.observe(seen, *counts).write.mode(mode).parquet(path)
    return dict(seen.get)
