"""The cascade of stages as one projection: a stage decides when its probability leaves its deferral band.

Stages come in order as (name, probability column, margin). A null probability decides nothing and isn't aggregated.
A stage exits at p <= 0.5 - margin or p >= 0.5 + margin; the exit stage's verdict is positive at p >= 0.5. If none
exits, the probabilities are aggregated (max, mean or median) and the stage nearest to the aggregate is named.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE, UNKNOWN = "phish", "benign", "unknown"
AGGREGATIONS = ("max", "mean", "median")


@dataclass(frozen=True)
class Stage:
    name: str
    probability: str
    margin: float | None = None


@dataclass(frozen=True)
class Policy:
    """Stages in order, the margin of those without their own, and how probabilities are aggregated."""

    stages: Sequence[Stage]
    margin: float = 0.4
    aggregation: str = "mean"

    def __post_init__(self):
        for m in (self.margin, *(s.margin for s in self.stages if s.margin is not None)):
            if not 0 <= m <= 0.5:
                raise ValueError(f"a margin lies between 0 and 0.5, not at {m}")
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"aggregation is one of {AGGREGATIONS}, not {self.aggregation}")

    def margin_of(self, stage: Stage) -> float:
        return self.margin if stage.margin is None else stage.margin


def outside(p: Column, low: Column, high: Column) -> Column:
    """Whether a probability is at or beyond an end of its band."""
    return F.coalesce((p <= low) | (p >= high), F.lit(False))


def aggregate(present: Column, how: str) -> Column:
    """max, mean or median of an array of probabilities; null for none."""
    n = F.size(present)
    if how == "max":
        value = F.array_max(present)
    elif how == "mean":
        value = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / n
    else:
        ordered = F.array_sort(present)
        low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
        value = (low + high) / 2
    return F.when(n > 0, value)


def decide(df: DataFrame, policy: Policy) -> DataFrame:
    """df with decision, stage_id, probability, confidence, exited and n_ran (stages that were reached)."""
    each = F.array(
        *(
            F.struct(F.lit(i).alias("i"), F.lit(s.name).alias("name"), F.col(s.probability).alias("p"), F.lit(0.5 - policy.margin_of(s)).alias("low"), F.lit(0.5 + policy.margin_of(s)).alias("high"))
            for i, s in enumerate(policy.stages)
        )
    )
    out = df.withColumn("__s", each)
    out = out.withColumn("__exit", F.get(F.filter("__s", lambda s: outside(s["p"], s["low"], s["high"])), F.lit(0)))
    out = out.withColumn("__present", F.filter("__s", lambda s: s["p"].isNotNull()))
    out = out.withColumn("__value", aggregate(F.transform("__present", lambda s: s["p"]), policy.aggregation))
    nearest = F.array_min(F.transform("__present", lambda s: F.struct(F.abs(s["p"] - F.col("__value")).alias("d"), s["i"].alias("i"), s["name"].alias("name"))))
    p = F.coalesce(F.col("__exit.p"), F.col("__value"))
    out = out.withColumns({"exited": F.col("__exit").isNotNull(), "stage_id": F.coalesce(F.col("__exit.name"), nearest["name"]), "probability": p})
    decision = F.when(F.col("probability").isNull(), UNKNOWN).when(F.col("probability") >= 0.5, POSITIVE).otherwise(NEGATIVE)
    confidence = F.when(F.col("probability") >= 0.5, F.col("probability")).otherwise(1 - F.col("probability"))
    ran = F.coalesce(F.col("__exit.i") + 1, F.lit(len(policy.stages))).cast("long")
    return out.withColumns({"decision": decision, "confidence": confidence, "n_ran": ran}).drop("__s", "__exit", "__present", "__value")


def one_sided(df: DataFrame, stages: Sequence[str], threshold: float, own_verdict: bool = True, aggregation: str = "mean") -> DataFrame:
    """The older policy: exit at p >= threshold. ``own_verdict``: the stage's verdict stands; else an exit is positive."""
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.col(s).alias("p")) for i, s in enumerate(stages)))
    found = F.get(F.filter(each, lambda s: F.coalesce(s["p"] >= threshold, F.lit(False))), F.lit(0))
    value = aggregate(F.filter(F.transform(each, lambda s: s["p"]), lambda p: p.isNotNull()), aggregation)
    verdict = (found["p"] >= 0.5) if own_verdict else F.lit(True)
    return df.withColumns({"exited": found.isNotNull(), "positive": F.when(found.isNotNull(), verdict).otherwise(value >= 0.5), "exit_at": found["i"].cast("long")})


def staged(urls: DataFrame, key: str, run: Sequence[tuple[Stage, Callable[[DataFrame], DataFrame]]], policy: Policy) -> DataFrame:
    """Runs costly stages only where the earlier ones didn't decide: (key, one probability column a stage).

    ``run`` has, for each stage, a function from rows to (key, probability). Undecided keys are filtered out before a
    stage, since a condition around a Python function would still evaluate it for every row.
    """
    known = urls.select(key)
    for stage, score in run:
        open_ = known
        for earlier, _ in run:
            if earlier is stage:
                break
            e = (0.5 - policy.margin_of(earlier), 0.5 + policy.margin_of(earlier))
            open_ = open_.where(~outside(F.col(earlier.probability), F.lit(e[0]), F.lit(e[1])))
        scored = score(urls.join(open_.select(key), key, "left_semi")).select(key, stage.probability)
        known = known.join(scored, key, "left")
    return known


def asymmetric(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """df with ``exited``: at or beyond the ends of a band that reaches ``low`` below a half and ``high`` above it."""
    return df.withColumn("exited", outside(F.col(score), F.lit(0.5 - low), F.lit(0.5 + high)))


def load_policy(text: str) -> Policy:
    """A policy from JSON: {"margin", "aggregation", "stages": [{"name", "probability", "margin"}]}, checked as ``Policy`` does."""
    given = json.loads(text)
    unknown = set(given) - {"margin", "aggregation", "stages"}
    if unknown or not given.get("stages"):
        raise ValueError(f"a policy needs stages and has margin and aggregation besides, not {sorted(unknown)}")
    stages = [Stage(s["name"], s.get("probability", f"p_{s['name']}"), s.get("margin")) for s in given["stages"]]
    return Policy(stages, **{k: given[k] for k in ("margin", "aggregation") if k in given})
