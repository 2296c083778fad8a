"""The evaluation protocol: models are fitted on one part, chosen on a second, and policies scored on a third."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.plans import models, sweeps
from harrier.plans.cascade import AGGREGATIONS, Policy, Stage, decide
from harrier.plans.metrics import confusion, over, rates


def outcome(phase_failed: Column, error: Column) -> Column:
    """What became of a timed stage, from the phase that failed (null: none) and the text of its error."""
    word = F.lower(F.coalesce(error, F.lit("")))
    collect = F.when(word.rlike("timeout"), "timeout").when(word.rlike("connect|resolve|dns|unreachable|ssl|network"), "unreachable").otherwise("error")
    return F.when(phase_failed.isNull(), "ok").when(phase_failed == "collect", collect).when(phase_failed == "extract", "feature_error").otherwise("model_error")


def near_timeout(ms: Column, ceiling: Column) -> Column:
    """Whether a collection took nine tenths of its ceiling or more."""
    return F.coalesce(ms >= 0.9 * ceiling, F.lit(False))


def degraded_content(status: Column, html: Column) -> Column:
    """Whether a page that was fetched is no use: no success status, or no markup."""
    return F.coalesce(~status.between(200, 399), F.lit(True)) | (F.coalesce(F.length(html), F.lit(0)) == 0)


@dataclass
class Chosen:
    """A stage's model, its type, and the measures of all candidates on the part that they were chosen on."""

    model: PipelineModel
    model_type: str
    table: DataFrame


def fit_and_select(train: DataFrame, validation: DataFrame, columns: Sequence[str], label: str, kinds: Sequence[str], metric: str = "f1") -> Chosen:
    """Fits each type of model on ``train`` and takes the best on ``validation``, of equal ones the first by name."""
    fitted, rows = {}, []
    for kind in kinds:
        fitted[kind], _ = models.train(train, columns, label, kind)
        scored = models.predict(validation, fitted[kind], columns, [label])
        rows.append(models.evaluate(scored, label, "probability").withColumn("model", F.lit(kind)))
    table = reduce(DataFrame.unionByName, rows)
    best = models.select_best(table, metric).first()["model"]
    return Chosen(fitted[best], best, table.withColumn("selected", F.col("model") == best))


def choose_aggregation(df: DataFrame, stages: Sequence[str], truth: str) -> str:
    """The rule whose verdicts over all stages have the best f1; of equal ones the first of ``AGGREGATIONS``."""
    y, cells = F.col(truth).cast("boolean"), []
    for how in AGGREGATIONS:
        every = sweeps.aggregate(F.filter(F.array(*stages), lambda p: p.isNotNull()), how)
        cells += [c.alias(f"{how}_{n}") for n, c in confusion(y, F.coalesce(every >= 0.5, F.lit(False))).items()]
    row = df.agg(*cells).first()
    f1 = {how: 2 * row[f"{how}_tp"] / max(1, 2 * row[f"{how}_tp"] + row[f"{how}_fp"] + row[f"{how}_fn"]) for how in AGGREGATIONS}
    return max(AGGREGATIONS, key=lambda how: (f1[how], -AGGREGATIONS.index(how)))


def systems(df: DataFrame, policies: Mapping[str, Policy], truth: str, latency: Mapping[str, float]) -> DataFrame:
    """A row for each policy: confusion counts, rates and the mean latency of the stages that rows reach; one pass each."""
    rows = []
    for name, policy in policies.items():
        decided = decide(df, policy)
        spent = F.aggregate(F.slice(F.array(*(F.lit(float(latency[s.name])) for s in policy.stages)), F.lit(1), F.col("n_ran").cast("int")), F.lit(0.0), lambda a, x: a + x)
        cells = confusion(F.col(truth).cast("boolean"), F.col("decision") == "phish")
        rows.append(decided.agg(*(c.alias(n) for n, c in cells.items()), F.avg(spent).alias("mean_latency_ms")).withColumn("system", F.lit(name)))
    return rates(reduce(DataFrame.unionByName, rows))


def picks_on_test(validation: DataFrame, test: DataFrame, stages: Sequence[str], truth: str, values: Sequence[float], latency: Sequence[float], budgets: Sequence[float], aggregation: str) -> DataFrame:
    """For each budget the margins that are best on ``validation``, and how they do on ``test``.

    optimism is the best f1 on test within the budget less that of the pick; percentile is the share of the margins
    that are feasible on validation which do no better on test than the pick.
    """
    steps = [f"s{i}" for i in range(len(stages))]
    chosen_on = sweeps.margin_grid(validation, stages, truth, values, latency, aggregation)
    scored_on = sweeps.margin_grid(test, stages, truth, values, latency, aggregation)
    both = chosen_on.select(*steps, F.col("f1").alias("val_f1"), F.col("mean_latency_ms").alias("val_ms")).join(scored_on.select(*steps, "f1", "mean_latency_ms"), steps)
    both = both.join(F.broadcast(sweeps.grid(both, budgets, "budget").drop("step")))  # a row for each of the caller's budgets
    order = F.struct(F.round("val_f1", 9), -F.col("val_ms"), *(-F.col(s) for s in steps))
    feasible = both.where(F.col("val_ms") <= F.col("budget"))
    pick = feasible.groupBy("budget").agg(F.max_by(F.struct(*steps, "val_f1", "f1", "mean_latency_ms"), order).alias("p"))
    best = both.where(F.col("mean_latency_ms") <= F.col("budget")).groupBy("budget").agg(F.max("f1").alias("oracle_f1"))
    share = feasible.join(F.broadcast(pick), "budget").groupBy("budget").agg(over(F.count_if(F.col("f1") <= F.col("p.f1")), F.count("*")).alias("percentile"))
    out = pick.join(best, "budget", "left").join(share, "budget")
    return out.select("budget", "p.*", "oracle_f1", (F.col("oracle_f1") - F.col("p.f1")).alias("optimism"), "percentile")


def run_once(rows: DataFrame, stages: Mapping[str, Sequence[str]], label: str, group: str, key: str, kinds: Sequence[str], latency: Mapping[str, float], seed: int, fold: int, values: Sequence[float], budgets: Sequence[float]) -> dict[str, DataFrame]:
    """The whole protocol for one seed and fold. stages: the feature columns of each, in the cascade's order.

    Returns probabilities of the test part, the candidates' measures, the systems on test and the picks by budget.
    """
    parts = models.nested_split(rows, group, label, fold, seed=seed).persist()
    part = lambda name: parts.where(F.col("part") == name)
    scored, tables = parts.select(key, "part", label), []
    for name, columns in stages.items():
        chosen = fit_and_select(part("train"), part("validation"), columns, label, kinds)
        tables.append(chosen.table.withColumn("stage", F.lit(name)))
        scored = scored.join(models.predict(parts, chosen.model, columns, [key], name), key)
    names = list(stages)
    validation, test = (scored.where(F.col("part") == p) for p in ("validation", "test"))
    how = choose_aggregation(validation, names, label)
    ms = [latency[n] for n in names]
    policies = {f"{n}-only": Policy([Stage(n, n, 0.0)]) for n in names} | {f"full-{a}": Policy([Stage(n, n, 0.5) for n in names], aggregation=a) for a in AGGREGATIONS}
    stamp = {"seed": F.lit(seed), "fold": F.lit(fold)}
    return {
        "probabilities": test.withColumns(stamp),
        "zoo": reduce(DataFrame.unionByName, tables).withColumns(stamp),
        "systems": systems(test, policies, label, latency).withColumns(stamp),
        "sweep": sweeps.margin_sweep(test, names, label, values, how, ms).withColumns(stamp),
        "picks": picks_on_test(validation, test, names, label, values, ms, budgets, how).withColumns(stamp),
    }
