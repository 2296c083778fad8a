"""Sweeps of decision policies over tables of stage probabilities.

A sweep evaluates every URL under every point of a grid. The grid is never joined to the URLs: a URL's behaviour
under a margin depends only on how many of the ascending margins its probability lies outside of, so URLs are first
counted by these step numbers (and their verdicts), which gives a histogram of bounded size, and the grid meets the
histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions.text import leading
from harrier.plans.cascade import aggregate, outside
from harrier.plans.metrics import confusion, rates


def margins(n: int, top: float = 0.5) -> list[float]:
    """n margins from 0 to ``top``."""
    return [top * i / (n - 1) for i in range(n)]


def grid(df: DataFrame, values: Sequence[float], name: str = "value") -> DataFrame:
    """A small table (step, value)."""
    listed = F.array(*(F.lit(float(v)) for v in values))
    return df.sparkSession.range(len(values)).select(F.col("id").cast("int").alias("step"), F.element_at(listed, F.col("id").cast("int") + 1).alias(name))


def steps_outside(p: Column, values: Sequence[float]) -> Column:
    """At how many of the ascending margins a probability is outside its band (so at steps below that number)."""
    low, high = (F.array(*(F.lit(0.5 + sign * v) for v in values)) for sign in (-1, 1))
    return leading(len(values), lambda i: outside(p, F.get(low, i), F.get(high, i)))


def histogram(df: DataFrame, stages: Sequence[str], truth: str, values: Sequence[float], aggregation: str = "mean") -> DataFrame:
    """Rows counted by step numbers, verdicts and truth: k0.., v0.., fallback, y, n."""
    present = F.filter(F.array(*stages), lambda p: p.isNotNull())
    keys = [c for i, s in enumerate(stages) for c in (steps_outside(F.col(s), values).alias(f"k{i}"), F.coalesce(F.col(s) >= 0.5, F.lit(False)).alias(f"v{i}"))]
    fallback = F.coalesce(aggregate(present, aggregation) >= 0.5, F.lit(False)).alias("fallback")
    named = df.select(*keys, fallback, F.col(truth).cast("boolean").alias("y"))
    return named.groupBy(*named.columns).agg(F.count("*").alias("n"))


def _exit(n_stages: int, step: Sequence[str]) -> tuple[Column, Column]:
    """Where rows of the histogram exit (the number of stages if nowhere) and their verdict, at given step columns."""
    at, verdict = F.lit(n_stages), F.col("fallback")
    for i in reversed(range(n_stages)):
        out = F.col(f"k{i}") > F.col(step[i])
        at, verdict = F.when(out, i).otherwise(at), F.when(out, F.col(f"v{i}")).otherwise(verdict)
    return at, verdict


def _weighted(predicted: Column) -> list[Column]:
    n, y = F.col("n"), F.col("y")
    cell = lambda c: F.sum(F.when(c, n).otherwise(0)).cast("long")
    return [cell(y & predicted).alias("tp"), cell(~y & predicted).alias("fp"), cell(y & ~predicted).alias("fn"), cell(~y & ~predicted).alias("tn")]


def margin_sweep(df: DataFrame, stages: Sequence[str], truth: str, values: Sequence[float], aggregation: str = "mean", latency: Sequence[float] | None = None) -> DataFrame:
    """One margin for all stages: step, margin, tp.., rates, exits by stage and, with latencies, the mean latency."""
    counts = histogram(df, stages, truth, values, aggregation)
    table = F.broadcast(grid(df, values, "margin"))  # as many rows as the caller's margins
    at, verdict = _exit(len(stages), ["step"] * len(stages))
    met = counts.join(table).withColumns({"__at": at, "__verdict": verdict})
    exits = [F.sum(F.when(F.col("__at") == i, F.col("n")).otherwise(0)).cast("long").alias(f"exit_{i}") for i in range(len(stages) + 1)]
    cost = []
    if latency is not None:
        spent = F.element_at(F.array(*(F.lit(float(sum(latency[: i + 1]))) for i in (*range(len(stages)), len(stages) - 1))), F.col("__at") + 1)
        cost = [(F.sum(spent * F.col("n")) / F.sum("n")).alias("mean_latency_ms")]
    return rates(met.groupBy("step", "margin").agg(*_weighted(F.col("__verdict")), *exits, *cost))


def margin_grid(df: DataFrame, stages: Sequence[str], truth: str, values: Sequence[float], latency: Sequence[float], aggregation: str = "mean") -> DataFrame:
    """A margin for each stage: every combination, with its rates and mean latency.

    The histogram is cut down stage by stage: the rows that a stage's step lets through are summed by what the later
    stages need, so the last join is on a table no larger than a stage's steps.
    """
    n = len(stages)
    table = grid(df, values, "margin")
    # bounded by steps and verdicts; kept, as each stage's branch and the total read it
    counts = histogram(df, stages, truth, values, aggregation).persist()
    total = counts.agg(F.sum("n")).first()[0] or 0
    state, spent, steps, done = counts, 0.0, [], []
    for i in range(n):
        spent += float(latency[i])
        crossed = state.join(F.broadcast(table.select(F.col("step").alias(f"s{i}"))))
        steps.append(f"s{i}")
        leaves = F.col(f"k{i}") > F.col(f"s{i}")
        left = crossed.where(leaves)
        done.append(left.groupBy(*steps).agg(*_weighted(F.col(f"v{i}")), (F.sum("n") * F.lit(spent)).alias("cost")))
        later = [c for j in range(i + 1, n) for c in (f"k{j}", f"v{j}")]
        state = crossed.where(~leaves).groupBy(*steps, *later, "fallback", "y").agg(F.sum("n").alias("n"))
    final = state.groupBy(*steps).agg(*_weighted(F.col("fallback")), (F.sum("n") * F.lit(spent)).alias("cost"))
    points = table.select(F.col("step").alias("s0"))
    for i in range(1, n):
        points = points.join(F.broadcast(table.select(F.col("step").alias(f"s{i}"))))
    cells = ("tp", "fp", "fn", "tn")
    for i, part in enumerate([*done, final]):
        by = steps[: i + 1] if i < n else steps
        part = part.select(*by, *(F.col(c).alias(f"__{c}{i}") for c in (*cells, "cost")))
        points = points.join(part, by, "left")
    add = lambda c: sum((F.coalesce(F.col(f"__{c}{i}"), F.lit(0)) for i in range(1, n + 1)), F.coalesce(F.col(f"__{c}0"), F.lit(0)))
    named = points.select(*steps, *(add(c).cast("long").alias(c) for c in cells), (add("cost") / F.lit(float(max(total, 1)))).alias("mean_latency_ms"))
    lookup = F.array(*(F.lit(float(v)) for v in values))
    return rates(named.withColumns({f"margin_{i}": F.element_at(lookup, F.col(f"s{i}") + 1) for i in range(n)}))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """positive at score >= threshold, for each threshold in ascending order; scores are counted by how many they reach."""
    thresholds = sorted(float(t) for t in thresholds)
    listed = F.array(*(F.lit(t) for t in thresholds))
    reached = leading(len(thresholds), lambda i: F.coalesce(F.col(score) >= F.get(listed, i), F.lit(False)))
    counts = df.groupBy(reached.alias("k"), F.col(truth).cast("boolean").alias("y")).agg(F.count("*").alias("n"))
    met = counts.join(F.broadcast(grid(df, thresholds, "threshold")))
    return rates(met.groupBy("step", "threshold").agg(*_weighted(F.col("k") > F.col("step"))))


def outcomes_by_exit(df: DataFrame, stages: Sequence[str], truth: str, values: Sequence[float], aggregation: str = "mean") -> DataFrame:
    """step, exit_at, outcome and n, with a row for every combination."""
    counts = histogram(df, stages, truth, values, aggregation)
    at, verdict = _exit(len(stages), ["step"] * len(stages))
    cell = F.when(F.col("y") & F.col("v"), "TP").when(~F.col("y") & F.col("v"), "FP").when(F.col("y"), "FN").otherwise("TN")
    met = counts.join(F.broadcast(grid(df, values))).withColumns({"exit_at": at, "v": verdict}).withColumn("outcome", cell)
    n = met.groupBy("step", "exit_at", "outcome").agg(F.sum("n").alias("n"))
    every = grid(df, values).select("step", F.explode(F.array(*(F.lit(i) for i in range(len(stages) + 1)))).alias("exit_at"))
    every = every.select("step", "exit_at", F.explode(F.array(*map(F.lit, ("TP", "FP", "FN", "TN")))).alias("outcome"))
    return every.join(n, ["step", "exit_at", "outcome"], "left").select("step", "exit_at", "outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pick_margins(points: DataFrame, budget: float | None, prefer: str = "cheap", value: str = "f1", cost: str = "mean_latency_ms") -> DataFrame:
    """The best point within a budget; of nearly equal ones the cheapest or the dearest, with the number of ties."""
    feasible = points if budget is None else points.where(F.col(cost) <= budget)
    best = feasible.withColumn("__best", F.max(value).over(Window.partitionBy(F.lit(0))))  # the points of one grid
    tied = best.where(F.abs(F.col(value) - F.col("__best")) <= 1e-8 + 1e-5 * F.abs("__best"))
    keys = [c for c in points.columns if c.startswith("s") and c[1:].isdigit()] or [points.columns[0]]
    order = F.struct((F.col(cost) if prefer == "wide" else -F.col(cost)).alias("c"), *((-F.col(k)).alias(k) for k in keys))
    return tied.agg(F.max_by(F.struct(*points.columns), order).alias("__p"), F.count("*").alias("n_ties")).select("__p.*", "n_ties")


def budget_picks(points: DataFrame, budgets: Sequence[float], value: str = "f1", cost: str = "mean_latency_ms") -> DataFrame:
    """For each budget the largest value within it, the share of feasible points not above it, and their number."""
    table = F.broadcast(grid(points, budgets, "budget"))
    met = points.join(table, F.col(cost) <= F.col("budget"))
    return met.groupBy("budget").agg(F.max(value).alias(f"best_{value}"), F.count("*").alias("n_feasible"))


def budget_margins(points: DataFrame, budgets: Sequence[float], value: str = "f1", cost: str = "mean_latency_ms") -> DataFrame:
    """For each budget the cheapest of the nearly best points within it, as ``pick_margins`` has it, with the numbers of ties and of feasible points.

    The points, a grid of the caller's margins, are computed once: the best value comes from a window over a budget's points.
    """
    met = points.join(F.broadcast(grid(points, budgets, "budget")), F.col(cost) <= F.col("budget"))
    by = Window.partitionBy("budget")
    best = met.withColumns({"__best": F.max(value).over(by), "n_feasible": F.count("*").over(by)})
    tied = best.where(F.abs(F.col(value) - F.col("__best")) <= 1e-8 + 1e-5 * F.abs("__best"))
    keys = [c for c in points.columns if c.startswith("s") and c[1:].isdigit()]
    order = F.struct((-F.col(cost)).alias("c"), *((-F.col(k)).alias(k) for k in keys))
    picked = tied.groupBy("budget", "n_feasible").agg(F.max_by(F.struct(*points.columns), order).alias("__p"), F.count("*").alias("n_ties"))
    return picked.select("budget", "__p.*", "n_ties", "n_feasible")


def decisions(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row of confusion counts and rates."""
    cells = confusion(F.col(truth).cast("boolean"), F.col(predicted).cast("boolean"))
    return rates(df.agg(*(c.alias(n) for n, c in cells.items())))
