"""Metrics of decisions and of stage timings as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions.text import leading
from harrier.plans.quantiles import quantiles

OUTCOMES = ("ok", "unreachable", "timeout", "feature_error", "model_error")


def confusion(truth: Column, predicted: Column) -> dict[str, Column]:
    """tp, fp, fn and tn as aggregates of two boolean columns."""
    cell = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return {"tp": cell(truth & predicted), "fp": cell(~truth & predicted), "fn": cell(truth & ~predicted), "tn": cell(~truth & ~predicted)}


def over(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def rates(df: DataFrame) -> DataFrame:
    """df with precision, recall, f1, accuracy, fpr and fnr of its columns tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = df.withColumns({"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "accuracy": over(tp + tn, tp + fp + fn + tn), "fpr": over(fp, fp + tn), "fnr": over(fn, fn + tp)})
    return out.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of each class, and their macro and weighted means; truth and predicted hold classes."""
    classes = df.select(F.explode(F.array(truth, predicted)).alias("class")).distinct()
    cells = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    pairs = cells.select(F.explode(F.array_distinct(F.array(F.col(truth), F.col(predicted)))).alias("class"), F.col(truth).alias("t"), F.col(predicted).alias("p"), "n")
    sums = pairs.groupBy("class").agg(
        F.sum(F.when((F.col("t") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("t") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0)).alias("given"),
    )
    each = classes.join(sums, "class").withColumns({"precision": over(F.col("hit"), F.col("given")), "recall": over(F.col("hit"), F.col("support"))})
    each = each.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    macro = each.agg(*(F.avg(c).alias(c) for c in names), F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = each.agg(*(over(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return each.unionByName(macro).unionByName(weighted)


def by_score(df: DataFrame, truth: str, score: str, pieces: int = 256) -> DataFrame:
    """One row for each distinct score: positives and negatives at it (pos, neg) and at or above it (tp, fp).

    Scores are counted first, then cut at approximate quantiles into ``pieces`` of about equal size. Running sums go
    over each piece on its own, after the totals of the pieces above it, so no task sees all scores.
    """
    positive = F.col(truth).cast("boolean")
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    cuts = sorted(set(counts.approxQuantile("score", [i / pieces for i in range(1, pieces)], 0.5 / pieces)))
    listed = F.array(*map(F.lit, cuts)).cast("array<double>")
    piece = leading(len(cuts), lambda i: F.col("score") >= F.get(listed, i))
    placed = counts.withColumn("piece", piece)
    above = Window.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each piece
    totals = placed.groupBy("piece").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = totals.select("piece", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("fp0"))
    down = Window.partitionBy("piece").orderBy(F.desc("score"))
    met = placed.join(F.broadcast(before), "piece")
    return met.select("score", "pos", "neg", (F.col("tp0") + F.sum("pos").over(down)).alias("tp"), (F.col("fp0") + F.sum("neg").over(down)).alias("fp"))


def ranking_metrics(df: DataFrame, truth: str, score: str) -> DataFrame:
    """roc_auc (ties count half), average_precision, n_pos and n_neg."""
    steps = by_score(df, truth, score)
    totals = steps.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    sums = steps.agg(
        F.sum(F.col("pos") * (F.lit(0.0) - F.col("fp") + F.col("neg") / 2.0)).alias("below"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("area"),
    )
    both = totals.crossJoin(sums)  # one row each
    auc = F.try_divide(F.col("below") + F.col("n_pos") * F.col("n_neg"), (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return both.select(auc.alias("roc_auc"), F.try_divide(F.col("area"), F.col("n_pos").cast("double")).alias("average_precision"), "n_pos", "n_neg")


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """threshold, fpr and tpr at each distinct score."""
    steps = by_score(df, truth, score)
    totals = steps.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return steps.crossJoin(F.broadcast(totals)).select(F.col("score").alias("threshold"), over(F.col("fp"), F.col("n_neg")).alias("fpr"), over(F.col("tp"), F.col("n_pos")).alias("tpr"))  # totals: one row


def hundredths(x: Column) -> Column:
    """x to 2 decimals, with halves of the scaled double away from zero, as SQL's round() does it; Spark's rounds the shortest decimal text."""
    x = x.cast("double")
    return F.when(F.abs(x) < 1e300, F.round(x * 100.0) / 100.0).otherwise(x)


def latency_summary(df: DataFrame, keys: Sequence[str], phases: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """By key and phase: count, mean, median, p95, min and max of the rows that went well, 2 decimals; groups without any stay.

    Median and p95 are exact for groups of any size and hold no group's values (``plans/quantiles.py``).
    """
    good = F.when(F.col(outcome) == "ok", F.col("ms"))
    pairs = ", ".join(f"'{p}', `{p}`" for p in phases)
    long = df.selectExpr(*keys, f"`{outcome}`", f"stack({len(phases)}, {pairs}) AS (phase, ms)")
    sums = long.groupBy(*keys, "phase").agg(
        F.count(good).alias("n"),
        hundredths(F.avg(good)).alias("mean_ms"),
        hundredths(F.min(good)).alias("min_ms"),
        hundredths(F.max(good)).alias("max_ms"),
        F.count("*").alias("n_total"),
    )
    by = [*keys, "phase"]
    middle = quantiles(long.where(F.col(outcome) == "ok"), by, "ms", {"median_ms": 0.5, "p95_ms": 0.95})
    other = middle.toDF(*(f"__{c}" for c in middle.columns))
    met = sums.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by], "left")
    return met.select(*by, "n", "mean_ms", hundredths(F.col("__median_ms")).alias("median_ms"), hundredths(F.col("__p95_ms")).alias("p95_ms"), "min_ms", "max_ms", "n_total")


def outcome_rates(df: DataFrame, keys: Sequence[str], outcomes: Sequence[str] = OUTCOMES, outcome: str = "outcome") -> DataFrame:
    """By key: the number and share in per cent (1 decimal) of each outcome."""
    n = F.count("*")
    each = [x for o in outcomes for x in (F.count_if(F.col(outcome) == o).alias(f"n_{o}"), F.round(100 * F.count_if(F.col(outcome) == o) / n, 1).alias(f"pct_{o}"))]
    return df.groupBy(*keys).agg(n.alias("n_total"), *each)


def mean_sd(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """By key: mean and sample standard deviation of each value."""
    return df.groupBy(*keys).agg(*(x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))))


def first_best(df: DataFrame, keys: Sequence[str], value: str, tie: str, smallest: bool = False) -> DataFrame:
    """The row with the largest (or smallest) value by key; of equal ones the first by ``tie``."""
    order = [F.asc(value) if smallest else F.desc(value), F.asc(tie)]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def pair(df: DataFrame, how: Column) -> DataFrame:
    """The one row of df with the largest ordering struct."""
    return df.agg(F.max_by(F.struct(*df.columns), how).alias("__b")).select("__b.*")


def in_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """df with ``rank``, the place of a category in the given order; others come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.withColumn("rank", F.when(place > 0, place).otherwise(len(order) + 1).cast("long"))


def shares(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """By key: the share of each row's n in the total in per cent, and the least, largest and mean n."""
    by = Window.partitionBy(*keys)
    return df.withColumns({"pct": 100 * F.col(n) / F.sum(n).over(by), "least": F.min(n).over(by), "most": F.max(n).over(by), "mean": F.avg(n).over(by)})


def every_nth(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Each n-th step of a sweep."""
    return df.where(F.col(step) % n == 0)


def optimism(df: DataFrame, keys: Sequence[str], value: str, selected: str = "selected") -> DataFrame:
    """By key: the best value less the selected one's."""
    return df.groupBy(*keys).agg((F.max(value) - F.max(F.when(F.col(selected), F.col(value)))).alias("optimism"))


def percentile_of(df: DataFrame, keys: Sequence[str], value: str, selected: str = "selected") -> DataFrame:
    """By key: the share of rows whose value isn't above the selected one's."""
    chosen = df.groupBy(*keys).agg(F.max(F.when(F.col(selected), F.col(value))).alias("__x"))
    return df.join(F.broadcast(chosen), list(keys)).groupBy(*keys).agg(F.avg((F.col(value) <= F.col("__x")).cast("double")).alias("percentile"))
