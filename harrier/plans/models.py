"""Training, applying and evaluating stage classifiers with MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.plans.metrics import ranking_metrics, rates
from harrier.sources import store

SEED = 42
LOT = 20_000
#: Queries and base rows of a group, and base rows compared with its queries at a time.
QUERY_BLOCK, BASE_BLOCK, BASE_ROWS = 1024, 8192, 512


def estimators(seed: int = SEED) -> dict:
    """Estimators by model type, and whether they want scaled features.

    MLlib has no extra trees, nearest neighbours, RBF machine or other boosters: those names are refused and never
    replaced by another model without saying so.
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "logistic_regression": (LogisticRegression(maxIter=100, **common), True),
        "decision_tree": (DecisionTreeClassifier(seed=seed, **common), False),
        "random_forest": (RandomForestClassifier(numTrees=100, seed=seed, **common), False),
        "gradient_boosting": (GBTClassifier(maxIter=50, maxDepth=4, seed=seed, **common), False),
        "linear_svm": (LinearSVC(maxIter=100, **common), True),
    }


def align(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The feature columns in order as doubles: missing ones and what isn't a number count as 0, others are dropped."""
    have = dict(df.dtypes)

    def one(c: str) -> Column:
        x = F.lit(0.0) if c not in have else F.col(f"`{c}`").cast("int").cast("double") if have[c] == "boolean" else F.col(f"`{c}`").try_cast("double")
        return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)).alias(c)

    return df.select(*(F.col(f"`{k}`") for k in keep), *(one(c) for c in columns))


def missing_and_extra(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Feature columns that df lacks, and columns of df that are no feature."""
    return [c for c in columns if c not in df.columns], [c for c in df.columns if c not in columns]


def train(df: DataFrame, columns: Sequence[str], label: str, model_type: str = "random_forest", seed: int = SEED) -> tuple[PipelineModel, dict]:
    """A fitted pipeline over aligned features, and a summary. label: 1 or true for positives."""
    known = estimators(seed)
    if model_type not in known:
        raise ValueError(f"model type is one of {sorted(known)}, not {model_type}")
    counts = {r["y"]: r["n"] for r in df.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect() if r["y"] is not None}
    if len(counts) < 2:
        raise ValueError(f"training needs rows of both classes, not {counts}")
    estimator, scaled = known[model_type]
    safe = [f"f{i}" for i in range(len(columns))]  # names with dots can't be assembled
    rows = renamed(align(df.where(F.col(label).isNotNull()), columns, [label]), columns).withColumn("label", F.col(f"`{label}`").cast("double"))
    raw = "raw" if scaled else "features"
    stages = [VectorAssembler(inputCols=safe, outputCol=raw)] + ([StandardScaler(inputCol="raw", outputCol="features")] if scaled else []) + [estimator]
    return Pipeline(stages=stages).fit(rows), {"model_type": model_type, "n_rows": sum(counts.values()), "n_positive": counts.get(1, 0), "feature_columns": list(columns)}


def renamed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    number = {c: f"f{i}" for i, c in enumerate(columns)}
    return df.select(*(F.col(f"`{c}`").alias(number.get(c, c)) for c in df.columns))


def predict(df: DataFrame, model: PipelineModel, columns: Sequence[str], keep: Sequence[str], name: str = "probability") -> DataFrame:
    """``keep`` and the probability of the positive class (for models without one, the logistic function of the margin)."""
    out = model.transform(renamed(align(df, columns, keep), columns))
    if "probability" in out.columns:
        return out.select(*keep, vector_to_array("probability")[1].alias(name))
    margin = vector_to_array("rawPrediction")[1]
    return out.select(*keep, (1 / (1 + F.exp(-margin))).alias(name))


def sum_by_label(classes: Column, probabilities: Column, label_map: dict[str, str]) -> Column:
    """A map from label to the summed probability of the classes that map to it; unmapped classes keep their name."""
    table = F.create_map(*(F.lit(x) for kv in label_map.items() for x in kv)) if label_map else F.create_map().cast("map<string,string>")
    pairs = F.arrays_zip(F.transform(classes, lambda c: F.coalesce(F.try_element_at(table, c), c)).alias("k"), probabilities.alias("v"))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    summed = lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0.0), lambda a, p: a + p["v"])
    return F.map_from_arrays(keys, F.transform(keys, summed))


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """df with ``fold``: rows of a group share it, and positive and negative groups are each dealt out evenly.

    Groups are summed first; within each class they are dealt in rounds from the largest, in turns of alternate
    direction, so folds have nearly equal numbers of rows. Many groups are dealt in several independent lots of about
    ``LOT`` groups, so no task orders them all.
    """
    groups = df.groupBy(group).agg(F.count("*").alias("n"), F.max(F.col(label).cast("int")).alias("y"))
    lot = F.pmod(F.xxhash64(group), F.lit(max(1, groups.count() // LOT)))
    order = Window.partitionBy("y", lot).orderBy(F.desc("n"), F.xxhash64(F.lit(seed), F.col(group)), group)
    dealt = groups.withColumn("r", F.row_number().over(order) - 1)
    turn, place = F.floor(F.col("r") / k).cast("int"), F.col("r") % k
    fold = F.when(turn % 2 == 0, place).otherwise(F.lit(k - 1) - place)
    return df.join(dealt.select(group, fold.cast("int").alias("fold")), group)


def nested_split(df: DataFrame, group: str, label: str, fold: int, outer: int = 5, inner: int = 4, seed: int = 0) -> DataFrame:
    """df with ``part``: test is one outer fold, validation one inner fold of the rest, train what remains; groups stay whole."""
    first = group_folds(df, group, label, outer, seed)
    rest = group_folds(first.where(F.col("fold") != fold).withColumnRenamed("fold", "__outer"), group, label, inner, seed + 1)
    test = first.where(F.col("fold") == fold).drop("fold").withColumn("part", F.lit("test"))
    return test.unionByName(rest.drop("__outer").withColumn("part", F.when(F.col("fold") == 0, "validation").otherwise("train")).drop("fold"))


def leaks(df: DataFrame, group: str, part: str = "part") -> DataFrame:
    """Groups that are in more than one part; there should be none."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """df with ``held_out`` for about the given share of each class, by a seeded hash of the key and so without a shuffle."""
    return df.withColumn("held_out", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < share * 1_000_000)


def stratified_holdout(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """df with ``held_out`` for exactly round(share * n) rows of each class, those with the smallest seeded hashes of the key.

    Ranks are taken in lots of hashes and lots are counted first, so no class is one task's.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__lot", F.shiftright("__h", 54))
    lots = hashed.groupBy(label, "__lot").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(label).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__total": F.sum("__n").over(Window.partitionBy(label))}).drop("__n")
    within = F.row_number().over(Window.partitionBy(label, "__lot").orderBy("__h", key))
    ranked = hashed.withColumn("__r", within)
    joined = ranked.join(F.broadcast(lots.withColumnRenamed(label, "__y")), ranked[label].eqNullSafe(F.col("__y")) & (ranked["__lot"] == lots["__lot"])).drop(lots["__lot"])  # 1,024 rows a class
    return joined.withColumn("held_out", F.col("__r") + F.col("__before") <= F.round(F.col("__total") * F.lit(share))).drop("__h", "__lot", "__r", "__before", "__total", "__y")


def cross_validate(df: DataFrame, columns: Sequence[str], label: str, model_type: str, key: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """The measures of a model type on each of so many folds, every class being dealt over them."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int")
    dealt, rows = df.withColumn("__fold", place), []
    for k in range(folds):
        model, _ = train(dealt.where(F.col("__fold") != k), columns, label, model_type, seed)
        scored = predict(dealt.where(F.col("__fold") == k), model, columns, [label])
        rows.append(evaluate(scored, label, "probability").withColumn("fold", F.lit(k)))
    return reduce(DataFrame.unionByName, rows)


def save_model(model: PipelineModel, columns: Sequence[str], path: str) -> None:
    """A fitted pipeline and, beside it, its feature columns in order."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame(list(enumerate(columns)), "place int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/columns")


def load_model(path: str) -> tuple[PipelineModel, list[str]]:
    """A saved pipeline and its feature columns."""
    rows = SparkSession.active().read.schema("place int, name string").json(f"{path}/columns").orderBy("place").collect()
    return PipelineModel.load(f"{path}/model"), [r["name"] for r in rows]


def training_set(urls: DataFrame, features: DataFrame, key: str, label: str = "label", group: str | None = None, limit: int | None = None) -> DataFrame:
    """Labelled rows that have features, with y (1 for positives); with ``group`` one row a group, positive if any is."""
    rows = store.labelled(urls, label=label)
    if limit is not None:
        rows = rows.orderBy(key).limit(limit)
    met = rows.join(features, key)
    if group is not None:
        return store.any_positive(met, group, label, key).withColumn("y", F.col("positive").cast("int")).drop("positive")
    return met.withColumn("y", (F.col(label) == store.LABELS[0]).cast("int"))


def evaluate(df: DataFrame, truth: str, score: str) -> DataFrame:
    """roc_auc, average_precision, and the rates at a probability of 0.5."""
    y, p = F.col(truth).cast("boolean"), F.col(score) >= 0.5
    cells = df.agg(*(F.count_if(c).alias(n) for n, c in {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}.items()))
    return rates(cells).crossJoin(ranking_metrics(df, truth, score))  # one row each


def select_best(results: DataFrame, metric: str = "f1", name: str = "model") -> DataFrame:
    """Models ranked by a metric, equal ones by name."""
    return results.orderBy(F.desc(metric), name)


def nearest_vectors(queries: DataFrame, base: DataFrame, k: int, key: str = "id", vector: str = "vector", label: str = "label") -> DataFrame:
    """The k nearest base rows of each query row by squared distance, for a query table small enough to send to every task.

    It is the caller's stated query set: each task keeps the k nearest of its rows for each query before the shuffle.
    """
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("__q"))
    distance = F.aggregate(F.zip_with("__q", F.col(vector), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    met = base.join(F.broadcast(q)).where(F.col(key) != F.col("query")).select("query", F.col(key).alias("neighbour"), label, distance.alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_in_blocks(queries: DataFrame, base: DataFrame, k: int, key: str = "id", vector: str = "vector", label: str = "label") -> DataFrame:
    """The k nearest base rows of each query row by squared distance, for tables of any size: query, neighbour, label, distance, rank.

    Each block of about ``QUERY_BLOCK`` queries meets each block of about ``BASE_BLOCK`` base rows in one group, which
    keeps the k nearest of its rows for each query; these are ranked over all blocks. Nothing passes through the driver,
    and no group grows with the tables. Rows without a key or vector, with a null or not-a-number component or of another
    length are nobody's neighbours.
    """
    kinds = {f.name: f.dataType for f in base.schema}
    schema = T.StructType([T.StructField("query", kinds[key]), T.StructField("neighbour", kinds[key]), T.StructField("label", kinds[label]), T.StructField("distance", T.DoubleType())])
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull()
    q, b = queries.where(usable), base.where(usable)
    n_q, n_b = (max(1, -(-rows.count() // size)) for rows, size in ((q, QUERY_BLOCK), (b, BASE_BLOCK)))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int, *columns: Column) -> DataFrame:
        """rows with the number of their own block, once for each block of the other side."""
        numbered = rows.select(F.pmod(F.xxhash64(key, vector), F.lit(n)).alias(own), *columns)
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    left = dealt(q, "i", n_q, "j", n_b, F.col(key).alias("query"), F.col(vector).alias("v"))
    right = dealt(b, "j", n_b, "i", n_q, F.col(key).alias("neighbour"), F.col(vector).alias("v"), F.col(label).alias("label"))

    def run(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = []
        lengths, other_lengths = some["v"].map(len).to_numpy(), others["v"].map(len).to_numpy()
        for n in np.intersect1d(lengths, other_lengths):
            asked, rows = some[lengths == n], others[other_lengths == n]
            x, y = (np.stack([np.asarray(v, dtype=np.float64) for v in side["v"]]) for side in (asked, rows))
            names = asked["query"].to_numpy()
            for at in range(0, len(rows), BASE_ROWS):
                part = rows.iloc[at : at + BASE_ROWS]
                distance = np.zeros((len(asked), len(part)))
                for d in range(n):
                    step = x[:, d, None] - y[None, at : at + BASE_ROWS, d]
                    distance += step * step
                distance[names[:, None] == part["neighbour"].to_numpy()[None, :]] = np.nan
                kth = np.partition(distance, min(k, len(part)) - 1, axis=1)[:, min(k, len(part)) - 1]  # not-a-number comes last
                u, w = np.nonzero(~np.isnan(distance) & ~(distance > kth[:, None]))
                met = pd.DataFrame({"query": names[u], "neighbour": part["neighbour"].to_numpy()[w], "label": part["label"].to_numpy()[w], "distance": distance[u, w]})
                found.append(met.sort_values(["query", "distance", "neighbour"]).groupby("query", sort=False).head(k))
        if not found:
            return pd.DataFrame({f.name: [] for f in schema})
        return pd.concat(found).sort_values(["query", "distance", "neighbour"]).groupby("query", sort=False).head(k)

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, schema)
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
