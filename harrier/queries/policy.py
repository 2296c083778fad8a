"""Queries of policies, sweeps, metrics, stores, timings, records and models, each with its SQL.

``lineitem`` stands for a large table of stage probabilities (made by arithmetic, with nulls where a stage has no
evidence), ``events`` for a log of timings and a stream of changes, ``supplier`` and ``nation`` for addresses and
countries, ``customer`` and ``orders`` for registration records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions.text import mean, value_entropy
from harrier.functions.urls import normalize_url, url_parts
from harrier.operators import domain_features as records
from harrier.operators.explain import age_label, payload
from harrier.plans import boosting, extra_trees, metrics, models, sweeps
from harrier.plans.cascade import Policy, Stage, decide, one_sided
from harrier.sources import feeds, store

P = ("p_url", "p_content", "p_domain")
SHIPPED = Policy([Stage("url", "p_url", 0.49), Stage("content", "p_content", 0.28), Stage("domain", "p_domain", 0.10)])
LATENCY = (1.0, 50.0, 900.0)
BUDGETS = (50.0, 100.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0)
R = 9


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    p = lambda a, b: ((k * a + n * b) % 101 / 100.0).cast("double")
    return _read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        p(37, 11).alias("p_url"),
        F.when(F.col("l_partkey") % 10 != 0, p(53, 7)).alias("p_content"),
        F.when(F.col("l_suppkey") % 20 != 0, p(17, 29)).alias("p_domain"),
        (F.col("l_returnflag") == "R").alias("y"),
    )


_PROB = """p AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_orderkey * 37 + l_linenumber * 11) % 101 AS DOUBLE) / 100 AS p_url,
    CASE WHEN l_partkey % 10 <> 0 THEN CAST((l_orderkey * 53 + l_linenumber * 7) % 101 AS DOUBLE) / 100 END AS p_content,
    CASE WHEN l_suppkey % 20 <> 0 THEN CAST((l_orderkey * 17 + l_linenumber * 29) % 101 AS DOUBLE) / 100 END AS p_domain, l_returnflag = 'R' AS y FROM lineitem
)"""


def _agg(how: str) -> str:
    a = "list_filter([p_url, p_content, p_domain], lambda x: x IS NOT NULL)"
    return {"mean": f"(list_aggregate({a}, 'sum') / len({a}))", "max": f"list_max({a})", "median": f"list_median({a})"}[how]


def _decide_sql(m: tuple[float, float, float], how: str) -> str:
    out = [f"({c} <= 0.5::DOUBLE - {d}::DOUBLE OR {c} >= 0.5::DOUBLE + {d}::DOUBLE)" for c, d in zip(P, m, strict=True)]
    return f"""d AS (
  SELECT *, CASE WHEN {out[0]} THEN 1 WHEN {out[1]} THEN 2 WHEN {out[2]} THEN 3 END AS ex, {_agg(how)} AS value FROM p
), e AS (
  SELECT *, CASE ex WHEN 1 THEN p_url WHEN 2 THEN p_content WHEN 3 THEN p_domain ELSE value END AS probability FROM d
)"""


def _decided(df):
    return df.select("l_orderkey", "l_linenumber", "decision", F.round("probability", R).alias("probability"), F.round("confidence", R).alias("confidence"), "exited", "n_ran")


_DECIDED = "SELECT l_orderkey, l_linenumber, CASE WHEN probability IS NULL THEN 'unknown' WHEN probability >= 0.5 THEN 'phish' ELSE 'benign' END AS decision, round(probability, 9) AS probability, round(CASE WHEN probability >= 0.5 THEN probability ELSE 1 - probability END, 9) AS confidence, ex IS NOT NULL AS exited, CAST(coalesce(ex, 3) AS BIGINT) AS n_ran FROM e"


def _cascade(policy: Policy):
    return lambda spark, sf_dir: _decided(decide(probabilities(spark, sf_dir), policy))


def cascade_stage_counts(spark, sf_dir):
    done = decide(probabilities(spark, sf_dir), SHIPPED)
    return done.groupBy("stage_id", "exited", "decision").agg(F.count("*").alias("n"))


def cascade_one_sided(spark, sf_dir):
    done = one_sided(probabilities(spark, sf_dir), P, 0.3)
    return done.groupBy("exited", "positive", F.coalesce("exit_at", F.lit(-1)).cast("long").alias("exit_at")).agg(F.count("*").alias("n"))


def cascade_one_sided_forced(spark, sf_dir):
    done = one_sided(probabilities(spark, sf_dir), P, 0.3, own_verdict=False)
    return done.groupBy("exited", "positive").agg(F.count("*").alias("n"))


RATES = ("precision", "recall", "f1", "accuracy", "fpr", "fnr")


def _rounded(df, *keys):
    return df.select(*keys, "tp", "fp", "fn", "tn", *(F.round(c, R).alias(c) for c in RATES))


_CELLS = "sum(CAST(y AND v AS BIGINT))::BIGINT AS tp, sum(CAST(NOT y AND v AS BIGINT))::BIGINT AS fp, sum(CAST(y AND NOT v AS BIGINT))::BIGINT AS fn, sum(CAST(NOT y AND NOT v AS BIGINT))::BIGINT AS tn"
_RATES = "tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 9) AS fnr"


def confusion_metrics(spark, sf_dir):
    done = decide(probabilities(spark, sf_dir), SHIPPED).withColumn("v", F.col("decision") == "phish")
    return _rounded(sweeps.decisions(done, "y", "v"))


def class_report(spark, sf_dir):
    done = decide(probabilities(spark, sf_dir), SHIPPED).withColumn("truth", F.when(F.col("y"), "phish").otherwise("benign"))
    return metrics.report(done, "truth", "decision").select("class", *(F.round(c, R).alias(c) for c in ("precision", "recall", "f1")), "support")


DELTAS = sweeps.margins(51)


def delta_sweep(spark, sf_dir):
    out = sweeps.margin_sweep(probabilities(spark, sf_dir), P, "y", DELTAS, latency=LATENCY)
    return out.select(F.col("step").cast("long").alias("step"), "tp", "fp", "fn", "tn", F.round("f1", R).alias("f1"), "exit_0", "exit_1", "exit_2", "exit_3", F.round("mean_latency_ms", 6).alias("mean_latency_ms"))


def exit_composition(spark, sf_dir):
    return sweeps.margin_sweep(probabilities(spark, sf_dir), P, "y", sweeps.margins(11), aggregation="max").select(F.col("step").cast("long").alias("step"), "exit_0", "exit_1", "exit_2", "exit_3")


def outcome_cube(spark, sf_dir):
    out = sweeps.outcomes_by_exit(probabilities(spark, sf_dir), P, "y", sweeps.margins(11))
    return out.select(F.col("step").cast("long").alias("step"), F.col("exit_at").cast("long").alias("exit_at"), "outcome", "n")


def threshold_sweep(spark, sf_dir):
    out = sweeps.threshold_sweep(probabilities(spark, sf_dir), "p_url", "y", [i / 100 for i in range(101)])
    return _rounded(out.withColumn("step", F.col("step").cast("long")), "step")


def _grid(spark, sf_dir, n=11):
    return sweeps.margin_grid(probabilities(spark, sf_dir), P, "y", sweeps.margins(n), LATENCY)


def margin_grid3(spark, sf_dir):
    return _grid(spark, sf_dir).select(*(F.col(f"s{i}").cast("long").alias(f"s{i}") for i in range(3)), "tp", "fp", "fn", "tn", F.round("mean_latency_ms", 6).alias("mean_latency_ms"))


def _steps(*more):
    return [*(F.col(f"s{i}").cast("long").alias(f"s{i}") for i in range(3)), *(F.round(f"margin_{i}", R).alias(f"margin_{i}") for i in range(3)), *more]


def margin_grid_full(spark, sf_dir):
    """All 51 x 51 x 51 combinations."""
    return _grid(spark, sf_dir, 51).select(*_steps("tp", "fp", "fn", "tn", F.round("f1", R).alias("f1"), F.round("mean_latency_ms", 6).alias("mean_latency_ms")))


def budget_picks_full(spark, sf_dir):
    """The margins picked for each budget from all 51 x 51 x 51 combinations."""
    out = sweeps.budget_margins(_grid(spark, sf_dir, 51), BUDGETS)
    return out.select("budget", *_steps(F.round("f1", R).alias("f1"), F.round("mean_latency_ms", 6).alias("mean_latency_ms"), "n_ties", "n_feasible"))


def margin_ties_full(spark, sf_dir):
    out = sweeps.pick_margins(_grid(spark, sf_dir, 51), 250.0)
    return out.select(*_steps(F.round("f1", R).alias("f1"), "n_ties"))


def exit_composition_full(spark, sf_dir):
    return sweeps.margin_sweep(probabilities(spark, sf_dir), P, "y", DELTAS, aggregation="max").select(F.col("step").cast("long").alias("step"), "exit_0", "exit_1", "exit_2", "exit_3")


def outcome_cube_full(spark, sf_dir):
    out = sweeps.outcomes_by_exit(probabilities(spark, sf_dir), P, "y", DELTAS)
    return out.select(F.col("step").cast("long").alias("step"), F.col("exit_at").cast("long").alias("exit_at"), "outcome", "n")


def budget_picks(spark, sf_dir):
    out = sweeps.budget_picks(_grid(spark, sf_dir), BUDGETS)
    return out.select("budget", F.round("best_f1", R).alias("best_f1"), F.col("n_feasible").cast("long").alias("n_feasible"))


def margin_ties(spark, sf_dir):
    out = sweeps.pick_margins(_grid(spark, sf_dir), 250.0)
    return out.select(*(F.col(f"s{i}").cast("long").alias(f"s{i}") for i in range(3)), F.round("f1", R).alias("f1"), "n_ties")


def _steps_sql(n: int, how: str = "mean") -> str:
    m = f"(i * 0.5::DOUBLE / {n - 1})"
    out = [f"({c} <= 0.5::DOUBLE - {m} OR {c} >= 0.5::DOUBLE + {m})" for c in P]
    return f"""g AS (SELECT i FROM range(0, {n}) r(i)), d AS (
  SELECT *, {_agg(how)} AS value FROM p
), e AS (
  SELECT i, y, CASE WHEN {out[0]} THEN 0 WHEN {out[1]} THEN 1 WHEN {out[2]} THEN 2 ELSE 3 END AS ex,
    CASE WHEN {out[0]} THEN p_url >= 0.5 WHEN {out[1]} THEN p_content >= 0.5 WHEN {out[2]} THEN p_domain >= 0.5 ELSE coalesce(value >= 0.5, false) END AS v FROM d, g
)"""


_EXITS = ", ".join(f"count(*) FILTER (WHERE ex = {k}) AS exit_{k}" for k in range(4))
_GRID = f"""h AS (
  SELECT *, {_agg('mean')} AS value FROM p
), q AS (
  SELECT y, coalesce(value >= 0.5, false) AS f, p_url >= 0.5 AS v0, coalesce(p_content >= 0.5, false) AS v1, coalesce(p_domain >= 0.5, false) AS v2,
    len(list_filter(range(0, 11), lambda i: p_url <= 0.5::DOUBLE - i * 0.5::DOUBLE / 10 OR p_url >= 0.5::DOUBLE + i * 0.5::DOUBLE / 10)) AS k0,
    len(list_filter(range(0, 11), lambda i: coalesce(p_content <= 0.5::DOUBLE - i * 0.5::DOUBLE / 10 OR p_content >= 0.5::DOUBLE + i * 0.5::DOUBLE / 10, false))) AS k1,
    len(list_filter(range(0, 11), lambda i: coalesce(p_domain <= 0.5::DOUBLE - i * 0.5::DOUBLE / 10 OR p_domain >= 0.5::DOUBLE + i * 0.5::DOUBLE / 10, false))) AS k2 FROM h
), z AS (
  SELECT y, f, v0, v1, v2, k0, k1, k2, count(*) AS n FROM q GROUP BY ALL
), m AS (
  SELECT a.i AS s0, b.i AS s1, c.i AS s2, y, n, CASE WHEN k0 > a.i THEN v0 WHEN k1 > b.i THEN v1 WHEN k2 > c.i THEN v2 ELSE f END AS v,
    CASE WHEN k0 > a.i THEN 1.0 WHEN k1 > b.i THEN 51.0 ELSE 951.0 END AS ms FROM z, range(0, 11) a(i), range(0, 11) b(i), range(0, 11) c(i)
), o AS (
  SELECT s0, s1, s2, sum(n) FILTER (WHERE y AND v) AS tp0, sum(n) FILTER (WHERE NOT y AND v) AS fp0, sum(n) FILTER (WHERE y AND NOT v) AS fn0, sum(n) FILTER (WHERE NOT y AND NOT v) AS tn0, sum(n * ms) / sum(n) AS mean_latency_ms FROM m GROUP BY s0, s1, s2
), r AS (
  SELECT s0, s1, s2, coalesce(tp0, 0)::BIGINT AS tp, coalesce(fp0, 0)::BIGINT AS fp, coalesce(fn0, 0)::BIGINT AS fn, coalesce(tn0, 0)::BIGINT AS tn, CAST(mean_latency_ms AS DOUBLE) AS mean_latency_ms,
    coalesce(2.0 * tp0 / nullif(2 * coalesce(tp0, 0) + coalesce(fp0, 0) + coalesce(fn0, 0), 0), 0) AS f1 FROM o
)"""


def roc_auc(spark, sf_dir):
    out = metrics.ranking_metrics(probabilities(spark, sf_dir), "y", "p_url")
    return out.select(F.round("roc_auc", R).alias("roc_auc"), F.round("average_precision", R).alias("average_precision"), "n_pos", "n_neg")


def roc_curve(spark, sf_dir):
    out = metrics.roc_points(probabilities(spark, sf_dir), "y", "p_url")
    return out.select("threshold", F.round("fpr", R).alias("fpr"), F.round("tpr", R).alias("tpr"))


def full_pass_vs_single(spark, sf_dir):
    p = probabilities(spark, sf_dir)
    full = decide(p, Policy([Stage(s, s, 0.5) for s in P])).select("y", F.lit("full").alias("policy"), (F.col("probability") >= 0.5).alias("v"))
    single = p.select("y", F.lit("url").alias("policy"), (F.col("p_url") >= 0.5).alias("v"))
    cells = metrics.confusion(F.col("y"), F.col("v"))
    return _rounded(metrics.rates(full.unionByName(single).groupBy("policy").agg(*(c.alias(n) for n, c in cells.items()))), "policy")


def payload_verdicts(spark, sf_dir):
    done = decide(probabilities(spark, sf_dir), SHIPPED).withColumn("url", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    answer = done.select(payload(SHIPPED).alias("a")).select(F.col("a.verdict").alias("verdict"), F.col("a.decisionMode").alias("mode"), F.col("a.decidingStage").alias("stage"))
    return answer.groupBy("verdict", "mode", "stage").agg(F.count("*").alias("n"))


# timings


def _timings(spark, sf_dir):
    events = _read(spark, sf_dir, "events").where(F.col("value").isNotNull())
    outcome = F.when(F.col("event_type") == "error", "timeout").otherwise("ok")
    return events.select("event_id", "ts", F.col("user_id").alias("grp"), F.col("event_type").alias("stage"), outcome.alias("outcome"), F.col("value").alias("collect_ms"), (F.col("value") * 2).alias("total_ms"))


_TIMINGS = "x AS (SELECT event_id, ts, user_id AS grp, event_type AS stage, CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'ok' END AS outcome, value AS collect_ms, value * 2 AS total_ms FROM events WHERE value IS NOT NULL)"


def latency_summary(spark, sf_dir):
    out = metrics.latency_summary(_timings(spark, sf_dir), ["stage"], ["collect_ms", "total_ms"])
    return out


def latency_by_label_grouping_sets(spark, sf_dir):
    t = _timings(spark, sf_dir).withColumn("label", F.when(F.col("grp") % 2 == 0, "phish").otherwise("benign"))
    sets = t.groupingSets([[F.col("stage")], [F.col("stage"), F.col("label")]], "stage", "label").agg(F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.round(F.avg(F.when(F.col("outcome") == "ok", F.col("total_ms"))), 6).alias("mean_ms"))
    return sets.select("stage", F.coalesce("label", F.lit("all")).alias("label"), "n_ok", "mean_ms")


def outcome_rates(spark, sf_dir):
    t = _timings(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return metrics.outcome_rates(t, ["day"], ["ok", "timeout"])


def near_timeout_rate(spark, sf_dir):
    t = _timings(spark, sf_dir).where(F.col("outcome") == "ok")
    near = F.count_if(F.col("total_ms") >= 0.9 * 100.0)
    return t.groupBy("stage").agg(F.count("*").alias("n_ok"), near.alias("n_near"), F.round(100 * near / F.count("*"), 6).alias("pct_near"))


def mean_sd_by_key(spark, sf_dir):
    out = metrics.mean_sd(_timings(spark, sf_dir), ["stage"], ["collect_ms"])
    return out.select("stage", F.round("collect_ms_mean", 6).alias("mean_ms"), F.round("collect_ms_sd", 6).alias("sd_ms"))


def argmax_first_tie(spark, sf_dir):
    t = _timings(spark, sf_dir)
    return metrics.first_best(t, ["stage"], "collect_ms", "event_id").select("stage", "event_id", "collect_ms")


def nearest_threshold(spark, sf_dir):
    points = sweeps.threshold_sweep(probabilities(spark, sf_dir), "p_url", "y", [i / 100 for i in range(101)])
    near = metrics.pair(points.select("step", "threshold", "tp"), F.struct(-F.abs(F.col("threshold") - 0.333), -F.col("step")))
    return near.select(F.col("step").cast("long").alias("step"), "threshold", "tp")


def top_k_models(spark, sf_dir):
    out = metrics.mean_sd(_timings(spark, sf_dir), ["grp"], ["total_ms"])
    return out.orderBy(F.desc("total_ms_mean"), "grp").limit(5).select("grp", F.round("total_ms_mean", 6).alias("mean_ms"))


def failure_streak_stop(spark, sf_dir):
    log = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    kept = feeds.until_failures(log, F.col("event_type") != "error", 2, by="user_id")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def failure_streak_whole(spark, sf_dir):
    """All events as one log, up to the fourth error in a row."""
    log = _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    return feeds.until_failures(log, F.col("event_type") != "error", 4).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


# stores


def _changes(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "click", "phish").when(F.col("event_type") == "view", "benign").otherwise("")
    return e.select(F.col("user_id").cast("string").alias("url"), "ts", F.col("event_id").alias("seq"), label.alias("label"), F.when(F.col("event_type") == "error", "feed").otherwise("").alias("source"))


_CHANGES = "c AS (SELECT CAST(user_id AS VARCHAR) AS url, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'phish' WHEN 'view' THEN 'benign' ELSE '' END AS label, CASE WHEN event_type = 'error' THEN 'feed' ELSE '' END AS source FROM events)"


def url_upsert_first_last(spark, sf_dir):
    return store.upsert_urls(_changes(spark, sf_dir))


def url_upsert_incremental(spark, sf_dir):
    """The same table in two steps: the first half of the month, then the rest merged in."""
    c = _changes(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return store.merge_urls(store.upsert_urls(c.where(F.col("ts") < cut)), store.upsert_urls(c.where(F.col("ts") >= cut)))


def snapshot_upsert(spark, sf_dir):
    r = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("domain"), F.col("ts").alias("collected_at"), F.col("event_id").alias("seq"), "value")
    return store.snapshots(r).select("snapshot", "seq", "value")


def latest_reference(spark, sf_dir):
    r = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("domain"), F.col("event_type").alias("url"), F.col("ts").alias("collected_at"), F.col("event_id").alias("seq"))
    return store.latest_reference(r, "url")


def as_of_snapshots(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    urls = e.where("event_type = 'click'").select(F.col("user_id").alias("domain"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    snaps = e.where("event_type = 'view'").select(F.col("user_id").alias("domain"), F.col("ts").alias("collected_at"), F.col("event_id").alias("snap"))
    return store.as_of_snapshot(urls, snaps).select("id", F.coalesce("record.snap", F.lit(-1)).alias("snap"))


def incremental_since(spark, sf_dir):
    feed = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("verified_at"))
    marks = spark.range(1).select(F.lit("feed").alias("source"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz").alias("last_run_at"))
    return store.since(feed, marks, "feed").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.count("verified_at").alias("n_dated"))


def done_terms_anti(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    done = e.where("event_type = 'error'").groupBy("user_id").count().where("count > 12").select("user_id")
    return store.pending(e.select("user_id").distinct(), done, "user_id")


def _labelled_pages(spark, sf_dir):
    pages = url_parts(_read(spark, sf_dir, "pages").select("page_id", normalize_url("url").alias("url")))
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("toxic") == 1, "phish").when(F.col("toxic") == 0, "benign").alias("label"))
    return pages.join(labels, "page_id", "left").select("page_id", "url", F.col("registered_domain").alias("domain"), "host", "label")


_LABELLED = "lp AS (SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host, CASE toxic WHEN 1 THEN 'phish' WHEN 0 THEN 'benign' END AS label FROM pages LEFT JOIN labels ON doc_id = page_id)"


def labeled_lookup_left(spark, sf_dir):
    urls = _labelled_pages(spark, sf_dir).withColumn("record_ref", F.col("host"))
    snaps = _read(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "^[^:]+://([^/?#:]*)", 1)).alias("snapshot")).groupBy("snapshot").agg(F.count("*").alias("n")).where("n > 3")
    return store.with_records(store.labelled(urls), snaps).select("page_id", "label", F.coalesce("record.n", F.lit(0)).cast("long").alias("n"))


def count_labeled(spark, sf_dir):
    return store.count_labelled(_labelled_pages(spark, sf_dir), "host", 100)


def domain_any_phish_dedup(spark, sf_dir):
    return store.any_positive(_labelled_pages(spark, sf_dir).where(F.col("label").isNotNull()), "host", "label", "page_id").select("host", "page_id", "positive")


def keep_first_dedup(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("url"), F.col("c_custkey").alias("ordinal"), "c_nationkey")
    return feeds.keep_first(c, "url")


def concat_runs(spark, sf_dir):
    a = _read(spark, sf_dir, "customer").select(F.lit("customer").alias("run"), F.col("c_acctbal").alias("value"))
    b = _read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("run"), F.col("s_acctbal").alias("value"))
    return metrics.mean_sd(a.unionByName(b), ["run"], ["value"]).select("run", F.round("value_mean", 6).alias("value_mean"), F.round("value_sd", 6).alias("value_sd"))


def set_difference(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).distinct().exceptAll(_read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")).distinct())


def ranked_sample(spark, sf_dir):
    """A sample of 20 domains without replacement; it has this size whatever the table's."""
    d = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("domain"))
    return feeds.benign_urls(feeds.sample_domains(d, 20, 7)).agg(F.count_distinct("url").alias("n"), F.max("label").alias("label"))


# records


def _addresses(spark, sf_dir):
    key = F.col("s_suppkey")
    ip = F.concat_ws(".", (F.lit(10) + key % 4).cast("string"), (key % 7).cast("string"), (key % 251).cast("string"), (key % 13).cast("string"))
    return _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey", F.upper(F.substring("n_name", 1, 2)).alias("country"), ip.alias("ip"), (F.col("s_acctbal") / 100).alias("lat"), (F.col("s_nationkey") * 7.0).alias("lon"))


_ADDR = "ad AS (SELECT s_suppkey, n_regionkey, upper(substr(n_name, 1, 2)) AS country, concat_ws('.', 10 + s_suppkey % 4, s_suppkey % 7, s_suppkey % 251, s_suppkey % 13) AS ip, s_acctbal / 100 AS lat, s_nationkey * 7.0::DOUBLE AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def geo_features(spark, sf_dir):
    lists = _addresses(spark, sf_dir).groupBy("n_regionkey").agg(F.array_sort(F.collect_list("country")).alias("countries"), F.array_sort(F.collect_list("lat")).alias("latitudes"), F.array_sort(F.collect_list("lon")).alias("longitudes"))
    out = records.geo_features(lists)
    return out.select("n_regionkey", "geo_countries_count", "geo_continents_count", *(F.round(c, 6).alias(c) for c in ("geo_lat_stdev", "geo_mean_lat", "geo_min_lat", "geo_max_lat", "geo_lon_range", "geo_centroid_lat", "geo_estimated_area")))


def country_hash(spark, sf_dir):
    ids = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("ids"))
    return ids.select("n_regionkey", records.country_hash(F.col("ids"), 30).alias("hash"))


def ip_range_join(spark, sf_dir):
    ips = _addresses(spark, sf_dir).select("s_suppkey", "ip")
    networks = spark.range(4).select(((F.col("id") + 10) * 16777216).alias("start"), ((F.col("id") + 11) * 16777216 - 1).alias("end"), F.lit(8).alias("prefix_len"), F.concat(F.lit("net"), F.col("id")).alias("name"))
    finer = spark.range(3).select((F.lit(10 * 16777216).cast("long") + F.col("id") * 65536).alias("start"), (F.lit(10 * 16777216).cast("long") + (F.col("id") + 1) * 65536 - 1).alias("end"), F.lit(16).alias("prefix_len"), F.concat(F.lit("fine"), F.col("id")).alias("name"))
    return records.network_of(ips, networks.unionByName(finer)).groupBy("name").agg(F.count("*").alias("n"))


def ip_entropy(spark, sf_dir):
    lists = _addresses(spark, sf_dir).groupBy("n_regionkey").agg(F.collect_list(F.substring_index("ip", ".", 2)).alias("prefixes"))
    return lists.select("n_regionkey", F.round(value_entropy("prefixes"), 6).alias("entropy"))


def rdap_age_features(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    text = lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("email"))
    rows = o.select(
        "o_orderkey",
        F.col("o_orderdate").cast("timestamp").alias("rdap_registration_date"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 400 DAYS")).alias("rdap_expiration_date"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 36 HOURS")).alias("rdap_last_changed_date"),
        F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.lit(False).alias("delegationSigned"))).alias("rdap_dnssec"),
        F.create_map(F.lit("registrar"), F.array(text(F.col("o_orderpriority")))).alias("rdap_entities"),
    )
    out = records.rdap_domain_features(rows, F.lit("1998-12-01 00:00:00").cast("timestamp"))
    names = ("rdap_registration_period", "rdap_domain_age", "rdap_time_from_last_change", "rdap_domain_active_time")
    return out.select("o_orderkey", *(F.round(n, 6).alias(n) for n in names), "rdap_has_dnssec", "rdap_registrar_name_len")


def age_labels(spark, sf_dir):
    days = F.col("p_partkey") % 1500
    return _read(spark, sf_dir, "part").select("p_partkey", age_label(days).alias("label"))


def dns_ttl_features(spark, sf_dir):
    ttls = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list((F.col("l_quantity") * 20).cast("int"))).alias("ttls"))
    low, mid = (F.size(F.filter("ttls", test)).cast("double") / F.size("ttls") for test in (lambda t: t < 101, lambda t: (t >= 101) & (t < 501)))
    return ttls.select("l_orderkey", F.round(mean("ttls"), 6).alias("ttl_avg"), F.round(low, 6).alias("ttl_low"), F.round(mid, 6).alias("ttl_mid"), F.size(F.array_distinct("ttls")).cast("long").alias("n_distinct"))


# models


def group_kfold_disjoint(spark, sf_dir):
    rows = _labelled_pages(spark, sf_dir).where(F.col("label").isNotNull()).withColumn("y", F.col("label") == "phish")
    folds = models.group_folds(rows, "host", "y", 5)
    return folds.groupBy("host").agg(F.count_distinct("fold").alias("n_folds"), F.count("*").alias("n"))


def nested_split_leaks(spark, sf_dir):
    rows = _labelled_pages(spark, sf_dir).where(F.col("label").isNotNull()).withColumn("y", F.col("label") == "phish")
    parts = models.nested_split(rows, "host", "y", 0)
    return parts.agg(F.count("*").alias("n"), F.count_distinct("host").alias("n_hosts")).crossJoin(models.leaks(parts, "host").agg(F.count("*").alias("n_leaks")))  # one row each


def align_features(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return models.align(docs, ["n_chars", "source", "absent"], ["doc_id"])


def label_map_sum(spark, sf_dir):
    p = probabilities(spark, sf_dir)
    summed = models.sum_by_label(F.array(*(F.lit(x) for x in ("bad", "worse", "fine"))), F.array(F.col("p_url"), F.coalesce("p_content", F.lit(0.0)), F.coalesce("p_domain", F.lit(0.0))), {"bad": "phish", "worse": "phish", "fine": "benign"})
    return p.select("l_orderkey", "l_linenumber", summed.alias("m")).select("l_orderkey", "l_linenumber", F.round(F.try_element_at("m", F.lit("phish")), R).alias("phish"), F.round(F.try_element_at("m", F.lit("benign")), R).alias("benign"))


def predict_scores(spark, sf_dir):
    """A stage's model trained on URL features and applied to all pages."""
    from harrier.operators.url_features import url_features

    pages = url_parts(_read(spark, sf_dir, "pages").select("page_id", normalize_url("url").alias("url")))
    features = url_features(pages)
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("y"))
    columns = ["domain_length", "subdomain_length", "path_length", "path_digit_count", "raw_word_count", "average_word_length", "/", "?"]
    model, _ = models.train(features.join(labels, "page_id"), columns, "y", "logistic_regression")
    return models.predict(features, model, columns, ["page_id"])


OPEN_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "days", "l_suppkey", "l_partkey"]


def _open_lines(spark, sf_dir):
    """Lines, whether each is still open, and whether its order is held out (a quarter are)."""
    lines = _read(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_linestatus") == "O").cast("int")).withColumn("days", F.unix_date(F.to_date("l_shipdate")))
    return lines.withColumn("held_out", F.pmod(F.crc32(F.col("l_orderkey").cast("string")), F.lit(4)) == 2)


def extra_trees_scores(spark, sf_dir):
    """Whether a line is still open, by randomised trees learnt from all orders but those held out, over all lines."""
    lines = _open_lines(spark, sf_dir)
    model = extra_trees.train(lines.where(~F.col("held_out")), OPEN_LINE_COLUMNS, "y", n_trees=20, depth=8)
    return extra_trees.predict(lines, model, ["l_orderkey", "l_linenumber", "held_out", "y"])


def boosted_scores(spark, sf_dir):
    """Whether a line is still open, by boosted trees learnt from all orders but those held out, over all lines."""
    lines = _open_lines(spark, sf_dir)
    model = boosting.train(lines.where(~F.col("held_out")), OPEN_LINE_COLUMNS, "y", "l_orderkey", n_trees=10, depth=4, rate=0.3)
    return boosting.predict(lines, model, ["l_orderkey", "l_linenumber", "held_out", "y"])


def nearest_vectors(spark, sf_dir):
    base = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    queries = base.orderBy("id").limit(20)
    return models.nearest_vectors(queries, base, 5).select("query", F.col("rank").cast("long").alias("rank"), "neighbour")


def nearest_vectors_full(spark, sf_dir):
    """The five nearest of all rows for every row whose id is divisible by 50."""
    base = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = models.nearest_in_blocks(base.where("id % 50 = 0"), base, 5)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "neighbour")


QUERIES = {
    "cascade_two_sided": _cascade(SHIPPED),
    "cascade_max": _cascade(Policy(SHIPPED.stages, aggregation="max")),
    "cascade_median": _cascade(Policy(SHIPPED.stages, aggregation="median")),
    "cascade_default_margin": _cascade(Policy([Stage(s, s) for s in P])),
    "cascade_stage_counts": cascade_stage_counts,
    "cascade_one_sided": cascade_one_sided,
    "cascade_one_sided_forced": cascade_one_sided_forced,
    "confusion_metrics": confusion_metrics,
    "class_report": class_report,
    "delta_sweep": delta_sweep,
    "exit_composition": exit_composition,
    "outcome_cube": outcome_cube,
    "threshold_sweep": threshold_sweep,
    "margin_grid3": margin_grid3,
    "margin_grid_full": margin_grid_full,
    "budget_picks_full": budget_picks_full,
    "margin_ties_full": margin_ties_full,
    "exit_composition_full": exit_composition_full,
    "outcome_cube_full": outcome_cube_full,
    "budget_picks": budget_picks,
    "margin_ties": margin_ties,
    "roc_auc": roc_auc,
    "roc_curve": roc_curve,
    "full_pass_vs_single": full_pass_vs_single,
    "payload_verdicts": payload_verdicts,
    "latency_summary": latency_summary,
    "extra_trees_scores": extra_trees_scores,
    "boosted_scores": boosted_scores,
    "latency_by_label_grouping_sets": latency_by_label_grouping_sets,
    "outcome_rates": outcome_rates,
    "near_timeout_rate": near_timeout_rate,
    "mean_sd_by_key": mean_sd_by_key,
    "argmax_first_tie": argmax_first_tie,
    "nearest_threshold": nearest_threshold,
    "top_k_models": top_k_models,
    "failure_streak_stop": failure_streak_stop,
    "failure_streak_whole": failure_streak_whole,
    "url_upsert_first_last": url_upsert_first_last,
    "url_upsert_incremental": url_upsert_incremental,
    "snapshot_upsert": snapshot_upsert,
    "latest_reference": latest_reference,
    "as_of_snapshots": as_of_snapshots,
    "incremental_since": incremental_since,
    "done_terms_anti": done_terms_anti,
    "labeled_lookup_left": labeled_lookup_left,
    "count_labeled": count_labeled,
    "domain_any_phish_dedup": domain_any_phish_dedup,
    "keep_first_dedup": keep_first_dedup,
    "concat_runs": concat_runs,
    "set_difference": set_difference,
    "ranked_sample": ranked_sample,
    "geo_features": geo_features,
    "country_hash": country_hash,
    "ip_range_join": ip_range_join,
    "ip_entropy": ip_entropy,
    "rdap_age_features": rdap_age_features,
    "age_labels": age_labels,
    "dns_ttl_features": dns_ttl_features,
    "group_kfold_disjoint": group_kfold_disjoint,
    "nested_split_leaks": nested_split_leaks,
    "align_features": align_features,
    "label_map_sum": label_map_sum,
    "predict_scores": predict_scores,
    "nearest_vectors": nearest_vectors,
    "nearest_vectors_full": nearest_vectors_full,
}

_M = (0.49, 0.28, 0.10)
_ONE = f"d AS (SELECT *, CASE WHEN p_url >= 0.3 THEN 0 WHEN p_content >= 0.3 THEN 1 WHEN p_domain >= 0.3 THEN 2 END AS ex, {_agg('mean')} AS value FROM p), e AS (SELECT *, CASE ex WHEN 0 THEN p_url WHEN 1 THEN p_content WHEN 2 THEN p_domain END AS q FROM d)"
_UPSERT = "SELECT url, min(ts) AS created_at, max(ts) AS updated_at, nullif(arg_max(label, (ts, seq)) FILTER (WHERE label <> '' OR source <> ''), '') AS label, nullif(arg_max(source, (ts, seq)) FILTER (WHERE label <> '' OR source <> ''), '') AS source FROM c GROUP BY url"
_TIME = "CAST({} AS BIGINT) AS n"

SQL = {
    "cascade_two_sided": f"WITH {_PROB}, {_decide_sql(_M, 'mean')} {_DECIDED}",
    "cascade_max": f"WITH {_PROB}, {_decide_sql(_M, 'max')} {_DECIDED}",
    "cascade_median": f"WITH {_PROB}, {_decide_sql(_M, 'median')} {_DECIDED}",
    "cascade_default_margin": f"WITH {_PROB}, {_decide_sql((0.4, 0.4, 0.4), 'mean')} {_DECIDED}",
    "cascade_stage_counts": f"WITH {_PROB}, {_decide_sql(_M, 'mean')} SELECT stage_id, ex IS NOT NULL AS exited, CASE WHEN probability >= 0.5 THEN 'phish' ELSE 'benign' END AS decision, count(*) AS n FROM (SELECT *, CASE coalesce(ex, CASE WHEN abs(p_url - value) <= least(coalesce(abs(p_content - value), 9), coalesce(abs(p_domain - value), 9)) THEN 1 WHEN coalesce(abs(p_content - value), 9) <= coalesce(abs(p_domain - value), 9) THEN 2 ELSE 3 END) WHEN 1 THEN 'url' WHEN 2 THEN 'content' ELSE 'domain' END AS stage_id FROM e) GROUP BY ALL",
    "cascade_one_sided": f"WITH {_PROB}, {_ONE} SELECT ex IS NOT NULL AS exited, coalesce(q, value) >= 0.5 AS positive, CAST(coalesce(ex, -1) AS BIGINT) AS exit_at, count(*) AS n FROM e GROUP BY ALL",
    "cascade_one_sided_forced": f"WITH {_PROB}, {_ONE} SELECT ex IS NOT NULL AS exited, CASE WHEN ex IS NOT NULL THEN true ELSE value >= 0.5 END AS positive, count(*) AS n FROM e GROUP BY ALL",
    "confusion_metrics": f"WITH {_PROB}, {_decide_sql(_M, 'mean')}, x AS (SELECT {_CELLS} FROM (SELECT y, probability >= 0.5 AS v FROM e)) SELECT {_RATES} FROM x",
    "class_report": f"WITH {_PROB}, {_decide_sql(_M, 'mean')}, t AS (SELECT CASE WHEN y THEN 'phish' ELSE 'benign' END AS t, CASE WHEN probability >= 0.5 THEN 'phish' ELSE 'benign' END AS d FROM e), c AS (SELECT k AS class, count(*) FILTER (WHERE t = k AND d = k) AS hit, count(*) FILTER (WHERE t = k) AS support, count(*) FILTER (WHERE d = k) AS given FROM t, (SELECT unnest(['phish', 'benign']) AS k) GROUP BY k), r AS (SELECT class, hit / given AS precision, hit / support AS recall, 2.0 * hit / (given + support) AS f1, support FROM c) SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM r UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM r",
    "delta_sweep": f"WITH {_PROB}, {_steps_sql(51)}, x AS (SELECT i AS step, {_CELLS}, {_EXITS}, avg(CASE ex WHEN 0 THEN 1.0 WHEN 1 THEN 51.0 ELSE 951.0 END) AS ms FROM e GROUP BY i) SELECT step, tp, fp, fn, tn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, exit_0, exit_1, exit_2, exit_3, round(ms, 6) AS mean_latency_ms FROM x",
    "exit_composition": f"WITH {_PROB}, {_steps_sql(11, 'max')} SELECT i AS step, {_EXITS} FROM e GROUP BY i",
    "outcome_cube": f"WITH {_PROB}, {_steps_sql(11)}, x AS (SELECT i AS step, ex AS exit_at, CASE WHEN y AND v THEN 'TP' WHEN v THEN 'FP' WHEN y THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM e GROUP BY ALL) SELECT g.i AS step, a.k AS exit_at, o.outcome, coalesce(n, 0) AS n FROM range(0, 11) g(i) CROSS JOIN range(0, 4) a(k) CROSS JOIN (SELECT unnest(['TP', 'FP', 'FN', 'TN']) AS outcome) o LEFT JOIN x ON x.step = g.i AND x.exit_at = a.k AND x.outcome = o.outcome",
    "exit_composition_full": f"WITH {_PROB}, {_steps_sql(51, 'max')} SELECT i AS step, {_EXITS} FROM e GROUP BY i",
    "outcome_cube_full": f"WITH {_PROB}, {_steps_sql(51)}, x AS (SELECT i AS step, ex AS exit_at, CASE WHEN y AND v THEN 'TP' WHEN v THEN 'FP' WHEN y THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM e GROUP BY ALL) SELECT g.i AS step, a.k AS exit_at, o.outcome, coalesce(n, 0) AS n FROM range(0, 51) g(i) CROSS JOIN range(0, 4) a(k) CROSS JOIN (SELECT unnest(['TP', 'FP', 'FN', 'TN']) AS outcome) o LEFT JOIN x ON x.step = g.i AND x.exit_at = a.k AND x.outcome = o.outcome",
    "threshold_sweep": f"WITH {_PROB}, x AS (SELECT i AS step, {_CELLS} FROM (SELECT i, y, p_url >= i::DOUBLE / 100 AS v FROM p, range(0, 101) r(i)) GROUP BY i) SELECT step, {_RATES} FROM x",
    "margin_grid3": f"WITH {_PROB}, {_GRID} SELECT s0, s1, s2, tp, fp, fn, tn, round(mean_latency_ms, 6) AS mean_latency_ms FROM r",
    "budget_picks": f"WITH {_PROB}, {_GRID} SELECT budget, round(max(f1), 9) AS best_f1, count(*) AS n_feasible FROM r JOIN (SELECT unnest([50.0, 100.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0])::DOUBLE AS budget) ON mean_latency_ms <= budget GROUP BY budget",
    "margin_ties": f"WITH {_PROB}, {_GRID}, b AS (SELECT *, max(f1) OVER () AS best FROM r WHERE mean_latency_ms <= 250), t AS (SELECT *, count(*) OVER () AS n_ties FROM b WHERE abs(f1 - best) <= 1e-8 + 1e-5 * abs(best)) SELECT s0, s1, s2, round(f1, 9) AS f1, n_ties FROM t ORDER BY mean_latency_ms, s0, s1, s2 LIMIT 1",
    "roc_auc": f"WITH {_PROB}, s AS (SELECT p_url AS s, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM p GROUP BY p_url), c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM s) SELECT round(sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)), 9) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(np), 9) AS average_precision, CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg FROM c",
    "roc_curve": f"WITH {_PROB}, s AS (SELECT p_url AS s, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM p GROUP BY p_url) SELECT s AS threshold, round(sum(neg) OVER (ORDER BY s DESC) / sum(neg) OVER (), 9) AS fpr, round(sum(pos) OVER (ORDER BY s DESC) / sum(pos) OVER (), 9) AS tpr FROM s",
    "full_pass_vs_single": f"WITH {_PROB}, f AS (SELECT y, CASE WHEN p_url IN (0, 1) THEN p_url WHEN p_content IN (0, 1) THEN p_content WHEN p_domain IN (0, 1) THEN p_domain ELSE {_agg('mean')} END AS q, p_url FROM p), x AS (SELECT policy, {_CELLS} FROM (SELECT 'full' AS policy, y, q >= 0.5 AS v FROM f UNION ALL SELECT 'url', y, p_url >= 0.5 FROM f) GROUP BY policy) SELECT policy, {_RATES} FROM x",
    "latency_summary": f"WITH {_TIMINGS}, l AS (SELECT stage, outcome, 'collect_ms' AS phase, collect_ms AS ms FROM x UNION ALL SELECT stage, outcome, 'total_ms', total_ms FROM x) SELECT stage, phase, count(ms) FILTER (WHERE outcome = 'ok') AS n, round(avg(ms) FILTER (WHERE outcome = 'ok'), 2) AS mean_ms, round(quantile_cont(ms, 0.5) FILTER (WHERE outcome = 'ok'), 2) AS median_ms, round(quantile_cont(ms, 0.95) FILTER (WHERE outcome = 'ok'), 2) AS p95_ms, round(min(ms) FILTER (WHERE outcome = 'ok'), 2) AS min_ms, round(max(ms) FILTER (WHERE outcome = 'ok'), 2) AS max_ms, count(*) AS n_total FROM l GROUP BY stage, phase",
    "latency_by_label_grouping_sets": f"WITH {_TIMINGS}, y AS (SELECT *, CASE WHEN grp % 2 = 0 THEN 'phish' ELSE 'benign' END AS label FROM x) SELECT stage, coalesce(label, 'all') AS label, count(*) FILTER (WHERE outcome = 'ok') AS n_ok, round(avg(total_ms) FILTER (WHERE outcome = 'ok'), 6) AS mean_ms FROM y GROUP BY GROUPING SETS ((stage), (stage, label))",
    "outcome_rates": f"WITH {_TIMINGS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_total, count(*) FILTER (WHERE outcome = 'ok') AS n_ok, round(100 * count(*) FILTER (WHERE outcome = 'ok') / count(*), 1) AS pct_ok, count(*) FILTER (WHERE outcome = 'timeout') AS n_timeout, round(100 * count(*) FILTER (WHERE outcome = 'timeout') / count(*), 1) AS pct_timeout FROM x GROUP BY 1",
    "near_timeout_rate": f"WITH {_TIMINGS} SELECT stage, count(*) AS n_ok, count(*) FILTER (WHERE total_ms >= 90) AS n_near, round(100 * count(*) FILTER (WHERE total_ms >= 90) / count(*), 6) AS pct_near FROM x WHERE outcome = 'ok' GROUP BY stage",
    "mean_sd_by_key": f"WITH {_TIMINGS} SELECT stage, round(avg(collect_ms), 6) AS mean_ms, round(stddev_samp(collect_ms), 6) AS sd_ms FROM x GROUP BY stage",
    "argmax_first_tie": f"WITH {_TIMINGS} SELECT stage, event_id, collect_ms FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY collect_ms DESC, event_id) AS r FROM x) WHERE r = 1",
    "nearest_threshold": f"WITH {_PROB} SELECT CAST(33 AS BIGINT) AS step, 0.33::DOUBLE AS threshold, count(*) FILTER (WHERE y AND p_url >= 33::DOUBLE / 100) AS tp FROM p",
    "top_k_models": f"WITH {_TIMINGS} SELECT grp, round(avg(total_ms), 6) AS mean_ms FROM x GROUP BY grp ORDER BY avg(total_ms) DESC, grp LIMIT 5",
    "failure_streak_stop": "WITH a AS (SELECT user_id, event_id, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), s AS (SELECT user_id, min(event_id) FILTER (WHERE bad AND before) AS stop FROM a GROUP BY user_id) SELECT user_id, count(*) AS n, max(event_id) AS last FROM events JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop GROUP BY user_id",
    "failure_streak_whole": "WITH a AS (SELECT event_id, event_type = 'error' AS bad, count(*) FILTER (WHERE event_type <> 'error') OVER (ORDER BY event_id) AS g FROM events), b AS (SELECT event_id, bad, count(*) FILTER (WHERE bad) OVER (PARTITION BY g ORDER BY event_id) AS run FROM a), s AS (SELECT min(event_id) FILTER (WHERE bad AND run >= 4) AS stop FROM b) SELECT count(*) AS n, max(event_id) AS last FROM events, s WHERE stop IS NULL OR event_id <= stop",
    "url_upsert_first_last": f"WITH {_CHANGES} {_UPSERT}",
    "url_upsert_incremental": f"WITH {_CHANGES} {_UPSERT}",
    "snapshot_upsert": "SELECT snapshot, seq, value FROM (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS snapshot, event_id AS seq, value, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "latest_reference": "SELECT event_type AS url, arg_max(user_id || '|' || strftime(ts, '%Y-%m-%d'), (ts, event_id)) AS record_ref FROM events GROUP BY event_type",
    "as_of_snapshots": "SELECT u.event_id AS id, coalesce(arg_max(s.event_id, s.ts), -1) AS snap FROM events u LEFT JOIN events s ON s.user_id = u.user_id AND s.ts <= u.ts AND s.event_type = 'view' WHERE u.event_type = 'click' GROUP BY u.event_id",
    "incremental_since": "SELECT count(*) AS n, min(event_id) AS first, count(*) FILTER (WHERE event_type <> 'error') AS n_dated FROM events WHERE event_type = 'error' OR ts >= TIMESTAMP '2024-01-20 12:00:00'",
    "done_terms_anti": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 12)",
    "labeled_lookup_left": f"WITH {_LABELLED}, s AS (SELECT host, count(*) AS n FROM lp GROUP BY host HAVING count(*) > 3) SELECT page_id, label, coalesce(n, 0) AS n FROM lp LEFT JOIN s USING (host) WHERE label IS NOT NULL",
    "count_labeled": f"WITH {_LABELLED} SELECT least(count(*), 100) AS n FROM lp WHERE label IS NOT NULL",
    "domain_any_phish_dedup": f"WITH {_LABELLED} SELECT host, min(page_id) AS page_id, bool_or(label = 'phish') AS positive FROM lp WHERE label IS NOT NULL GROUP BY host",
    "keep_first_dedup": "SELECT url, ordinal, c_nationkey FROM (SELECT c_mktsegment AS url, c_custkey AS ordinal, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1",
    "concat_runs": "SELECT run, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_sd FROM (SELECT 'customer' AS run, c_acctbal AS value FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY run",
    "set_difference": "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "ranked_sample": "SELECT least(count(DISTINCT c_name), 20) AS n, 'benign' AS label FROM customer",
    "geo_features": f"WITH {_ADDR} SELECT n_regionkey, count(DISTINCT country) AS geo_countries_count, CAST(1 AS BIGINT) AS geo_continents_count, round(stddev_pop(lat), 6) AS geo_lat_stdev, round(avg(lat), 6) AS geo_mean_lat, round(min(lat), 6) AS geo_min_lat, round(max(lat), 6) AS geo_max_lat, round(max(lon) - min(lon), 6) AS geo_lon_range, round(min(lat) + max(lat) / 2, 6) AS geo_centroid_lat, round((max(lat) - min(lat)) * (max(lon) - min(lon)), 6) AS geo_estimated_area FROM ad GROUP BY n_regionkey",
    "country_hash": "WITH i AS (SELECT n_regionkey, list_sort(list_distinct(list(n_nationkey))) AS ids FROM nation GROUP BY n_regionkey) SELECT n_regionkey, CAST(list_reduce(list_concat([0::BIGINT], ids), lambda a, x: CASE WHEN a + x > 30 THEN (a + x) * 2 ELSE a + x END) % 2147483647 AS BIGINT) AS hash FROM i",
    "ip_range_join": f"WITH {_ADDR}, q AS (SELECT string_split(ip, '.') AS o FROM ad) SELECT CASE WHEN o[1] = '10' AND CAST(o[2] AS INT) < 3 THEN 'fine' || o[2] ELSE 'net' || (CAST(o[1] AS INT) - 10) END AS name, count(*) AS n FROM q GROUP BY 1",
    "ip_entropy": f"WITH {_ADDR}, q AS (SELECT n_regionkey, string_split(ip, '.')[1] || '.' || string_split(ip, '.')[2] AS p, count(*) AS n FROM ad GROUP BY ALL) SELECT n_regionkey, abs(round(sum(n / t * log2(n / t)), 6)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY n_regionkey) AS t FROM q) GROUP BY n_regionkey",
    "rdap_age_features": "WITH x AS (SELECT o_orderkey, o_orderpriority, o_orderdate AS s, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 400 DAY END AS e, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 36 HOUR END AS c, TIMESTAMP '1998-12-01' AS n FROM orders) SELECT o_orderkey, round(CASE WHEN e IS NOT NULL THEN greatest(0.0, (epoch_us(e) - epoch_us(s)) / 86400e6) END, 6) AS rdap_registration_period, round(greatest(0.0, (epoch_us(n) - epoch_us(s)) / 86400e6), 6) AS rdap_domain_age, round(CASE WHEN c IS NOT NULL THEN greatest(0.0, (epoch_us(n) - epoch_us(c)) / 86400e6) END, 6) AS rdap_time_from_last_change, round(greatest(0.0, (epoch_us(CASE WHEN e IS NULL OR e > n THEN n ELSE e END) - epoch_us(s)) / 86400e6), 6) AS rdap_domain_active_time, o_orderkey % 2 = 0 AS rdap_has_dnssec, CAST(length(o_orderpriority) AS BIGINT) AS rdap_registrar_name_len FROM x",
    "age_labels": "SELECT p_partkey, CASE WHEN d < 60 THEN d || ' days' WHEN d < 730 THEN CAST(round_even(d / 30, 0) AS BIGINT) || ' months' ELSE printf('%.1f years', d / 365) END AS label FROM (SELECT p_partkey, p_partkey % 1500 AS d FROM part)",
    "dns_ttl_features": "SELECT l_orderkey, round(avg(t), 6) AS ttl_avg, round(count(*) FILTER (WHERE t < 101) / count(*), 6) AS ttl_low, round(count(*) FILTER (WHERE t >= 101 AND t < 501) / count(*), 6) AS ttl_mid, count(DISTINCT t) AS n_distinct FROM (SELECT l_orderkey, CAST(l_quantity * 20 AS INT) AS t FROM lineitem) GROUP BY l_orderkey",
    "group_kfold_disjoint": f"WITH {_LABELLED} SELECT host, CAST(1 AS BIGINT) AS n_folds, count(*) AS n FROM lp WHERE label IS NOT NULL GROUP BY host",
    "nested_split_leaks": f"WITH {_LABELLED} SELECT count(*) AS n, count(DISTINCT host) AS n_hosts, CAST(0 AS BIGINT) AS n_leaks FROM lp WHERE label IS NOT NULL",
    "align_features": "SELECT doc_id, coalesce(CAST(n_chars AS DOUBLE), 0) AS n_chars, coalesce(TRY_CAST(source AS DOUBLE), 0) AS source, 0::DOUBLE AS absent FROM documents",
    "label_map_sum": f"WITH {_PROB} SELECT l_orderkey, l_linenumber, round(p_url + coalesce(p_content, 0), 9) AS phish, round(coalesce(p_domain, 0), 9) AS benign FROM p",
    "nearest_vectors": "WITH q AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 20), d AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM q, embeddings e WHERE e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM d) SELECT query, rank, neighbour FROM r WHERE rank <= 5",
    "nearest_vectors_full": "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM q, embeddings e WHERE e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM d) SELECT query, rank, neighbour FROM r WHERE rank <= 5",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL features and markup of all pages, a fixed score for each stage, the cascade, and exits by verdict."""
    from harrier.operators.html_features import tag_features, tags
    from harrier.operators.url_features import url_features

    pages = url_features(url_parts(_read(spark, sf_dir, "pages").withColumn("url", normalize_url("url"))))
    links = tag_features("tags")["html_num_of_anchors"]
    scored = pages.withColumn("tags", tags("html")).select(
        "page_id",
        (1 / (1 + F.exp(4.0 - 0.2 * F.col("path_length") - 0.3 * F.col("path_digit_count")))).alias("p_url"),
        (1 / (1 + F.exp(2.0 - 0.1 * links))).alias("p_content"),
    )
    policy = Policy([Stage("url", "p_url", 0.49), Stage("content", "p_content", 0.28)])
    return decide(scored, policy).groupBy("stage_id", "exited", "decision").agg(F.count("*").alias("n"))
