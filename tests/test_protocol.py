"""Registration answers and the evaluation protocol."""

import json
import random

from pyspark.sql import functions as F

from harrier.plans import evaluation, sweeps
from harrier.sources import registration


def test_contacts(spark):
    card = lambda *rows: json.dumps(["vcard", [["version", {}, "text", "4.0"], *rows]])
    entities = [
        (["Registrar"], card(["fn", {}, "text", "Old"], ["fn", {}, "text", "Reg"], ["fn", {}, "text", ["list"]], ["email", {"a": 1}, "text", "r@x"])),
        (["technical administrative", "registrant"], card(["fn", {}, "text", "Ann"])),
        (["registrant"], card(["fn", {}, "text", ""])),
        (None, card(["fn", {}, "text", "Nobody"])),
        (["registrar"], None),
    ]
    df = spark.createDataFrame([(1, entities), (2, None), (3, [])], "id int, e array<struct<roles: array<string>, vcardArray: string>>")
    got = {r.id: r.m for r in df.select("id", registration.contacts(F.col("e")).alias("m")).collect()}
    assert {k: [tuple(p) for p in v] for k, v in got[1].items()} == {"registrar": [("Reg", "r@x")], "registrant": [("Ann", None)], "administrative": [("Ann", None)]}
    assert got[2] == {} == got[3]


def test_small_readers(spark):
    df = spark.createDataFrame([({"a": [None, "x"], "b": ["y"]}, "www.site.co.uk", ["V=SPF1 -all", "k=1; DKIM"], [("1.1.1.1", "A"), ("::1", "AAAA"), ("1.1.1.1", "MX")])], "m map<string, array<string>>, h string, t array<string>, f array<struct<ip: string, source: string>>")
    r = df.select(
        registration.first_present(F.col("m"), ["z", "a", "b"]).alias("null_first"),
        registration.first_present(F.col("m"), ["z", "b"]).alias("b"),
        registration.known_suffix(F.col("h"), ["uk", "co.uk"]).alias("two"),
        registration.known_suffix(F.col("h"), ["uk"]).alias("one"),
        registration.known_suffix(F.col("h"), ["com"]).alias("none"),
        registration.text_flags(F.col("t")).alias("flags"),
        registration.placed_authority(F.lit("a.b.c"), F.lit("b.c"), F.lit("soa")).alias("apart"),
        registration.placed_authority(F.lit("b.c"), F.lit(None), F.lit("soa")).alias("same"),
        registration.first_sources(F.col("f")).alias("sources"),
        registration.ip_version(F.lit("::1"), F.lit(None).cast("int")).alias("v"),
    ).first()
    assert (r.null_first, r.b, r.two, r.one, r.none, r.v) == (None, "y", "co.uk", "uk", None, 6)
    assert tuple(r.flags) == (True, True, False) and tuple(r.apart) == (None, "soa") and tuple(r.same) == ("soa", None)
    assert [tuple(x) for x in r.sources] == [("1.1.1.1", "A"), ("::1", "AAAA")]


def test_outcomes(spark):
    rows = [(None, None, "ok"), ("collect", "ReadTimeout: x", "timeout"), ("collect", "SSLError", "unreachable"), ("collect", "ValueError", "error"), ("extract", "x", "feature_error"), ("predict", "x", "model_error")]
    df = spark.createDataFrame(rows, "phase string, error string, want string")
    assert df.where(evaluation.outcome(F.col("phase"), F.col("error")) != F.col("want")).count() == 0
    flags = spark.createDataFrame([(89.0, 200, "x"), (90.0, 404, "x"), (None, None, "x"), (1.0, 301, "")], "ms double, status int, html string")
    got = flags.select(evaluation.near_timeout(F.col("ms"), F.lit(100.0)), evaluation.degraded_content(F.col("status"), F.col("html"))).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True), (False, True), (False, True)]


def test_protocol(spark):
    rng = random.Random(4)
    rows = [(i, f"g{i % 60}", y, y + rng.gauss(0, 1.2), y + rng.gauss(0, 0.6), y + rng.gauss(0, 0.3)) for i in range(600) for y in [int(i % 60 < 25)]]
    df = spark.createDataFrame(rows, "id int, grp string, y int, a double, b double, c double")
    out = evaluation.run_once(df, {"url": ["a"], "content": ["a", "b"], "domain": ["c"]}, "y", "grp", "id", ["logistic_regression", "decision_tree"], {"url": 1.0, "content": 50.0, "domain": 900.0}, 7, 0, sweeps.margins(6), [60.0, 400.0, 2000.0])
    systems = {r.system: r for r in out["systems"].collect()}
    assert len(systems) == 6 and systems["domain-only"].f1 > systems["url-only"].f1
    n = out["probabilities"].count()
    assert all(s.tp + s.fp + s.fn + s.tn == n for s in systems.values())
    assert systems["url-only"].mean_latency_ms == 1.0
    picks = {r.budget: r for r in out["picks"].collect()}
    assert set(picks) == {60.0, 400.0, 2000.0} and all(0 <= p.percentile <= 1 for p in picks.values())
    assert out["zoo"].where("selected").count() == 3 and out["sweep"].count() == 6


def test_a_card_is_parsed_once(spark, sf):
    """The plan parses a card in one place (it did in one for each role, field and use), and rows are dealt over the cores."""
    from harrier.queries.inventory import card_contacts

    plan = card_contacts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") == 1, plan.count("get_json_object(")
    assert plan.count("Repartition") == 1
