"""The library's own operators: hand-made rows, identities, and every query against its SQL."""

import datetime
import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from harrier.functions import text
from harrier.functions.urls import host_parts, normalize_url, suffix_candidates, url_parts
from harrier.operators import domain_features as records
from harrier.operators import explain
from harrier.operators.html_features import html_features
from harrier.operators.tls_features import tls_features
from harrier.operators.url_features import TransitionModel, WordLists, train_transitions, url_features
from harrier.plans import models, sweeps
from harrier.plans.cascade import Policy, Stage, decide, staged
from harrier.queries import catalogue
from harrier.sources import feeds, store
from harrier.streaming import incremental


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        path = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    keys = sorted(got.columns)
    rows = lambda d: d[keys].astype(str).sort_values(keys).reset_index(drop=True)
    assert rows(got).equals(rows(want))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_hashes_and_entropy(spark):
    words = ["", "a", "aa", "example", "Ärger", "x" * 100]
    rows = {r.w: r for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.md5_mod("w").alias("m"), text.simhash32("w").alias("s"), text.entropy_by_length("w").alias("e")).collect()}
    for w in words:
        votes = [0] * 32
        for c in w:
            h = int(hashlib.md5(c.encode()).hexdigest(), 16)
            votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
        assert rows[w].m == int(hashlib.md5(w.encode()).hexdigest(), 16) % 2147483647
        assert rows[w].s == sum(1 << i for i, v in enumerate(votes) if v >= 0)
        want = -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) / len(w) if w else 0.0
        assert math.isclose(rows[w].e, want, abs_tol=1e-12)


@pytest.mark.parametrize(
    ("url", "want"),
    [("http://user:pw@Ex.com:8080/a?b#c", "http://ex.com/a?b#c"), ("  EXAMPLE.com/Path ", "http://example.com/Path"), ("https://a.b.co.uk", "https://a.b.co.uk"), ("http://exämple.de/x", "http://xn--exmple-cua.de/x")],
)
def test_normalize(spark, url, want):
    assert spark.range(1).select(normalize_url(F.lit(url), idna=True)).first()[0] == want


def test_host_parts(spark):
    hosts = {"a.b.example.co.uk": ("a.b", "example", "co.uk"), "example.com": ("", "example", "com"), "10.0.0.1": ("", "10.0.0.1", ""), "host.unknowntld": ("host", "unknowntld", ""), "com": ("", "", "com")}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", host_parts("h").alias("p")).collect()
    assert {r.h: tuple(r.p) for r in got} == hosts
    assert spark.range(1).select(suffix_candidates(F.lit("a.b.c.d"))).first()[0] == ["a.b.c.d", "b.c.d", "c.d"]


def test_url_features(spark):
    urls = spark.createDataFrame([(normal,) for normal in ("http://www.paypa1-secure.login.example.com/aaab/confirm?x=1", "http://xn--e.io/", "http://sub.weebly.com/p")], "url string")
    lists = WordLists(brands=["paypal", "example"], keywords=["secure", "login", "confirm"])
    rows = {r["host"]: r.asDict() for r in url_features(url_parts(urls), lists).collect()}
    a = rows["www.paypa1-secure.login.example.com"]
    assert (a["subDomainCount"], a["isKnownTld"], a["domain_in_brand_list"], a["char_repeat"]) == (3, 1, 1, 6)  # www and aaab
    assert a["keyword_count"] == 3 and a["brand_name_count"] == 1
    assert a["similar_brand_count"] == a["target_brand_count"] == 1 and a["-"] == 1 and a["="] == 1
    assert rows["xn--e.io"]["punnyCode"] == 1 and rows["xn--e.io"]["subDomainCount"] == 1 and rows["xn--e.io"]["isKnownTld"] == 0
    assert rows["sub.weebly.com"]["domain_in_FWB_list"] == 1
    features = [c for c in a if c not in ("url", "host", "protocol", "subdomain", "domain", "tld", "registered_domain", "path", "words_raw")]
    assert len(features) == 39
    labels = [s["label"] for s in one(url_features(url_parts(urls), lists).where("host LIKE 'www%'").transform(lambda d: d.select(explain.url_signals(d).alias("s"))))["s"]]
    assert labels == ["Recognized brand domain", "Deep sub-domain nesting", "Credential-themed keywords"]


def test_transitions_tell_words_from_noise(spark):
    texts = spark.createDataFrame([("the quick brown fox and the lazy dog went there and then " * 50,)], "text string")
    table = {r["first"] + r["second"]: r["log_probability"] for r in train_transitions(texts).collect()}
    assert len(table) == 729 and math.isclose(sum(math.exp(v) for k, v in table.items() if k[0] == "t"), 1)
    model = TransitionModel(table)
    got = spark.createDataFrame([("thenthere",), ("xqzjvkxq",)], "w string").select("w", model.score(F.col("w")).alias("p")).collect()
    assert got[0].p > 2 * got[1].p
    model = TransitionModel(table, (got[0].p + got[1].p) / 2)
    pages = spark.createDataFrame([("http://xqzjvkxq.com/thenthere/fox",)], "url string")
    row = one(url_features(url_parts(pages), WordLists(vocabulary=frozenset({"then", "there"})), model))
    assert (row["random_domain"], row["random_words"], row["compound_word_count"], row["splitted_word_count"]) == (1, 1, 1, 2)


PAGE = """<html><head><title> A  b </title><link rel="shortcut icon" href="http://x/i.ico"><link rel=stylesheet href="/a.css"><!-- <p> -->
<script src="a.js" async></script><script>var t="</p>"; eval("x"); unescape('\\x41'); document.write(1)</script></head>
<body><a href="#">1</a><a href='http://x.com'>2</a><a href="http://x.com">3</a><a>4</a><form action="http://e/p.php"><input type="password"><input type="hidden" style="display: none"></form>
<iframe src="https://z"></iframe><img src=q><p>blocked</p><div hidden></div></body></html>"""


def test_html_features(spark):
    rows = html_features(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")).collect()
    a, b, c = (r.asDict() for r in sorted(rows, key=lambda r: r.id))
    assert len(a) - 2 == 87
    want = dict(html_num_of_anchors=4, html_num_of_anchors_to_hash=1, html_num_of_anchors_to_https=2, html_num_of_anchors_to_com=2, html_num_of_scripts=2, html_num_of_external_js=1, html_num_of_scripts_async=1, html_eval=1, html_unescape=1, html_escape=0, html_document_write=1, html_write=1, html_hex_encoding=1, html_num_of_icon=1, html_icon_external=1, html_num_of_css_internal=1, html_num_of_form_http=1, html_num_of_form_php=1, html_malicious_form=1, html_num_of_input_password=1, html_num_of_input_hidden=1, html_num_of_hidden_elements=2, html_num_of_iframe_src_https=1, html_num_of_imgs_src=1, html_num_of_paragraphs=1, html_blocked_keywords_label=1, html_external_href_ratio=1, html_internal_href_ratio=1, html_num_of_all_hrefs=5)
    assert {k: a[k] for k in want} == want
    assert math.isclose(a["html_most_common"], 2 / 3)
    assert not any(v for k, v in b.items() if k not in ("id", "html")) and c["html_num_of_tags"] == 0


def test_tls_features(spark):
    ext = "array<struct<oid: string, critical: boolean>>"
    cert = f"struct<not_before: timestamp, not_after: timestamp, issuer_cn: string, issuer_o: string, issuer_c: string, extensions: {ext}, san_dns: array<string>, san_count: int, eku: array<string>, policies: array<string>, is_ca: boolean>"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    leaf = (day(0), day(90), "R3", "Let", "US", [("a", True), ("b", False)], ["x.com", "y.com", "z"], 3, ["1.3.6.1.5.5.7.3.1", "1.3.6.1.5.5.7.3.2"], ["2.23.140.1.2.1", "1.3.6.1.4.1.1"], False)
    root = (day(0), day(3650), "Root", "Org", "US", [("c", True)], None, None, None, None, True)
    old = (day(-90), day(-1), "Old", "Org", "US", [], None, None, None, None, True)
    rows = [(1, ("TLSv1.3", "TLS_AES_256_GCM_SHA384", 2, [leaf, root])), (2, None), (3, ("TLSv1.2", "?", 0, [])), (4, ("TLSv1.2", "?", 2, [leaf, old])), (5, ("TLSv1.2", "?", 1, [(day(9), day(1), *leaf[2:])]))]
    df = spark.createDataFrame(rows, f"id int, tls struct<protocol: string, cipher: string, count: int, certs: array<{cert}>>")
    out = {r.id: r.asDict() for r in tls_features(df.withColumn("as_of", F.lit(day(10)))).collect()}
    assert len(out[1]) - 3 == 24
    want = dict(tls_has_tls=True, tls_chain_len=2, tls_negotiated_version_id=3, tls_negotiated_cipher_id=2, tls_leaf_cert_validity_len=90.0, tls_root_cert_validity_len=3650.0, tls_total_extension_count=2, tls_critical_extensions=1, tls_with_policies_crt_count=1, tls_percentage_crt_with_policies=0.5, tls_iso_policy_crt_count=1, tls_joint_isoitu_policy_crt_count=1, tls_x509_anypolicy_crt_count=0, tls_is_self_signed=0, tls_subject_count=3, tls_unique_SLD_count=2, tls_server_auth_crt_count=1, tls_client_auth_crt_count=1, tls_CA_certs_in_chain_ratio=0.5, tls_common_name_count=2, tls_expired_chain=0, tls_broken_chain=0)
    assert {k: out[1][k] for k in want} == want
    assert out[2]["tls_has_tls"] is False and out[2]["tls_chain_len"] is None and out[3]["tls_has_tls"] is False
    assert (out[4]["tls_expired_chain"], out[4]["tls_root_cert_validity_len"], out[4]["tls_percentage_crt_with_policies"]) == (1, -1.0, 0.5)
    assert (out[5]["tls_broken_chain"], out[5]["tls_leaf_cert_validity_len"], out[5]["tls_total_extension_count"]) == (1, -1.0, -1)


@pytest.fixture(scope="module")
def record(spark):
    person = "array<struct<name: string, email: string>>"
    ips = "array<struct<ttl: bigint, value: string>>"
    soa = "struct<primary_ns: string, resp_mailbox_dname: string, serial: bigint, refresh: bigint, retry: bigint, expire: bigint, min_ttl: bigint>"
    ip = f"struct<ip: string, from_record: string, asn: struct<asn: bigint, as_org: string, network_address: string, prefix_len: int>, geo: struct<country: string, country_code: string, latitude: double, longitude: double>, rdap: struct<ip_version: int, network: struct<network_address: string, prefix_length: int>, entities: map<string, {person}>>>"
    ddl = f"id int, record struct<domain_name: string, invalid_data: boolean, dns: struct<A: array<string>, AAAA: array<string>, TXT: array<string>, CNAME: struct<value: string, related_ips: {ips}>, MX: map<string, struct<priority: int, related_ips: {ips}>>, NS: map<string, struct<related_ips: {ips}>>, SOA: {soa}, zone_SOA: {soa}, ttls: map<string, bigint>, remarks: struct<zone: string, has_dnskey: boolean, has_spf: boolean, has_dkim: boolean, has_dmarc: boolean>>, rdap: struct<registration_date: timestamp, expiration_date: timestamp, last_changed_date: timestamp, dnssec: struct<delegationSigned: boolean>, entities: map<string, {person}>>, ip_data: array<{ip}>, remarks: struct<dns_evaluated_on: timestamp, rdap_evaluated_on: timestamp>>"
    when = datetime.datetime
    zone = ("ns1.example.com", "admin.example.com", 1, 2, 3, 4, 5)
    v4 = lambda a, c, n: (a, "A", (n, "org", "10.0.0.0", 8), c and (c, c, 10.0, 20.0), (4, ("10.0.0.0", 8 + n), {"administrative": [("Ann", None)]}))
    rich = ("mail.example.com", False, (["10.0.0.1", "10.1.0.1"], ["2001:db8::1"], ["v=spf1 x", "", "ms=abc"], None, {"mail.example.com": (10, []), "mx2.example.com": None}, {"ns1": ([],)}, None, zone, {"A": 100, "MX": 101, "NS": 600, "X": None}, ("sub.example.com", True, None, None, True)), (when(2020, 1, 1), when(2030, 1, 1), when(2024, 1, 1), (False,), {"registrar": [("Reg", None)], "registrant": [("Privacy Guard", None)]}), [v4("10.0.0.1", "US", 1), v4("10.1.0.1", "DE", 2), ("2001:db8::1", "AAAA", None, None, None), (" ", "A", None, None, None)], (None, None))
    bare = ("x.de", None, (None, None, None, None, None, None, None, None, None, (None, None, None, None, None)), (None, None, None, None, None), None, (None, None))
    return spark.createDataFrame([(1, rich), (2, bare), (3, None)], ddl)


def test_domain_features(spark, record):
    flat = records.flatten_records(record.where("record IS NOT NULL"))
    assert [r[0] for r in record.select(records.record_errors(record)).collect()] == [None, None, "no record"]
    rows = {r.id: r.asDict() for r in records.domain_features(flat, F.lit("2024-01-11").cast("timestamp"), country_ids={"US": 187, "DE": 65}, ngrams={2: ["ex", "zz"]}).collect()}
    a, b = rows[1], rows[2]
    want = dict(dns_A_count=2, dns_AAAA_count=1, dns_MX_count=1, dns_NS_count=1, dns_TXT_count=3, dns_SOA_count=0, dns_resolved_record_types=5, dns_zone_level=1, dns_ttl_avg=267.0, dns_ttl_low=1 / 3, dns_ttl_mid=1 / 3, dns_ttl_distinct_count=3, dns_soa_refresh=2, dns_soa_primary_ns_level=1, dns_domain_name_in_mx=True, dns_mx_avg_len=16.0, dns_txt_avg_len=14 / 3, dns_txt_external_verification_score=1.0, dns_txt_spf_exists=1, dns_txt_dkim_exists=0, dns_txt_dmarc_exists=1, dns_dnssec_score=0.0, dns_has_dnskey=1)
    want |= dict(ip_count=3, ip_v4_ratio=2 / 3, ip_entropy=1.0, ip_asn_entropy=1.0, ip_distinct_as_count=2, ip_as_address_entropy=0.0)
    want |= dict(geo_countries_count=2, geo_continents_count=1, geo_malic_host_country=1, geo_centroid_lat=15.0, geo_countries_hash=(65 * 2 + 187) * 2, geo_continent_hash=0, geo_estimated_area=0.0)
    want |= dict(rdap_domain_age=1471.0, rdap_time_from_last_change=10.0, rdap_has_dnssec=True, rdap_registrar_name_len=3, rdap_admin_email_len=0, rdap_ip_v4_count=2, rdap_ip_shortest_v4_prefix_len=9, rdap_ip_longest_v4_prefix_len=10, rdap_ip_avg_admin_name_len=2.0)
    want |= dict(lex_name_len=16, lex_sub_count=1, lex_phishing_bigram_matches=1, lex_tld_abuse_score=0.6554, lex_shortest_sub_len=11, lex_consecutive_chars=1)
    for k, v in want.items():
        assert a[k] == pytest.approx(v), k
    assert a["rdap_admin_email_entropy"] == a["rdap_registrant_name_entropy"] > 0
    assert (b["dns_ttl_avg"], b["rdap_domain_age"], b["ip_asn_entropy"], b["dns_domain_name_in_mx"], b["geo_countries_hash"], b["ip_v4_ratio"]) == (None, None, None, False, 0, 0.0)
    assert len([c for c in a if c.startswith(("dns_", "ip_", "geo_", "lex_", "rdap_"))]) == 39 + 6 + 18 + 48 + 14 + 10 + 1
    with pytest.raises(ValueError, match="unknown"):
        records.domain_features(flat, F.lit(None), enabled=["nothing"])


def test_domain_signals_and_evidence(spark, record):
    as_of = F.lit("2024-01-11").cast("timestamp")
    out = record.where("id = 1").select(explain.domain_signals("record", as_of).alias("s"), explain.domain_evidence("record", as_of).alias("e")).first()
    assert [(s.label, s.value, s.weight) for s in out.s] == [("Domain age", "4.0 years", "safe"), ("Registrar", "Reg", "low"), ("Hosting country", "US", "low")]
    assert out.e.whois.privacy and out.e.whois.created == "2020-01-01" and [d.value for d in out.e.dns] == ["10.0.0.1, 10.1.0.1", "ns1", out.e.dns[2].value]


def reference(ps, margins, how):
    for i, (p, m) in enumerate(zip(ps, margins, strict=True)):
        if p is not None and (p <= 0.5 - m or p >= 0.5 + m):
            return p, i
    have = [p for p in ps if p is not None]
    if not have:
        return None, None
    ordered = sorted(have)
    value = {"max": max(have), "mean": sum(have) / len(have), "median": (ordered[(len(have) - 1) // 2] + ordered[len(have) // 2]) / 2}[how]
    return value, min(range(len(ps)), key=lambda i: (abs(ps[i] - value) if ps[i] is not None else 9, i))


@pytest.fixture(scope="module")
def probabilities(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.0, 0.01, 0.5, 0.78, 0.99, 1.0, round(rng.random(), 2)]), rng.random() if rng.random() > 0.1 else None, rng.random() if rng.random() > 0.05 else None, rng.random() < 0.4) for i in range(500)]
    rows += [(1000, None, None, None, True)]
    return spark.createDataFrame(rows, "id int, u double, c double, d double, y boolean"), rows


@pytest.mark.parametrize("how", ["max", "mean", "median"])
def test_cascade_against_brute_force(probabilities, how):
    df, rows = probabilities
    policy = Policy([Stage("u", "u", 0.49), Stage("c", "c", 0.28), Stage("d", "d")], 0.1, how)
    got = {r.id: r for r in decide(df, policy).collect()}
    for i, u, c, d, _ in rows:
        p, at = reference((u, c, d), (0.49, 0.28, 0.1), how)
        assert got[i].decision == ("unknown" if p is None else "phish" if p >= 0.5 else "benign")
        assert p is None or (math.isclose(got[i].probability, p) and got[i].stage_id == "ucd"[at])
    with pytest.raises(ValueError, match="margin"):
        Policy([Stage("u", "u", 0.6)])


def test_grid_against_brute_force(probabilities):
    df, rows = probabilities
    values = sweeps.margins(6)
    got = {(r.s0, r.s1, r.s2): r for r in sweeps.margin_grid(df, ["u", "c", "d"], "y", values, [1, 10, 100]).collect()}
    assert len(got) == 216
    for key in [(0, 0, 0), (5, 5, 5), (1, 3, 2), (4, 0, 5)]:
        m = [values[k] for k in key]
        decided = [(reference((u, c, d), m, "mean"), y, (u, c, d)) for _, u, c, d, y in rows]
        positive = [(p is not None and p >= 0.5, y) for (p, _), y, _ in decided]
        assert (got[key].tp, got[key].fp) == (sum(a and y for a, y in positive), sum(a and not y for a, y in positive))
        assert got[key].tp + got[key].fp + got[key].fn + got[key].tn == len(rows)
    url_only = [(u is not None and u >= 0.5, y) for _, u, _, _, y in rows if u is not None]
    assert abs(got[0, 0, 0].tp - sum(a and y for a, y in url_only)) <= 1


def test_staged_runs_later_stages_on_open_rows_only(spark, probabilities):
    df, rows = probabilities
    policy = Policy([Stage("u", "u", 0.2), Stage("c", "c", 0.2)])
    seen = []

    def score(column):
        def run(rows):
            seen.append((column, rows.count()))
            return rows.select("id", column)

        return run

    out = staged(df, "id", [(policy.stages[0], score("u")), (policy.stages[1], score("c"))], policy)
    assert out.count() == len(rows)
    assert seen == [("u", len(rows)), ("c", sum(u is None or 0.3 < u < 0.7 for _, u, *_ in rows))]


def test_feeds_and_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("url,verification_time,online,verified\n a ,2024-01-02T00:00:00Z,yes,YES\nb,2024-01-01,yes,no\nc,never,yes,yes\n,2024-01-09,yes,yes\nd,2024-01-05T03:00:00+02:00,no,yes\n")
    feed = feeds.read_feed(spark, str(tmp_path / "f.csv"))
    cutoff = F.lit("2024-01-02").cast("timestamp")
    assert [r.url for r in feeds.recent(feed, cutoff).orderBy("ordinal").collect()] == ["a", "c", "d"]
    assert [r.url for r in feeds.recent(feeds.verified_only(feed), None, 1).collect()] == ["a"]
    (tmp_path / "r.txt").write_text("1,google.com\n\nplain.org\n")
    assert [r.domain for r in feeds.read_ranking(spark, str(tmp_path / "r.txt")).orderBy("ordinal").collect()] == ["google.com", "plain.org"]
    (tmp_path / "t.csv").write_text("﻿Trends,Search volume\n b ,1\na,2\nb,3\n,4\n", encoding="utf-8")
    assert [r.term for r in feeds.read_terms(spark, str(tmp_path / "t.csv")).orderBy("ordinal").collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="no column"):
        feeds.read_terms(spark, str(tmp_path / "f.csv"))
    (tmp_path / "l.txt").write_text("# note\nu1\n\nu2\nu1\n")
    assert [(r.url, r.label) for r in feeds.read_labelled(spark, str(tmp_path / "l.txt")).orderBy("ordinal").collect()] == [("u1", "unknown"), ("u2", "unknown")]
    both = feeds.labelled_set(spark.createDataFrame([("a", 0), ("b", 1)], "url string, ordinal long"), spark.createDataFrame([("b", 0), ("c", 1)], "url string, ordinal long"))
    assert {(r.url, r.label) for r in both.collect()} == {("a", "phish"), ("b", "phish"), ("c", "benign")}


def test_truncate_utf8(spark):
    for t in ("abc", "äöü€", "€" * 4, "𝄞𝄞", ""):
        for n in range(1, 10):
            want = t.encode()[:n].decode("utf-8", "ignore")
            assert spark.range(1).select(feeds.truncate_utf8(F.lit(t), n)).first()[0] == want, (t, n)


def test_upsert_sets_label_and_source_together(spark):
    rows = [("u", 1, 1, "phish", "feed"), ("u", 2, 2, "", "other"), ("u", 3, 3, "", ""), ("v", 1, 4, "", "")]
    got = {r.url: r for r in store.upsert_urls(spark.createDataFrame(rows, "url string, ts long, seq long, label string, source string")).collect()}
    assert (got["u"].created_at, got["u"].updated_at, got["u"].label, got["u"].source) == (1, 3, None, "other")
    assert (got["v"].label, got["v"].source) == (None, None)


def test_state_and_groups(spark):
    state = spark.createDataFrame([("feed", datetime.datetime(2024, 1, 1))], "source string, last_run_at timestamp")
    moved = store.advance(state, "feed", F.lit(datetime.datetime(2024, 2, 1)).cast("timestamp"))
    assert [r.last_run_at for r in moved.collect()] == [datetime.datetime(2024, 2, 1)]
    rows = spark.createDataFrame([("a", 1, "benign", True), ("a", 2, "phish", False), ("b", 3, "phish", False), (None, 4, "benign", True), (None, 5, "phish", True)], "ref string, id int, label string, ok boolean")
    got = {(r.ref, r.id, r.positive) for r in store.any_positive(rows, "ref", "label", "id", F.col("ok")).collect()}
    assert got == {("a", 1, True), (None, 4, False), (None, 5, True)}


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("url"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "phish").otherwise("").alias("label"), F.lit("").alias("source"))
    for i in range(3):
        e.where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.landed(spark, str(tmp_path / "in"), e.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=1)
    incremental.ingest(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r)[:3] for r in incremental.current(spark, str(tmp_path / "table")).collect()}
    assert got == {tuple(r)[:3] for r in store.upsert_urls(e).collect()}


def test_models(spark):
    rng = random.Random(1)
    rows = [(i, f"g{i % 40}", float(y), y + rng.random(), rng.random(), "7") for i in range(300) for y in [int(i % 3 == 0)]]
    df = spark.createDataFrame(rows, "id int, grp string, y double, `a.b` double, noise double, text string")
    columns = ["a.b", "noise", "absent", "text"]
    assert models.missing_and_extra(df, columns) == (["absent"], ["id", "grp", "y"])
    for kind in ("logistic_regression", "decision_tree", "linear_svm"):
        model, summary = models.train(df, columns, "y", kind)
        out = models.predict(df, model, columns, ["id", "y"])
        assert one(models.evaluate(out, "y", "probability"))["roc_auc"] > 0.95 and summary["n_positive"] == 100
    with pytest.raises(ValueError, match="both classes"):
        models.train(df.where("y = 1"), columns, "y")
    with pytest.raises(ValueError, match="model type"):
        models.train(df, columns, "y", "rbf_svm")
    parts = models.nested_split(df.withColumn("yb", F.col("y") > 0), "grp", "yb", 1)
    assert parts.count() == 300 and models.leaks(parts, "grp").count() == 0 and parts.select("part").distinct().count() == 3
    assert 40 <= models.holdout(df, "id").where("held_out").count() <= 80


def test_record_features_name_their_inputs_once(spark, sf):
    """Labels of a name are split once for each use of a name (the plan had 140 splits), and rows are dealt over the cores."""
    from harrier.queries.inventory import dns_record_features

    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = dns_record_features(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count(" split(") + plan.count("(split(") <= 16, plan.count("split(")
    assert plan.count("Repartition") == 1
