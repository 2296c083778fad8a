"""Deliberate oddities of values that results must keep, one test for each."""

from pyspark.sql import functions as F

from harrier.functions.text import deviation
from harrier.functions.urls import normalize_url, url_parts
from harrier.operators.domain_features import country_hash, dns_features, geo_features, rdap_domain_features
from harrier.operators.url_features import url_features
from harrier.plans.cascade import Policy, Stage, decide
from harrier.plans.models import align

PERSON = "array<struct<name: string, email: string>>"


def url(spark, text):
    return url_features(url_parts(spark.createDataFrame([(text,)], "url string"))).first()


def test_path_begins_after_the_first_place_of_the_suffix(spark):
    # "com" first occurs inside the host's label, so the path is still the first slash after it
    assert url(spark, "http://comics.example.com/a/b").path == "/a/b"
    # without a suffix the search begins at the scheme
    assert url(spark, "http://localhost/x").path == "//localhost/x"


def test_port_and_user_are_dropped(spark):
    row = spark.range(1).select(normalize_url(F.lit("http://u@h.com:81/p@q"))).first()[0]
    assert row == "http://h.com/p@q"


def test_no_subdomain_counts_as_one(spark):
    assert url(spark, "http://example.com/").subDomainCount == 1


def test_centroid_adds_half_of_the_maximum(spark):
    df = spark.createDataFrame([(["US", None], [10.0, 20.0], [1.0, None])], "countries array<string>, latitudes array<double>, longitudes array<double>")
    row = geo_features(df).first()
    assert row.geo_centroid_lat == 20.0 and row.geo_countries_count == 2 and row.geo_continents_count == 1 and row.geo_lon_stdev == 0.0


def test_country_hash_folds_ascending_ids(spark):
    df = spark.createDataFrame([([5, 3, 5, 9],)], "ids array<int>")
    assert df.select(country_hash(F.col("ids"), 10)).first()[0] == (3 + 5 + 9) * 2


def test_zone_authority_counts_below_the_zone_only(spark):
    soa = "struct<primary_ns: string, resp_mailbox_dname: string, refresh: bigint, retry: bigint, expire: bigint, min_ttl: bigint>"
    ddl = f"domain_name string, dns_zone string, dns_SOA {soa}, dns_zone_SOA {soa}, dns_A array<string>, dns_AAAA array<string>, dns_TXT array<string>, dns_NS array<string>, dns_MX array<struct<name: string, priority: int>>, dns_CNAME string, dns_ttls map<string, bigint>, dns_email_extras struct<spf: boolean, dkim: boolean, dmarc: boolean>"
    zone = ("ns.x.com", "a.x.com", 1, 2, 3, 4)
    rows = [("x.com", z, None, zone, None, None, [], None, None, None, None, (None, None, None)) for z in ("x.com", "s.x.com")]
    top, below = dns_features(spark.createDataFrame(rows, ddl)).orderBy("dns_zone_level").collect()
    assert top.dns_soa_refresh is None and below.dns_soa_refresh == 1
    assert top.dns_dnssec_score == 0.0 and top.dns_domain_name_in_mx is False and top.dns_txt_avg_len == 0.0 and top.dns_mx_avg_len is None


def test_any_delegation_answer_counts_as_signed(spark):
    df = spark.createDataFrame([(None, None, None, (False,), {})], f"rdap_registration_date timestamp, rdap_expiration_date timestamp, rdap_last_changed_date timestamp, rdap_dnssec struct<delegationSigned: boolean>, rdap_entities map<string, {PERSON}>")
    row = rdap_domain_features(df, F.lit("2024-01-01").cast("timestamp")).first()
    assert row.rdap_has_dnssec is True and row.rdap_domain_age is None and row.rdap_registrar_name_hash == 0


def test_margin_of_a_half_still_exits_at_certainty(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.999, 0.0), (0.5, 0.5)], "a double, b double")
    rows = decide(df, Policy([Stage("a", "a", 0.5), Stage("b", "b", 0.0)])).collect()
    assert [r.stage_id for r in rows] == ["a", "b", "b"] and rows[2].decision == "phish"


def test_missing_and_not_a_number_are_zero(spark):
    df = spark.createDataFrame([(1, float("nan"), None, True, "x")], "id int, a double, b double, c boolean, d string")
    assert tuple(align(df, ["a", "b", "c", "d", "e"]).first()) == (0.0, 0.0, 1.0, 0.0, 0.0)


def test_deviation_is_linear(spark):
    """The mean of 20,000 values is computed once, not for each of them (which took minutes)."""
    import time

    began = time.monotonic()
    got = spark.range(1, 20_001).agg(F.collect_list("id").alias("v")).select(deviation("v"), deviation(F.transform("v", lambda x: x * 2.0)), deviation(F.array(F.lit(None).cast("double"), F.lit(3.0)))).first()
    assert [round(x, 3) for x in got] == [5773.503, 11547.005, 0.0]
    assert time.monotonic() - began < 30
