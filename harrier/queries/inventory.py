"""Queries of collected records, readers' expressions, signals and run tables, each with its SQL.

``customer`` stands for domain records (every field made by arithmetic on its key, with nulls), ``orders`` for
certificate chains, ``events`` for logs and landed feeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions.text import spread
from harrier.functions.urls import host_parts, suffix_candidates
from harrier.operators import domain_features as records
from harrier.operators import explain
from harrier.operators.tls_features import tls_features
from harrier.plans import cascade, evaluation, metrics, models, sweeps
from harrier.queries.policy import _DECIDED, _M, _PROB, _TIMINGS, SHIPPED, P, _decide_sql, _read, _timings, probabilities
from harrier.sources import feeds, registration, store

AS_OF = "1998-12-01 00:00:00"


def domain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and a nested record for each customer."""
    c, K = spread(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")), F.col("c_custkey")  # noqa: N806
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    when = lambda test, value: F.when(F.expr(test), value)
    authority = F.struct(text("ns", K % 3, ".example.com").alias("primary_ns"), F.lit("admin.example.com").alias("resp_mailbox_dname"), (K % 7 * 100).alias("refresh"), F.lit(900).cast("long").alias("retry"), (K % 5).alias("expire"), F.lit(60).cast("long").alias("min_ttl"))
    contact = lambda name, email: F.array(F.struct(name.alias("name"), email.alias("email")))
    no_text = F.lit(None).cast("string")
    admin = contact(F.col("c_mktsegment"), F.lower(F.col("c_name")))
    address = lambda i: F.struct(
        when("c_custkey % 6 != 1", text("10.", (K + i) % 4, ".", K % 3, ".", i)).alias("ip"),
        when("c_custkey % 2 = 0", F.struct((K % 3 + i).alias("asn"), text("10.", K % 4, ".0.", i).alias("network_address"))).alias("asn"),
        when("c_custkey % 3 != 0", F.struct(text("C", K % 4).alias("country_code"), text("Land ", K % 4).alias("country"), (F.col("c_acctbal") / 100 + i).alias("latitude"), (K % 90).cast("double").alias("longitude"))).alias("geo"),
        F.struct(when("c_custkey % 5 != 0", (F.lit(4) + (K % 2) * 2).cast("int")).alias("ip_version"), F.struct((K % 16 + 8 + i).alias("prefix_length")).alias("network"), F.create_map(F.lit("administrative"), admin).alias("entities")).alias("rdap"),
    )
    record = F.struct(
        text("site", K, ".example", K % 9, ".com").alias("domain_name"),
        F.lit(False).alias("invalid_data"),
        F.struct(
            when("c_custkey % 3 != 0", F.transform(F.sequence(F.lit(1), (K % 3).cast("int")), lambda i: text("10.0.", K % 200, ".", i))).alias("A"),
            when("c_custkey % 5 = 0", F.array(text("2001:db8::", K % 9))).alias("AAAA"),
            when("c_custkey % 4 != 0", F.array(F.lit("v=spf1 include:mail"), F.col("c_mktsegment"), text("MS=ms", K % 50))).alias("TXT"),
            when("c_custkey % 2 = 0", F.create_map(F.lit("ns1.example.com"), F.lit(1), F.lit("ns2.example.com"), F.lit(2))).alias("NS"),
            when("c_custkey % 3 = 1", F.create_map(text("mx.site", K, ".com"), F.struct(F.lit(10).alias("priority")), text("site", K, ".example", K % 9, ".com"), F.struct(F.lit(20).alias("priority")))).alias("MX"),
            when("c_custkey % 13 = 0", F.struct(F.lit("alias.example.org").alias("value"))).alias("CNAME"),
            F.create_map(F.lit("A"), K % 20 * 60, F.lit("NS"), when("c_custkey % 2 = 0", F.lit(3600).cast("long")), F.lit("MX"), K % 3 * 200).alias("ttls"),
            when("c_custkey % 3 = 0", authority).alias("SOA"),
            when("c_custkey % 3 = 1", authority).alias("zone_SOA"),
            F.struct(when("c_custkey % 11 != 0", text("zone", K % 7, ".example.com")).alias("zone"), when("c_custkey % 10 = 0", F.lit(True)).alias("has_spf"), F.lit(None).cast("boolean").alias("has_dkim"), (K % 8 == 0).alias("has_dmarc"), when("c_custkey % 2 = 0", K % 4 == 0).alias("has_dnskey")).alias("remarks"),
        ).alias("dns"),
        F.struct(
            when("c_custkey % 7 != 0", F.expr("timestamp'1998-11-01 12:00:00' - make_interval(0, 0, 0, int(c_custkey % 900))")).alias("registration_date"),
            when("c_custkey % 5 != 0", F.expr("timestamp'1999-01-15 00:00:00' - make_interval(0, 0, 0, int(c_custkey % 100))")).alias("expiration_date"),
            F.expr("timestamp'1998-11-20 06:00:00'").alias("last_changed_date"),
            when("c_custkey % 4 = 0", F.struct((K % 8 == 0).alias("delegationSigned"))).alias("dnssec"),
            F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("registrar").alias("key"), contact(F.col("c_mktsegment"), no_text).alias("value")), when("c_custkey % 3 = 0", F.struct(F.lit("registrant").alias("key"), contact(F.when(K % 2 == 0, F.lit("REDACTED FOR PRIVACY")).otherwise(F.col("c_name")), no_text).alias("value"))), when("c_custkey % 4 = 1", F.struct(F.lit("administrative").alias("key"), admin.alias("value")))))).alias("entities"),
        ).alias("rdap"),
        F.struct(F.lit(AS_OF).alias("dns_evaluated_on"), F.lit(AS_OF).alias("rdap_evaluated_on")).alias("remarks"),
        F.transform(F.sequence(F.lit(0), (K % 3).cast("int")), address).alias("ip_data"),
    )
    return c.select(K.alias("id"), record.alias("record"))


def _flat(spark, sf_dir):
    return records.flatten_records(domain_records(spark, sf_dir))


_ENTROPY = "(CASE WHEN length({t}) = 0 THEN 0 ELSE list_sum(list_transform(list_distinct(string_split({t}, '')), lambda ch: -((length({t}) - length(replace({t}, ch, ''))) / length({t})) * log2((length({t}) - length(replace({t}, ch, ''))) / length({t})))) / length({t}) END)"
_VALUES = "coalesce(list_sum(list_transform(list_distinct({v}), lambda y: -(len(list_filter({v}, lambda z: z = y)) / len({v})) * log2(len(list_filter({v}, lambda z: z = y)) / len({v})))), 0)"
#: The records' fields in SQL.
_REC = """r AS (
  SELECT c_custkey AS id, c_custkey AS k, c_name, c_mktsegment AS seg, c_acctbal AS bal, 'site' || c_custkey || '.example' || c_custkey % 9 || '.com' AS domain_name,
    CASE WHEN c_custkey % 3 <> 0 THEN list_transform(range(1, c_custkey % 3 + 1), lambda i: '10.0.' || c_custkey % 200 || '.' || i) END AS a,
    CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS aaaa, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS cname, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS ns,
    CASE WHEN c_custkey % 4 <> 0 THEN ['v=spf1 include:mail', c_mktsegment, 'MS=ms' || c_custkey % 50] END AS txt,
    CASE WHEN c_custkey % 3 = 1 THEN ['mx.site' || c_custkey || '.com', 'site' || c_custkey || '.example' || c_custkey % 9 || '.com'] END AS mx,
    list_filter([c_custkey % 20 * 60, CASE WHEN c_custkey % 2 = 0 THEN 3600 END, c_custkey % 3 * 200], lambda x: x IS NOT NULL) AS ttls,
    CASE WHEN c_custkey % 11 <> 0 THEN 'zone' || c_custkey % 7 || '.example.com' ELSE '' END AS zone, 'ns' || c_custkey % 3 || '.example.com' AS soa_ns,
    CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '1998-11-01 12:00:00' - to_days(CAST(c_custkey % 900 AS INT)) END AS registered, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '1999-01-15 00:00:00' - to_days(CAST(c_custkey % 100 AS INT)) END AS expires,
    list_transform(range(0, c_custkey % 3 + 1), lambda i: CASE WHEN c_custkey % 6 <> 1 THEN '10.' || (c_custkey + i) % 4 || '.' || c_custkey % 3 || '.' || i END) AS ips FROM customer
)"""
DNS = (
    "dns_dnssec_score", "dns_zone_level", "dns_zone_digit_count", "dns_zone_len", "dns_zone_entropy", "dns_A_count", "dns_AAAA_count", "dns_MX_count", "dns_NS_count", "dns_TXT_count",
    "dns_SOA_count", "dns_CNAME_count", "dns_resolved_record_types", "dns_ttl_avg", "dns_ttl_stdev", "dns_ttl_low", "dns_ttl_mid", "dns_ttl_distinct_count", "dns_soa_primary_ns_level",
    "dns_soa_primary_ns_digit_count", "dns_soa_primary_ns_len", "dns_soa_primary_ns_entropy", "dns_soa_email_level", "dns_soa_email_digit_count", "dns_soa_email_len", "dns_soa_email_entropy",
    "dns_soa_refresh", "dns_soa_retry", "dns_soa_expire", "dns_soa_min_ttl", "dns_domain_name_in_mx", "dns_mx_avg_len", "dns_mx_avg_entropy", "dns_txt_avg_len", "dns_txt_avg_entropy",
    "dns_txt_external_verification_score", "dns_txt_spf_exists", "dns_txt_dkim_exists", "dns_txt_dmarc_exists",
)


def _rounded(df: DataFrame, *names: str) -> list:
    """Doubles to six places, and -1 for a whole number that is missing."""
    kinds = dict(df.dtypes)
    return [F.round(c, 6).alias(c) if kinds[c] == "double" else F.coalesce(c, F.lit(-1).cast("long")).alias(c) if kinds[c] == "bigint" else F.col(c) for c in names]


def dns_record_features(spark, sf_dir):
    out = records.dns_features(_flat(spark, sf_dir))
    return out.select("id", *_rounded(out, *DNS))


def flat_records(spark, sf_dir):
    """All 24 flat columns of the records, nested ones as their sizes or parts."""
    size = lambda c: F.coalesce(F.size(c), F.lit(-1)).cast("long").alias(f"n_{c}")
    out = _flat(spark, sf_dir)
    sized = [size(c) for c in ("dns_ttls", "dns_A", "dns_AAAA", "dns_TXT", "dns_NS", "dns_MX", "rdap_entities", "ip_data", "countries", "latitudes", "longitudes")]
    return out.select("id", "domain_name", "dns_email_extras.spf", "dns_email_extras.dkim", "dns_email_extras.dmarc", "dns_zone", "dns_CNAME", "dns_has_dnskey", F.coalesce("dns_SOA.expire", F.lit(-1)).alias("soa"), F.coalesce("dns_zone_SOA.expire", F.lit(-1)).alias("zone_soa"), *sized, "dns_evaluated_on", "rdap_evaluated_on", F.date_format("rdap_registration_date", "yyyy-MM-dd").alias("registered"), F.date_format("rdap_expiration_date", "yyyy-MM-dd").alias("expires"), F.date_format("rdap_last_changed_date", "yyyy-MM-dd").alias("changed"), F.coalesce(F.col("rdap_dnssec.delegationSigned").cast("string"), F.lit("none")).alias("signed"))


def usable_records(spark, sf_dir):
    """Records by why they can't be used."""
    rows = domain_records(spark, sf_dir)
    broken = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.struct(F.lit(True).alias("invalid_data"), F.col("record.domain_name"))).when(F.col("id") % 5 == 2, F.struct(F.lit(False).alias("invalid_data"), F.lit("").alias("domain_name"))).otherwise(F.struct("record.invalid_data", "record.domain_name"))
    rows = rows.select(broken.alias("record"))
    return rows.groupBy(F.coalesce(records.record_errors(rows), F.lit("usable")).alias("why")).agg(F.count("*").alias("n"))


def ip_record_features(spark, sf_dir):
    out = records.ip_features(records.dns_features(_flat(spark, sf_dir)))
    return out.select("id", *_rounded(out, "ip_count", "ip_v4_ratio", "ip_entropy", "ip_as_address_entropy", "ip_asn_entropy", "ip_distinct_as_count"))


RDAP_IP = tuple(f"rdap_ip_{x}" for x in ("v4_count", "v6_count", "shortest_v4_prefix_len", "longest_v4_prefix_len", "shortest_v6_prefix_len", "longest_v6_prefix_len", "avg_admin_name_len", "avg_admin_name_entropy", "avg_admin_email_len", "avg_admin_email_entropy"))


def rdap_ip_record_features(spark, sf_dir):
    out = records.rdap_ip_features(_flat(spark, sf_dir))
    return out.select("id", *_rounded(out, *RDAP_IP))


RDAP_DN = ("rdap_registration_period", "rdap_domain_age", "rdap_time_from_last_change", "rdap_domain_active_time", "rdap_has_dnssec", "rdap_registrar_name_len", "rdap_registrar_name_entropy", "rdap_registrant_name_len", "rdap_registrant_name_entropy", "rdap_admin_name_len", "rdap_admin_name_entropy", "rdap_admin_email_len", "rdap_admin_email_entropy")


def rdap_domain_record_features(spark, sf_dir):
    out = records.rdap_domain_features(_flat(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return out.select("id", *_rounded(out, *RDAP_DN))


def domain_signal_rows(spark, sf_dir):
    """The signals of each record, one row a signal."""
    rows = domain_records(spark, sf_dir)
    return rows.select("id", F.explode(explain.domain_signals("record", F.lit(AS_OF))).alias("s")).select("id", "s.label", "s.value", "s.weight")


def domain_evidence_rows(spark, sf_dir):
    rows = domain_records(spark, sf_dir)
    e = explain.domain_evidence("record", F.lit(AS_OF))
    dns = lambda t: F.get(F.filter(e["dns"], lambda x: x["type"] == t), F.lit(0))["value"]
    return rows.select("id", *(e["whois"][c].alias(c) for c in ("registrar", "created", "expires", "country", "privacy")), F.coalesce(e["whois"]["ageDays"], F.lit(-1)).alias("ageDays"), dns("A").alias("a"), dns("NS").alias("ns"), dns("MX").alias("mx"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoded certificate chain for each order, of up to three certificates."""
    o = F.col("o_orderkey")
    word = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (o % len(xs) + 1).cast("int"))
    cert = lambda i: F.struct(
        F.expr("timestamp'1998-01-01 00:00:00'").alias("not_before"),
        (F.expr("timestamp'1998-12-20 00:00:00'") + F.make_dt_interval((F.when((o + i) % 11 == 0, -30).when((o + i) % 13 == 0, -400).otherwise(100) + i).cast("int"))).alias("not_after"),
        F.when(i % 2 == 0, F.lit("cn")).alias("issuer_cn"),
        F.concat(F.lit("Org "), ((o + i) % 5).cast("string")).alias("issuer_o"),
        F.lit("US").alias("issuer_c"),
        F.transform(F.sequence(F.lit(1), (i + 1).cast("int")), lambda j: F.struct(j.cast("string").alias("oid"), (j % 2 == 1).alias("critical"))).alias("extensions"),
        F.array(F.lit("a.example.com"), F.concat(F.lit("d"), (o % 3).cast("string"))).alias("san_dns"),
        F.when(i == 0, (o % 4).cast("int")).alias("san_count"),
        F.array(F.lit("1.3.6.1.5.5.7.3.1"), F.lit("1.3.6.1.5.5.7.3.2")).alias("eku"),
        F.when(i != 1, F.array(F.lit("1.2.3"), F.lit("2.23.140"))).alias("policies"),
        (i > 0).alias("is_ca"),
    )
    tls = F.when(o % 7 != 0, F.struct(word("TLSv1.2", "TLSv1.3", "other").alias("protocol"), word("TLS_AES_128_GCM_SHA256", "AES128-SHA").alias("cipher"), (o % 3 + 1).cast("int").alias("count"), F.transform(F.sequence(F.lit(0), (o % 3).cast("int")), cert).alias("certs")))
    return _read(spark, sf_dir, "orders").select(o.alias("id"), tls.alias("tls"), F.lit("1998-12-15 00:00:00").alias("as_of"))


TLS = ("has_tls", "chain_len", "is_self_signed", "root_authority_hash", "leaf_authority_hash", "negotiated_version_id", "negotiated_cipher_id", "root_cert_validity_len", "leaf_cert_validity_len", "broken_chain", "expired_chain", "total_extension_count", "critical_extensions", "with_policies_crt_count", "percentage_crt_with_policies", "x509_anypolicy_crt_count", "iso_policy_crt_count", "joint_isoitu_policy_crt_count", "subject_count", "server_auth_crt_count", "client_auth_crt_count", "CA_certs_in_chain_ratio", "unique_SLD_count", "common_name_count")


def tls_record_features(spark, sf_dir):
    out = tls_features(chains(spark, sf_dir))
    return out.select("id", *_rounded(out, *(f"tls_{c}" for c in TLS)))


_TLS = """c AS (
  SELECT o_orderkey AS id, o_orderkey AS o, o_orderkey % 7 <> 0 AS present, range(0, o_orderkey % 3 + 1) AS certs, list_transform(range(0, o_orderkey % 3 + 1), lambda i: CASE WHEN (o_orderkey + i) % 11 = 0 THEN -30 WHEN (o_orderkey + i) % 13 = 0 THEN -400 ELSE 100 END + i) AS d FROM orders
), s AS (
  SELECT *, list_transform(d, lambda x: CASE WHEN 353 + x < 0 THEN 1 WHEN 5 + x < 0 THEN 2 ELSE 0 END) AS st FROM c
), v AS (
  SELECT *, list_min(list_filter(list_transform(certs, lambda i: CASE WHEN st[i + 1] > 0 THEN i + 1 END), lambda x: x IS NOT NULL)) AS pos FROM s
), g AS (
  SELECT *, coalesce(pos - 1, len(certs)) AS n, coalesce(pos, len(certs)) AS seen, st[pos] AS stop FROM v
), x AS (
  SELECT *, n > 0 AS leaf, n = len(certs) AND n >= 2 AS root, n - CASE WHEN n >= 2 THEN 1 ELSE 0 END AS pol FROM g
)"""
_MD5 = "CAST(('0x' || md5({}))::UHUGEINT % 2147483647 AS BIGINT)"


# readers' expressions


def _feed(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 5 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.lit(" "))).alias("url"), at.alias("verification_time"), F.when(F.col("event_id") % 2 == 0, F.lit(" YES")).otherwise(F.lit("no")).alias("online"), F.when(F.col("event_id") % 3 != 0, F.lit("yes")).alias("verified"))


def feed_recent(spark, sf_dir):
    """Feed rows since a time, or without one, that are online and verified."""
    rows = feeds.verified_only(feeds.recent(_feed(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"), order="event_id"))
    return rows.select("event_id", "url", F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at"))


def feed_limit(spark, sf_dir):
    """The first 50 kept rows of a feed, the limit being the feature."""
    return feeds.recent(_feed(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"), limit=50, order="event_id").select("event_id")


def labelled_union(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("ordinal"), "event_type")
    return feeds.labelled_set(e.where("event_type = 'error'"), e.where("event_type <> 'error'").drop("event_type"))


def truncated_texts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(F.encode(feeds.truncate_utf8(F.col("text"), 101), "UTF-8")).alias("digest"))


def event_dates(spark, sf_dir):
    """The first registration event of lists of (action, date)."""
    k = F.col("o_orderkey")
    event = lambda action, day: F.struct(F.lit(action).alias("eventAction") if isinstance(action, str) else action.alias("eventAction"), day.alias("eventDate"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    events = F.array(event("last changed", F.lit("1990-01-01")), event(F.when(k % 3 == 0, F.lit("Registration")).otherwise(F.lit(None)), day), event("re-registration", F.lit("1991-02-03")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(feeds.event_date(events, ("registration", "created")), "yyyy-MM-dd").alias("registered"))


def result_urls(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).when(F.col("c_custkey") % 3 == 1, F.lit(" h ")).alias("href"), F.when(F.col("c_custkey") % 2 == 0, F.lit("u")).alias("url"), F.lit("l").alias("link"))
    return c.select("c_custkey", feeds.result_url(c).alias("found"))


def card_contacts(spark, sf_dir):
    """Names and addresses by role out of jCards."""
    name, key = F.col("c_name"), F.col("c_custkey")
    card = lambda fn, mail: F.concat(F.lit('["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", "'), fn, F.lit('"], ["email", {}, "text", "'), mail, F.lit('"]]]'))
    entity = lambda roles, fn, mail: F.struct(F.array(*map(F.lit, roles)).alias("roles"), card(fn, mail).alias("vcardArray"))
    entities = F.array(entity(["Registrar"], F.col("c_mktsegment"), F.lit("")), entity(["administrative", "technical"], name, F.concat(key.cast("string"), F.lit("@x.org"))), entity(["registrant"], F.lit(""), F.lit("")))
    found = spread(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select("c_custkey", registration.contacts(entities).alias("m"))
    return found.select("c_custkey", F.col("m")["registrar"][0]["name"].alias("registrar"), F.col("m")["registrar"][0]["email"].alias("registrar_email"), F.col("m")["administrative"][0]["name"].alias("admin"), F.col("m")["administrative"][0]["email"].alias("admin_email"), F.map_contains_key("m", "registrant").alias("has_registrant"))


def registration_values(spark, sf_dir):
    """First present keys, known suffixes, TXT flags, authority placement and address versions."""
    k = F.col("c_custkey")
    parsed = F.map_from_entries(F.array_compact(F.array(F.when(k % 3 == 0, F.struct(F.lit("Registrar").alias("key"), F.array(F.col("c_name")).alias("value"))), F.struct(F.lit("registrar").alias("key"), F.array(F.col("c_mktsegment"), F.lit("x")).alias("value")))))
    host = F.concat(F.lit("a.b"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".co.uk", ".org", ".zz"))), (k % 3 + 1).cast("int")))
    flags = registration.text_flags(F.when(k % 4 != 0, F.array(F.lit("V=SPF1 x"), F.when(k % 2 == 0, F.lit("k=dkim")).otherwise(F.lit("none")))))
    placed = registration.placed_authority(F.lit("a.com"), F.when(k % 3 == 0, F.lit("a.com")).when(k % 3 == 1, F.lit("com")), k)
    first = registration.first_sources(F.array(*(F.struct(ip.alias("ip"), F.lit(s).alias("source")) for ip, s in ((F.lit("1.1.1.1"), "A"), ((k % 2).cast("string"), "MX"), (F.lit("1.1.1.1"), "NS"), ((k % 2).cast("string"), "NS")))))
    return _read(spark, sf_dir, "customer").select(
        "c_custkey",
        registration.first_present(parsed, ("Registrar", "registrar")).alias("registrar"),
        registration.known_suffix(host, ("org", "uk", "co.uk")).alias("suffix"),
        flags["spf"].alias("spf"),
        flags["dkim"].alias("dkim"),
        flags["dmarc"].alias("dmarc"),
        F.coalesce(placed["SOA"], F.lit(-1)).alias("own"),
        F.coalesce(placed["zone_SOA"], F.lit(-1)).alias("zone"),
        F.array_join(F.transform(first, lambda x: F.concat_ws("/", x["ip"], x["source"])), ",").alias("sources"),
        registration.ip_version(F.when(k % 2 == 0, F.lit("::1")).otherwise(F.lit("1.2.3.4")), F.when(k % 5 == 0, F.lit(6))).cast("long").alias("version"),
        F.size(suffix_candidates(host)).cast("long").alias("n_candidates"),
    )


def suffix_split(spark, sf_dir):
    """Hosts under suffixes of one label and of two, unlisted ones and addresses, each split in three."""
    k = F.col("c_custkey")
    tail = F.element_at(F.array(*map(F.lit, (".co.uk", ".xyz", ".unlisted", ".com.au", ".uk"))), (k % 5 + 1).cast("int"))
    host = F.when(k % 17 == 0, F.lit("10.1.2.3")).otherwise(F.concat(F.lit("www.n"), k.cast("string"), tail))
    p = host_parts(host)
    return _read(spark, sf_dir, "customer").select("c_custkey", p["subdomain"].alias("subdomain"), p["domain"].alias("domain"), p["suffix"].alias("suffix"))


# signals and answers


def content_signal_rows(spark, sf_dir):
    k = F.col("p_partkey")
    names = {"html_num_of_input_password": k % 3, "html_malicious_form": k % 5 - 4, "html_num_of_form_http": k % 2, "html_num_of_iframe": k % 4, "html_eval": F.when(k % 6 == 0, "x").otherwise(F.lit("0")), "tls_has_tls": k % 7 != 0, "tls_is_self_signed": k % 2, "tls_expired_chain": k % 9 - 8}
    rows = _read(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in names.items()))
    return rows.select("p_partkey", F.explode(explain.content_signals(rows)).alias("s")).select("p_partkey", "s.label", "s.value", "s.weight")


def answer_json(spark, sf_dir):
    """The result JSON of decided rows, read back."""
    done = cascade.decide(probabilities(spark, sf_dir), SHIPPED).select("l_orderkey", "l_linenumber", explain.result_json().alias("j"))
    value = lambda path, kind: F.get_json_object("j", path).cast(kind)
    return done.select("l_orderkey", "l_linenumber", value("$.decision", "string").alias("decision"), F.round(value("$.confidence", "double"), 9).alias("confidence"), F.round(value("$.probabilities.phish", "double"), 9).alias("phish"), F.round(value("$.probabilities.benign", "double"), 9).alias("benign"))


def sanitized_values(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 7 == 1, float("inf")).otherwise(F.col("event_id").cast("double"))
    rows = _read(spark, sf_dir, "events").select("event_id", v.alias("value"), F.col("event_type").cast("binary").alias("raw"), "ts")
    return explain.sanitized(rows)


def safe_numbers(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", explain.number(d, "n_chars").alias("n_chars"), explain.number(d, "source").alias("source"), explain.number(d, "absent").alias("absent"))


def staged_run(spark, sf_dir):
    """Later stages run only where the earlier ones left a row open."""
    p = probabilities(spark, sf_dir).groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")).agg(*(F.max(c).alias(c) for c in P))
    score = lambda c: (lambda rows: rows.select("key", c))
    known = cascade.staged(p, "key", [(s, score(s.probability)) for s in SHIPPED.stages], SHIPPED)
    return known.agg(F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in P))


def asymmetric_exits(spark, sf_dir):
    done = cascade.asymmetric(probabilities(spark, sf_dir), "p_content", 0.45, 0.2)
    return done.groupBy("exited").agg(F.count("*").alias("n"))


def loaded_policy(spark, sf_dir):
    policy = cascade.load_policy('{"aggregation": "max", "margin": 0.3, "stages": [{"name": "url", "margin": 0.49}, {"name": "content"}]}')
    return cascade.decide(probabilities(spark, sf_dir), policy).groupBy("stage_id", "decision").agg(F.count("*").alias("n"))


# run tables


def near_timeouts(spark, sf_dir):
    rows = _timings(spark, sf_dir).withColumns({"near": evaluation.near_timeout(F.col("collect_ms"), F.lit(50.0)), "degraded": evaluation.degraded_content((F.col("event_id") % 500).cast("int"), F.when(F.col("event_id") % 3 != 0, F.lit("x")))})
    return rows.groupBy("stage").agg(F.count_if("near").alias("n_near"), F.count_if("degraded").alias("n_degraded"))


def timed_outcomes(spark, sf_dir):
    k = F.col("event_id")
    phase = F.when(k % 4 == 0, "collect").when(k % 4 == 1, "extract").when(k % 4 == 2, "predict")
    error = F.when(k % 3 == 0, "Read Timeout").when(k % 3 == 1, "DNS failure").otherwise("bad")
    rows = _read(spark, sf_dir, "events").select(evaluation.outcome(phase, error).alias("outcome"))
    ranked = metrics.in_order(rows.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", metrics.OUTCOMES)
    return metrics.shares(ranked, [], "n").select("outcome", "rank", "n", F.round("pct", 6).alias("pct"), "least", "most", F.round("mean", 6).alias("mean"))


def sweep_tenths(spark, sf_dir):
    """Every tenth step of the threshold sweep beside its cost, merged by step."""
    sweep = sweeps.threshold_sweep(probabilities(spark, sf_dir), "p_url", "y", [i / 100 for i in range(101)])
    cost = sweep.select("step", (F.col("fp") * 10 + F.col("fn") * 50).alias("cost"))
    return metrics.every_nth(sweep.join(cost, "step"), 10).select(F.col("step").cast("long").alias("step"), "tp", "fp", "cost")


def selection_optimism(spark, sf_dir):
    rows = _timings(spark, sf_dir).where("collect_ms IS NOT NULL").withColumn("selected", F.col("event_id") % 97 == 0)
    both = metrics.optimism(rows, ["stage"], "collect_ms").join(metrics.percentile_of(rows, ["stage"], "collect_ms"), "stage")
    return both.select("stage", F.round("optimism", 6).alias("optimism"), F.round("percentile", 6).alias("percentile"))


def run_totals(spark, sf_dir):
    k = F.col("event_id")
    tries = _read(spark, sf_dir, "events").select(F.when(k % 4 == 0, "x").alias("domain_error"), F.when(k % 6 == 0, "y").alias("content_error"))
    return store.attempt_totals(tries)


def content_upsert(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    urls = e.where("event_type <> 'view'").groupBy(F.col("user_id").alias("url")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max("event_type").alias("label"))
    found = e.where("event_type = 'view'").select(F.col("user_id").alias("url"), "ts", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("content"))
    out = store.store_content(urls, found)
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("url", day("created_at"), day("updated_at"), "label", "content", day("content_at"))


def as_of_hot_rows(spark, sf_dir):
    """As-of pairing where rows repeat: each click twice, under one domain in three."""
    e = _read(spark, sf_dir, "events").withColumn("domain", F.col("user_id") % 3)
    clicks = e.where("event_type = 'click'").select("domain", F.col("ts").alias("at"))
    views = e.where("event_type = 'view'").select("domain", F.col("ts").alias("collected_at"), F.col("event_id").alias("snap"))
    met = store.as_of_snapshot(clicks.unionByName(clicks), views)
    return met.groupBy("domain").agg(F.count("*").alias("n"), F.count("record").alias("n_paired"), F.sum("record.snap").alias("snaps"))


def missing_columns(spark, sf_dir):
    missing, extra = models.missing_and_extra(_read(spark, sf_dir, "documents"), ["n_chars", "absent"])
    return spark.range(1).select(F.lit(",".join(missing)).alias("missing"), F.lit(",".join(sorted(extra))).alias("extra"))


def exact_holdout(spark, sf_dir):
    """How many of each class are held out: a fifth to the row."""
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type")
    return models.stratified_holdout(rows, "event_id", "event_type").groupBy("event_type").agg(F.count_if("held_out").alias("n_held"), F.count("*").alias("n"))


def training_rows(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "phish").when(F.col("event_type") == "view", "benign").alias("label"), (F.col("user_id") % 50).alias("grp"))
    features = e.where("event_id % 4 <> 0").select("event_id", (F.col("event_id") % 10).alias("f"))
    return models.training_set(e, features, "event_id", group="grp").select("event_id", "label", "grp", "f", "y")


def fold_balance(spark, sf_dir):
    """Group folds: groups in more than one fold, and the spread of positives over the folds."""
    rows = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("grp"), (F.col("event_type") == "error").cast("int").alias("y"))
    folds = models.group_folds(rows, "grp", "y", 5, 0)
    per = folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    split = folds.groupBy("grp").agg(F.count_distinct("fold").alias("k")).where("k > 1")
    return per.agg(F.count("*").alias("n_folds"), F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), (F.max("n") <= F.avg("n") * 1.2).alias("even"), (F.max("pos") <= F.avg("pos") * 1.3 + 3).alias("even_pos")).crossJoin(F.broadcast(split.agg(F.count("*").alias("n_split"))))  # one row each


QUERIES = {f.__name__: f for f in (
    dns_record_features, flat_records, usable_records, ip_record_features, rdap_ip_record_features, rdap_domain_record_features, domain_signal_rows, domain_evidence_rows, tls_record_features,
    feed_recent, feed_limit, labelled_union, truncated_texts, event_dates, result_urls, card_contacts, registration_values, suffix_split,
    content_signal_rows, answer_json, sanitized_values, safe_numbers, staged_run, asymmetric_exits, loaded_policy,
    near_timeouts, timed_outcomes, sweep_tenths, selection_optimism, run_totals, content_upsert, as_of_hot_rows, missing_columns, exact_holdout, training_rows, fold_balance,
)}

_N = "CASE WHEN k % 6 <> 1 THEN k % 3 + 1 ELSE 0 END"
_DAYS = "greatest(0, (epoch_us({b}) - epoch_us({a})) / 86400e6)"
_REG = "CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'REDACTED FOR PRIVACY' ELSE c_name END ELSE '' END"
_ADMIN, _EMAIL = "CASE WHEN k % 4 = 1 THEN seg ELSE '' END", "CASE WHEN k % 4 = 1 THEN lower(c_name) ELSE '' END"
_AGED = "CAST(greatest(0, floor((epoch_us(TIMESTAMP '1998-12-01 00:00:00') - epoch_us(registered)) / 86400e6)) AS BIGINT)"
_AGE_LABEL = "CASE WHEN age < 60 THEN age || ' days' WHEN age < 730 THEN CAST(round_even(age / 30, 0) AS BIGINT) || ' months' ELSE printf('%.1f years', age / 365.0) END"
_HAS_SOA = "(k % 3 = 0 OR k % 3 = 1 AND k % 11 <> 0)"
_KEPT = "(event_id % 5 = 0 OR date_trunc('second', ts) >= TIMESTAMP '2024-01-15 00:00:00')"
_CLICKS = "c AS (SELECT user_id % 3 AS domain, ts AS at FROM events WHERE event_type = 'click'), s AS (SELECT user_id % 3 AS domain, ts AS t, max(event_id) AS snap FROM events WHERE event_type = 'view' GROUP BY ALL)"


def _entropy(t: str) -> str:
    return _ENTROPY.format(t=f"({t})")


def _none(e: str) -> str:
    """What stands where there is no chain: null for doubles, -1 for whole numbers."""
    return "" if "round(" in e or "::DOUBLE" in e else "ELSE -1"


def _value_entropy(v: str) -> str:
    return _VALUES.format(v=v)


SQL = {
    "dns_record_features": f"""WITH {_REC} SELECT id, 0.0::DOUBLE AS dns_dnssec_score, CAST(zone <> '' AS BIGINT) AS dns_zone_level, CAST(zone <> '' AS BIGINT) AS dns_zone_digit_count, CAST(length(zone) AS BIGINT) AS dns_zone_len, round({_entropy('zone')}, 6) AS dns_zone_entropy,
      CAST(coalesce(len(a), 0) AS BIGINT) AS dns_A_count, CAST(aaaa AS BIGINT) AS dns_AAAA_count, CAST(coalesce(len(mx), 0) AS BIGINT) AS dns_MX_count, CAST(ns AS BIGINT) AS dns_NS_count, CAST(coalesce(len(txt), 0) AS BIGINT) AS dns_TXT_count, CAST(k % 3 = 0 AS BIGINT) AS dns_SOA_count, CAST(cname AS BIGINT) AS dns_CNAME_count,
      CAST((a IS NOT NULL)::INT + aaaa + cname + (mx IS NOT NULL)::INT + (ns > 0)::INT + (txt IS NOT NULL)::INT + (k % 3 = 0)::INT AS BIGINT) AS dns_resolved_record_types,
      round(list_avg(ttls), 6) AS dns_ttl_avg, round(list_stddev_pop(ttls), 6) AS dns_ttl_stdev, round(len(list_filter(ttls, lambda x: x < 101)) / len(ttls), 6) AS dns_ttl_low, round(len(list_filter(ttls, lambda x: x BETWEEN 101 AND 500)) / len(ttls), 6) AS dns_ttl_mid, CAST(len(list_distinct(ttls)) AS BIGINT) AS dns_ttl_distinct_count,
      CAST({_HAS_SOA} AS BIGINT) AS dns_soa_primary_ns_level, CASE WHEN {_HAS_SOA} THEN 1::BIGINT ELSE -1 END AS dns_soa_primary_ns_digit_count, CASE WHEN {_HAS_SOA} THEN CAST(length(soa_ns) AS BIGINT) ELSE -1 END AS dns_soa_primary_ns_len, CASE WHEN {_HAS_SOA} THEN round({_entropy('soa_ns')}, 6) END AS dns_soa_primary_ns_entropy,
      CAST({_HAS_SOA} AS BIGINT) AS dns_soa_email_level, CASE WHEN {_HAS_SOA} THEN 0::BIGINT ELSE -1 END AS dns_soa_email_digit_count, CASE WHEN {_HAS_SOA} THEN 17::BIGINT ELSE -1 END AS dns_soa_email_len, CASE WHEN {_HAS_SOA} THEN round({_entropy("'admin.example.com'")}, 6) END AS dns_soa_email_entropy,
      CASE WHEN {_HAS_SOA} THEN k % 7 * 100 ELSE -1 END AS dns_soa_refresh, CASE WHEN {_HAS_SOA} THEN 900::BIGINT ELSE -1 END AS dns_soa_retry, CASE WHEN {_HAS_SOA} THEN k % 5 ELSE -1 END AS dns_soa_expire, CASE WHEN {_HAS_SOA} THEN 60::BIGINT ELSE -1 END AS dns_soa_min_ttl,
      k % 3 = 1 AS dns_domain_name_in_mx, round(list_avg(list_transform(mx, lambda x: length(x))), 6) AS dns_mx_avg_len, CASE WHEN mx IS NOT NULL THEN round(({_entropy('mx[1]')} + {_entropy('mx[2]')}) / 2, 6) END AS dns_mx_avg_entropy,
      round(list_avg(list_transform(txt, lambda x: length(x))), 6) AS dns_txt_avg_len, CASE WHEN txt IS NOT NULL THEN round(({_entropy('txt[1]')} + {_entropy('txt[2]')} + {_entropy('txt[3]')}) / 3, 6) END AS dns_txt_avg_entropy, (txt IS NOT NULL)::INT::DOUBLE AS dns_txt_external_verification_score,
      CAST(txt IS NOT NULL OR k % 10 = 0 AS BIGINT) AS dns_txt_spf_exists, 0::BIGINT AS dns_txt_dkim_exists, CAST(k % 8 = 0 AS BIGINT) AS dns_txt_dmarc_exists FROM r""",
    "flat_records": f"""WITH {_REC} SELECT id, domain_name, txt IS NOT NULL OR k % 10 = 0 AS spf, false AS dkim, k % 8 = 0 AS dmarc, zone AS dns_zone, CASE WHEN cname = 1 THEN 'alias.example.org' END AS "dns_CNAME", CAST(k % 4 = 0 AS BIGINT) AS dns_has_dnskey, CASE WHEN k % 3 = 0 THEN k % 5 ELSE -1 END AS soa, CASE WHEN k % 3 = 1 THEN k % 5 ELSE -1 END AS zone_soa,
      3::BIGINT AS n_dns_ttls, CAST(coalesce(len(a), -1) AS BIGINT) AS "n_dns_A", CAST(CASE WHEN aaaa = 1 THEN 1 ELSE -1 END AS BIGINT) AS "n_dns_AAAA", CAST(coalesce(len(txt), -1) AS BIGINT) AS "n_dns_TXT", CAST(CASE WHEN ns = 2 THEN 2 ELSE -1 END AS BIGINT) AS "n_dns_NS", CAST(coalesce(len(mx), -1) AS BIGINT) AS "n_dns_MX",
      CAST(1 + (k % 3 = 0)::INT + (k % 4 = 1)::INT AS BIGINT) AS n_rdap_entities, CAST({_N} AS BIGINT) AS n_ip_data, CAST(CASE WHEN k % 3 <> 0 THEN k % 3 + 1 ELSE 0 END AS BIGINT) AS n_countries, CAST(CASE WHEN k % 3 <> 0 THEN k % 3 + 1 ELSE 0 END AS BIGINT) AS n_latitudes, CAST(CASE WHEN k % 3 <> 0 THEN k % 3 + 1 ELSE 0 END AS BIGINT) AS n_longitudes,
      '{AS_OF}' AS dns_evaluated_on, '{AS_OF}' AS rdap_evaluated_on, strftime(registered, '%Y-%m-%d') AS registered, strftime(expires, '%Y-%m-%d') AS expires, '1998-11-20' AS changed, CASE WHEN k % 4 = 0 THEN CAST(k % 8 = 0 AS VARCHAR) ELSE 'none' END AS signed FROM r""",
    "usable_records": "SELECT CASE c_custkey % 5 WHEN 0 THEN 'no record' WHEN 1 THEN 'invalid data' WHEN 2 THEN 'no domain name' ELSE 'usable' END AS why, count(*) AS n FROM customer GROUP BY 1",
    "ip_record_features": f"""WITH {_REC}, x AS (SELECT *, {_N} AS n FROM r), y AS (SELECT *, list_transform(range(0, n), lambda i: '10.' || (k + i) % 4) AS pre, CASE WHEN k % 2 = 0 THEN list_transform(range(0, n), lambda i: k % 3 + i) ELSE [] END AS nums FROM x)
      SELECT id, CAST(n AS BIGINT) AS ip_count, round(coalesce(coalesce(len(a), 0) / nullif(coalesce(len(a), 0) + aaaa, 0), 0), 6) AS ip_v4_ratio, round({_value_entropy('pre')}, 6) AS ip_entropy, CASE WHEN len(nums) > 0 THEN round({_value_entropy('nums')}, 6) END AS ip_as_address_entropy, CASE WHEN len(nums) > 0 THEN round({_value_entropy('nums')}, 6) END AS ip_asn_entropy, CASE WHEN len(nums) > 0 THEN CAST(len(list_distinct(nums)) AS BIGINT) ELSE -1 END AS ip_distinct_as_count FROM y""",
    "rdap_ip_record_features": f"""WITH {_REC}, x AS (SELECT *, {_N} AS n, k % 5 <> 0 AND k % 2 = 0 AS four, k % 5 <> 0 AND k % 2 = 1 AS six FROM r), y AS (SELECT *, n > 0 AND four AS f4, n > 0 AND six AS f6 FROM x)
      SELECT id, CASE WHEN four THEN n ELSE 0 END AS rdap_ip_v4_count, CASE WHEN six THEN n ELSE 0 END AS rdap_ip_v6_count, CASE WHEN f4 THEN k % 16 + 8 ELSE 0 END AS rdap_ip_shortest_v4_prefix_len, CASE WHEN f4 THEN k % 16 + 7 + n ELSE 0 END AS rdap_ip_longest_v4_prefix_len, CASE WHEN f6 THEN k % 16 + 8 ELSE 0 END AS rdap_ip_shortest_v6_prefix_len, CASE WHEN f6 THEN k % 16 + 7 + n ELSE 0 END AS rdap_ip_longest_v6_prefix_len,
      CASE WHEN n > 0 THEN length(seg)::DOUBLE ELSE 0 END AS rdap_ip_avg_admin_name_len, CASE WHEN n > 0 THEN round({_entropy('seg')}, 6) ELSE 0 END AS rdap_ip_avg_admin_name_entropy, CASE WHEN n > 0 THEN length(c_name)::DOUBLE ELSE 0 END AS rdap_ip_avg_admin_email_len, CASE WHEN n > 0 THEN round({_entropy('lower(c_name)')}, 6) ELSE 0 END AS rdap_ip_avg_admin_email_entropy FROM y""",
    "rdap_domain_record_features": f"""WITH {_REC}, x AS (SELECT *, TIMESTAMP '{AS_OF}' AS now, {_REG} AS reg, {_ADMIN} AS adm, {_EMAIL} AS mail FROM r)
      SELECT id, CASE WHEN registered IS NOT NULL AND expires IS NOT NULL THEN round({_DAYS.format(a='registered', b='expires')}, 6) END AS rdap_registration_period, CASE WHEN registered IS NOT NULL THEN round({_DAYS.format(a='registered', b='now')}, 6) END AS rdap_domain_age, 10.75::DOUBLE AS rdap_time_from_last_change,
      CASE WHEN registered IS NOT NULL THEN round({_DAYS.format(a='registered', b='CASE WHEN expires <= now THEN expires ELSE now END')}, 6) END AS rdap_domain_active_time, k % 4 = 0 AS rdap_has_dnssec, CAST(length(seg) AS BIGINT) AS rdap_registrar_name_len, round({_entropy('seg')}, 6) AS rdap_registrar_name_entropy, CAST(length(reg) AS BIGINT) AS rdap_registrant_name_len, round({_entropy('reg')}, 6) AS rdap_registrant_name_entropy,
      CAST(length(adm) AS BIGINT) AS rdap_admin_name_len, round({_entropy('adm')}, 6) AS rdap_admin_name_entropy, CAST(length(mail) AS BIGINT) AS rdap_admin_email_len, round(CASE WHEN mail <> '' THEN {_entropy('mail')} WHEN reg <> '' THEN {_entropy('reg')} ELSE 0 END, 6) AS rdap_admin_email_entropy FROM x""",
    "domain_signal_rows": f"""WITH {_REC}, x AS (SELECT *, {_AGED} AS age FROM r)
      SELECT id, 'Domain age' AS label, {_AGE_LABEL} AS value, CASE WHEN age < 60 THEN 'high' WHEN age < 400 THEN 'med' ELSE 'safe' END AS weight FROM x WHERE age IS NOT NULL AND registered IS NOT NULL
      UNION ALL SELECT id, 'Registrar', seg, 'low' FROM x UNION ALL SELECT id, 'Hosting country', 'Land ' || k % 4, 'low' FROM x WHERE k % 3 <> 0 UNION ALL SELECT id, 'DNSSEC', 'enabled', 'safe' FROM x WHERE k % 8 = 0""",
    "domain_evidence_rows": f"""WITH {_REC} SELECT id, seg AS registrar, coalesce(strftime(registered, '%Y-%m-%d'), 'unknown') AS created, coalesce(strftime(expires, '%Y-%m-%d'), 'unknown') AS expires, CASE WHEN registered IS NOT NULL THEN {_AGED} ELSE -1 END AS "ageDays", CASE WHEN k % 3 <> 0 THEN 'Land ' || k % 4 ELSE 'unknown' END AS country, k % 3 <> 0 OR k % 2 = 0 AS privacy,
      CASE WHEN a IS NULL THEN 'none' ELSE array_to_string(a, ', ') END AS a, CASE WHEN ns = 2 THEN 'ns1.example.com' ELSE 'none' END AS ns, coalesce(mx[1], 'none') AS mx FROM r""",
    "tls_record_features": f"""WITH {_TLS} SELECT id, present AS tls_has_tls, {', '.join(f'CASE WHEN present THEN {e} {_none(e)} END AS "tls_{n}"' for n, e in (
        ("chain_len", "o % 3 + 1"), ("is_self_signed", "0::BIGINT"), ("root_authority_hash", _MD5.format("CASE WHEN root THEN 'Org ' || (o + len(certs) - 1) % 5 ELSE '' END")), ("leaf_authority_hash", _MD5.format("CASE WHEN leaf THEN 'Org ' || o % 5 ELSE '' END")),
        ("negotiated_version_id", "CAST(CASE o % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS BIGINT)"), ("negotiated_cipher_id", "CAST(CASE o % 2 WHEN 0 THEN 1 ELSE 13 END AS BIGINT)"), ("root_cert_validity_len", "CASE WHEN root THEN 353 + d[len(certs)] ELSE -1 END::DOUBLE"), ("leaf_cert_validity_len", "CASE WHEN leaf THEN 353 + d[1] ELSE -1 END::DOUBLE"),
        ("broken_chain", "CAST(coalesce(stop = 1, false) AS BIGINT)"), ("expired_chain", "CAST(coalesce(stop = 2, false) AS BIGINT)"), ("total_extension_count", "CAST(n * (n + 1) // 2 - 1 AS BIGINT)"), ("critical_extensions", "CAST(CASE n WHEN 3 THEN 4 ELSE n END - 1 AS BIGINT)"), ("with_policies_crt_count", "CAST(pol AS BIGINT)"), ("percentage_crt_with_policies", "round(pol / seen, 6)"),
        ("x509_anypolicy_crt_count", "0::BIGINT"), ("iso_policy_crt_count", "CAST(pol AS BIGINT)"), ("joint_isoitu_policy_crt_count", "CAST(pol AS BIGINT)"), ("subject_count", "CASE WHEN leaf THEN o % 4 ELSE 0 END"), ("server_auth_crt_count", "CAST(n AS BIGINT)"), ("client_auth_crt_count", "CAST(n AS BIGINT)"), ("CA_certs_in_chain_ratio", "round(greatest(n - 1, 0) / seen, 6)"),
        ("unique_SLD_count", "CAST(CASE WHEN leaf THEN 2 ELSE 0 END AS BIGINT)"), ("common_name_count", "CAST(pol AS BIGINT)")))} FROM x""",
    "feed_recent": f"SELECT event_id, 'u' || user_id AS url, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS verified_at FROM events WHERE {_KEPT} AND event_id % 2 = 0 AND event_id % 3 <> 0",
    "feed_limit": f"SELECT event_id FROM events WHERE {_KEPT} ORDER BY event_id LIMIT 50",
    "labelled_union": "SELECT CAST(user_id AS VARCHAR) AS url, CASE WHEN bool_or(event_type = 'error') THEN 'phish' ELSE 'benign' END AS label FROM events GROUP BY user_id",
    "truncated_texts": "SELECT doc_id, md5(substr(text, 1, list_max(list_filter(range(0, 102), lambda i: strlen(substr(text, 1, i)) <= 101)))) AS digest FROM documents WHERE text IS NOT NULL",
    "event_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '1991-02-03' END AS registered FROM orders",
    "result_urls": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'h' WHEN c_custkey % 2 = 0 THEN 'u' ELSE 'l' END AS found FROM customer",
    "card_contacts": "SELECT c_custkey, c_mktsegment AS registrar, NULL::VARCHAR AS registrar_email, c_name AS admin, c_custkey || '@x.org' AS admin_email, false AS has_registrant FROM customer",
    "registration_values": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS registrar, CASE c_custkey % 3 WHEN 0 THEN 'co.uk' WHEN 1 THEN 'org' END AS suffix, c_custkey % 4 <> 0 AS spf, c_custkey % 4 <> 0 AND c_custkey % 2 = 0 AS dkim, false AS dmarc, CASE WHEN c_custkey % 3 <> 1 THEN c_custkey ELSE -1 END AS own, CASE WHEN c_custkey % 3 = 1 THEN c_custkey ELSE -1 END AS zone, '1.1.1.1/A,' || c_custkey % 2 || '/MX' AS sources, CAST(CASE WHEN c_custkey % 5 = 0 OR c_custkey % 2 = 0 THEN 6 ELSE 4 END AS BIGINT) AS version, CAST(CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_candidates FROM customer",
    "suffix_split": "SELECT c_custkey, CASE WHEN a THEN '' WHEN k = 2 THEN 'www.n' || c_custkey ELSE 'www' END AS subdomain, CASE WHEN a THEN '10.1.2.3' WHEN k = 2 THEN 'unlisted' ELSE 'n' || c_custkey END AS domain, CASE WHEN a OR k = 2 THEN '' ELSE ['co.uk', 'xyz', '', 'com.au', 'uk'][k + 1] END AS suffix FROM (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 17 = 0 AS a FROM customer)",
    "content_signal_rows": """WITH x AS (SELECT p_partkey, p_partkey AS k FROM part), s AS (
      SELECT p_partkey, 'Password input field' AS label, k % 3 || ' field(s)' AS value, 'high' AS weight FROM x WHERE k % 3 > 0 UNION ALL SELECT p_partkey, 'Form posts over HTTP', 'insecure', 'med' FROM x WHERE k % 2 > 0 UNION ALL SELECT p_partkey, 'Embedded iframe(s)', CAST(k % 4 AS VARCHAR), 'med' FROM x WHERE k % 4 > 0
      UNION ALL SELECT p_partkey, 'No TLS certificate', 'served over HTTP', 'high' FROM x WHERE k % 7 = 0 UNION ALL SELECT p_partkey, 'Self-signed certificate', 'untrusted', 'high' FROM x WHERE k % 7 <> 0 AND k % 2 > 0)
      SELECT * FROM s UNION ALL SELECT p_partkey, 'No risky content markers', 'clean', 'safe' FROM x WHERE p_partkey NOT IN (SELECT p_partkey FROM s)""",
    "answer_json": f"WITH {_PROB}, {_decide_sql(_M, 'mean')} SELECT l_orderkey, l_linenumber, CASE WHEN probability IS NULL THEN 'unknown' WHEN probability >= 0.5 THEN 'phish' ELSE 'benign' END AS decision, round(CASE WHEN probability >= 0.5 THEN probability ELSE 1 - probability END, 9) AS confidence, round(probability, 9) AS phish, round(1 - probability, 9) AS benign FROM e",
    "sanitized_values": "SELECT event_id, CASE WHEN event_id % 7 > 1 THEN event_id::DOUBLE END AS value, event_type AS raw, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events",
    "safe_numbers": "SELECT doc_id, coalesce(n_chars::DOUBLE, 0) AS n_chars, coalesce(TRY_CAST(source AS DOUBLE), 0) AS source, 0.0::DOUBLE AS absent FROM documents",
    "staged_run": f"WITH {_PROB}, q AS (SELECT l_orderkey, l_linenumber, max(p_url) AS p_url, max(p_content) AS p_content, max(p_domain) AS p_domain FROM p GROUP BY ALL), o AS (SELECT *, coalesce(p_url <= 0.5::DOUBLE - 0.49::DOUBLE OR p_url >= 0.5::DOUBLE + 0.49::DOUBLE, false) AS u, coalesce(p_content <= 0.5::DOUBLE - 0.28::DOUBLE OR p_content >= 0.5::DOUBLE + 0.28::DOUBLE, false) AS c FROM q) SELECT count(*) AS n, count(p_url) AS n_p_url, count(p_content) FILTER (WHERE NOT u) AS n_p_content, count(p_domain) FILTER (WHERE NOT u AND NOT c) AS n_p_domain FROM o",
    "asymmetric_exits": f"WITH {_PROB} SELECT coalesce(p_content <= 0.5::DOUBLE - 0.45::DOUBLE OR p_content >= 0.5::DOUBLE + 0.2::DOUBLE, false) AS exited, count(*) AS n FROM p GROUP BY 1",
    "loaded_policy": f"WITH {_PROB}, x AS (SELECT *, p_url <= 0.5::DOUBLE - 0.49::DOUBLE OR p_url >= 0.5::DOUBLE + 0.49::DOUBLE AS u, coalesce(p_content <= 0.5::DOUBLE - 0.3::DOUBLE OR p_content >= 0.5::DOUBLE + 0.3::DOUBLE, false) AS c FROM p), s AS (SELECT CASE WHEN u THEN 'url' WHEN c THEN 'content' WHEN p_content > p_url THEN 'content' ELSE 'url' END AS stage_id, p_url, p_content FROM x) SELECT stage_id, CASE WHEN CASE stage_id WHEN 'url' THEN p_url ELSE p_content END >= 0.5 THEN 'phish' ELSE 'benign' END AS decision, count(*) AS n FROM s GROUP BY ALL",
    "near_timeouts": f"WITH {_TIMINGS} SELECT stage, count(*) FILTER (WHERE collect_ms >= 0.9::DOUBLE * 50) AS n_near, count(*) FILTER (WHERE event_id % 3 = 0 OR event_id % 500 NOT BETWEEN 200 AND 399) AS n_degraded FROM x GROUP BY stage",
    "timed_outcomes": "WITH o AS (SELECT CASE event_id % 4 WHEN 0 THEN ['timeout', 'unreachable', 'error'][event_id % 3 + 1] WHEN 1 THEN 'feature_error' WHEN 2 THEN 'model_error' ELSE 'ok' END AS outcome FROM events), n AS (SELECT outcome, count(*) AS n FROM o GROUP BY outcome) SELECT outcome, CAST(coalesce(nullif(list_position(['ok', 'unreachable', 'timeout', 'feature_error', 'model_error'], outcome), 0), 6) AS BIGINT) AS rank, n, round(100 * n / sum(n) OVER (), 6) AS pct, min(n) OVER () AS least, max(n) OVER () AS most, round(avg(n) OVER (), 6) AS mean FROM n",
    "sweep_tenths": f"WITH {_PROB} SELECT i AS step, count(*) FILTER (WHERE y AND v) AS tp, count(*) FILTER (WHERE NOT y AND v) AS fp, 10 * count(*) FILTER (WHERE NOT y AND v) + 50 * count(*) FILTER (WHERE y AND NOT v) AS cost FROM (SELECT i, y, p_url >= i::DOUBLE / 100 AS v FROM p, range(0, 101, 10) r(i)) GROUP BY i",
    "selection_optimism": f"WITH {_TIMINGS}, c AS (SELECT stage, max(collect_ms) AS m, max(collect_ms) FILTER (WHERE event_id % 97 = 0) AS s FROM x GROUP BY stage) SELECT stage, round(any_value(m - s), 6) AS optimism, round(avg(CASE WHEN collect_ms <= s THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END), 6) AS percentile FROM x JOIN c USING (stage) GROUP BY stage",
    "run_totals": "SELECT count(*) AS attempts, count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 6 <> 0) AS stored, count(*) FILTER (WHERE event_id % 4 <> 0) AS domain_ok, count(*) FILTER (WHERE event_id % 6 <> 0) AS content_ok FROM events",
    "content_upsert": "WITH u AS (SELECT user_id AS url, min(ts) AS c, max(ts) AS p, max(event_type) AS label FROM events WHERE event_type <> 'view' GROUP BY 1), v AS (SELECT user_id AS url, min(ts) AS f, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS e FROM events WHERE event_type = 'view' GROUP BY 1) SELECT coalesce(u.url, v.url) AS url, strftime(coalesce(c, f), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(greatest(p, t), '%Y-%m-%d %H:%M:%S') AS updated_at, label, lpad(CAST(e AS VARCHAR), 12, '0') AS content, strftime(t, '%Y-%m-%d %H:%M:%S') AS content_at FROM u FULL JOIN v ON u.url = v.url",
    "as_of_hot_rows": f"WITH {_CLICKS} SELECT c.domain, 2 * count(*) AS n, 2 * count(s.snap) AS n_paired, CAST(2 * sum(s.snap) AS BIGINT) AS snaps FROM c ASOF LEFT JOIN s ON c.domain = s.domain AND c.at >= s.t GROUP BY c.domain",
    "missing_columns": "SELECT 'absent' AS missing, 'doc_id,lang,source,text' AS extra",
    "exact_holdout": "SELECT event_type, CAST(round(0.2 * count(*)) AS BIGINT) AS n_held, count(*) AS n FROM events GROUP BY event_type",
    "training_rows": "WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'phish' WHEN 'view' THEN 'benign' END AS label, user_id % 50 AS grp, event_id % 10 AS f FROM events WHERE event_id % 4 <> 0 AND event_type IN ('error', 'view')) SELECT min(event_id) AS event_id, arg_min(label, event_id) AS label, grp, arg_min(f, event_id) AS f, CAST(bool_or(label = 'phish') AS INT) AS y FROM e GROUP BY grp",
    "fold_balance": "SELECT CAST(5 AS BIGINT) AS n_folds, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_pos, true AS even, true AS even_pos, CAST(0 AS BIGINT) AS n_split FROM events",
}
