"""Features of domain records: DNS (39), addresses (6), location (18), name (48), registration (14 + 10).

Every function takes a DataFrame of flattened records (``flatten_records``) and returns it with its features; the
nested columns are arrays, maps and structs and all work is done on them in place, with no explode and no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions.text import col, count_matches, deviation, digit_count, entropy_by_length, largest, let, longest_run, mean, ratio, simhash32, smallest, total, value_entropy
from harrier.functions.urls import SUFFIXES, host_parts

# Fixed values.
VERIFIERS = ("google-site-verification=", "ms=", "apple-domain-verification=", "facebook-domain-verification=")
RISK_WORDS = (
    "account", "action", "alert", "app", "auth", "bank", "billing", "center", "chat", "device", "fax", "event",
    "find", "free", "gift", "help", "info", "invoice", "live", "location", "login", "mail", "map", "message",
    "my", "new", "nitro", "now", "online", "pay", "promo", "real", "required", "safe", "secure", "security",
    "service", "signin", "support", "track", "update", "verification", "verify", "vm", "web",
)
ABUSE_SCORES = {
    "com": 0.6554, "net": 0.1040, "eu": 0.0681, "name": 0.0651, "co": 0.0107, "life": 0.0087, "moe": 0.0081, "org": 0.0081,
    "xyz": 0.0072, "site": 0.0051, "ch": 0.0051, "it": 0.0048, "club": 0.0046, "info": 0.0043, "de": 0.0041, "racing": 0.0040,
    "live": 0.0035, "ru": 0.0034, "cc": 0.0034, "mobi": 0.0029, "me": 0.0023, "au": 0.0020, "cn": 0.0019, "pw": 0.0014,
    "in": 0.0011, "fr": 0.0010, "be": 0.0010, "pro": 0.0010, "top": 0.0009, "stream": 0.0007,
}
HOSTING_RISK_IDS = (187, 144, 37, 24, 192, 184, 78)
UNKNOWN_COUNTRY = 300
RAW_COLUMNS = (
    "dns_email_extras", "dns_ttls", "dns_zone", "dns_SOA", "dns_zone_SOA", "dns_A", "dns_AAAA", "dns_TXT", "dns_NS", "dns_MX", "dns_CNAME",
    "dns_evaluated_on", "rdap_evaluated_on", "rdap_registration_date", "rdap_expiration_date", "rdap_last_changed_date", "rdap_dnssec",
    "rdap_entities", "ip_data", "countries", "latitudes", "longitudes",
)


def flatten_records(df: DataFrame, record: str = "record") -> DataFrame:
    """The 24 flat columns of the nested records; entries without an address or a location are left out of the lists."""
    r = lambda path: F.col(f"{record}.{path}")
    located = F.filter(r("ip_data"), lambda x: x["geo"].isNotNull())
    kept = [F.col(f"`{c}`") for c in df.columns if c != record]
    text = lambda name: F.exists(F.coalesce(r("dns.TXT"), F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit(name)))
    given = lambda name: F.coalesce(r(f"dns.remarks.has_{name}"), F.lit(False))
    mx = F.transform(F.filter(F.map_entries(r("dns.MX")), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("name"), e["value"]["priority"].alias("priority")))
    flat = {
        "domain_name": r("domain_name"),
        "dns_email_extras": F.struct((given("spf") | text("v=spf1")).alias("spf"), (given("dkim") | text("dkim")).alias("dkim"), (given("dmarc") | text("dmarc")).alias("dmarc")),
        "dns_ttls": r("dns.ttls"),
        "dns_zone": F.coalesce(r("dns.remarks.zone"), F.lit("")),
        "dns_SOA": r("dns.SOA"),
        "dns_zone_SOA": r("dns.zone_SOA"),
        "dns_A": r("dns.A"),
        "dns_AAAA": r("dns.AAAA"),
        "dns_TXT": r("dns.TXT"),
        "dns_NS": F.map_keys(r("dns.NS")),
        "dns_MX": mx,
        "dns_CNAME": r("dns.CNAME.value"),
        "dns_has_dnskey": F.coalesce(r("dns.remarks.has_dnskey").cast("long"), F.lit(0).cast("long")),
        "dns_evaluated_on": r("remarks.dns_evaluated_on"),
        "rdap_evaluated_on": r("remarks.rdap_evaluated_on"),
        "rdap_registration_date": r("rdap.registration_date"),
        "rdap_expiration_date": r("rdap.expiration_date"),
        "rdap_last_changed_date": r("rdap.last_changed_date"),
        "rdap_dnssec": r("rdap.dnssec"),
        "rdap_entities": r("rdap.entities"),
        "ip_data": F.filter(r("ip_data"), lambda x: F.trim(F.coalesce(x["ip"], F.lit(""))) != ""),
        "countries": F.transform(located, lambda x: x["geo"]["country_code"]),
        "latitudes": F.transform(located, lambda x: x["geo"]["latitude"]),
        "longitudes": F.transform(located, lambda x: x["geo"]["longitude"]),
    }
    return df.select(*kept, *(c.alias(n) for n, c in flat.items()))


def record_errors(df: DataFrame, record: str = "record") -> Column:
    """Why a record can't be used, or null."""
    return F.when(F.col(record).isNull(), "no record").when(F.coalesce(F.col(f"{record}.invalid_data"), F.lit(False)), "invalid data").when(F.coalesce(F.col(f"{record}.domain_name"), F.lit("")) == "", "no domain name")


def subdomain_count(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Labels above the registered domain, less one if "www" is among them."""
    labels = F.filter(F.split(host_parts(name, suffixes)["subdomain"], r"\."), lambda x: x != "")
    return let(labels, lambda x: (F.size(x) - F.array_contains(x, "www").cast("int")).cast("long"))


def _name(prefix: str, text: Column, suffixes: Sequence[str]) -> dict[str, Column]:
    return {f"{prefix}_level": subdomain_count(text, suffixes), f"{prefix}_digit_count": digit_count(text), f"{prefix}_len": F.length(text).cast("long"), f"{prefix}_entropy": entropy_by_length(text)}


def dns_features(df: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    count = {f"dns_{c}_count": F.when(F.col(f"dns_{c}").isNull(), 0).otherwise(size(f"dns_{c}")).cast("long") for c in ("A", "AAAA", "MX", "NS", "TXT")}
    count |= {f"dns_{c}_count": F.col(f"dns_{c}").isNotNull().cast("long") for c in ("SOA", "CNAME")}
    kinds = sum((F.col(f"dns_{c}").isNotNull().cast("long") for c in ("AAAA", "CNAME", "MX", "NS", "TXT", "SOA")), F.col("dns_A").isNotNull().cast("long"))
    out = df.withColumns({"dns_dnssec_score": F.lit(0.0), **_name("dns_zone", F.col("dns_zone"), suffixes), **count, "dns_resolved_record_types": kinds})
    soa = F.when(F.col("dns_SOA").isNull() & (F.col("dns_zone_level") > 0), F.col("dns_zone_SOA")).otherwise(F.col("dns_SOA"))
    helpers = {"__soa": soa, "__ttls": F.array_compact(F.map_values("dns_ttls")), "__names": F.transform("dns_MX", lambda m: m["name"]), "__written": F.filter("dns_TXT", lambda t: F.length(t) > 0)}
    out = out.withColumns(helpers)
    ttls, names, written = F.col("__ttls"), F.col("__names"), F.col("__written")
    share = lambda test: F.size(F.filter(ttls, test)).cast("double") / F.size(ttls)
    some = F.coalesce(F.size(ttls), F.lit(0)) > 0
    entropies = total(F.transform(written, entropy_by_length))
    marks = lambda t: sum((F.contains(t, F.lit(v)).cast("int") for v in VERIFIERS[1:]), F.contains(t, F.lit(VERIFIERS[0])).cast("int"))
    hits = F.aggregate(F.transform(written, F.lower), F.lit(0), lambda a, t: a + marks(t))
    features = {
        "dns_ttl_avg": F.when(some, mean(ttls)),
        "dns_ttl_stdev": F.when(some, deviation(ttls)),
        "dns_ttl_low": F.when(some, share(lambda t: t < 101)),
        "dns_ttl_mid": F.when(some, share(lambda t: (t >= 101) & (t < 501))),
        "dns_ttl_distinct_count": F.when(some, F.size(F.array_distinct(ttls)).cast("long")),
        **_name("dns_soa_primary_ns", F.col("__soa.primary_ns"), suffixes),
        **_name("dns_soa_email", F.col("__soa.resp_mailbox_dname"), suffixes),
        **{f"dns_soa_{c}": F.col(f"__soa.{c}").cast("long") for c in ("refresh", "retry", "expire", "min_ttl")},
        "dns_domain_name_in_mx": F.coalesce(F.array_contains(names, F.col("domain_name")), F.lit(False)),
        "dns_mx_avg_len": F.when(F.size("dns_MX") > 0, mean(F.transform(names, F.length))),
        "dns_mx_avg_entropy": F.when(F.size("dns_MX") > 0, mean(F.transform(names, entropy_by_length))),
        "dns_txt_avg_len": F.when(F.col("dns_TXT").isNotNull(), F.coalesce(F.try_divide(total(F.transform(written, F.length)), F.size("dns_TXT")), F.lit(0.0))),
        "dns_txt_avg_entropy": let(entropies, lambda e: F.when(e > 0, e / F.size(written))),
        "dns_txt_external_verification_score": F.coalesce(hits, F.lit(0)).cast("double"),
        **{f"dns_txt_{c}_exists": F.coalesce(F.col(f"dns_email_extras.{c}"), F.lit(False)).cast("long") for c in ("spf", "dkim", "dmarc")},
    }
    return out.withColumns(features).drop(*helpers)


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number."""
    return F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))


def ipv6_prefix(ip: Column) -> Column:
    """The first four groups of an IPv6 address, written in full."""
    head, tail = F.split(F.split(ip, "::")[0], ":"), F.split(F.coalesce(F.get(F.split(ip, "::"), F.lit(1)), F.lit("")), ":")
    head, tail = (F.filter(x, lambda g: g != "") for x in (head, tail))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0)))
    groups = F.slice(F.concat(head, F.when(F.contains(ip, F.lit("::")), zeros).otherwise(F.array().cast("array<string>")), tail), 1, 4)
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), ":")


def ip_features(df: DataFrame) -> DataFrame:
    """Needs the record counts of ``dns_features``."""
    data = F.coalesce(F.col("ip_data"), F.array().cast(df.schema["ip_data"].dataType))
    four = lambda values: F.filter(values, lambda x: ~F.contains(x, F.lit(":")))
    six = lambda values: F.filter(values, lambda x: F.contains(x, F.lit(":")))
    ips = F.transform(data, lambda x: x["ip"])
    prefixes = value_entropy(F.transform(four(ips), lambda x: F.substring_index(x, ".", 2))) + value_entropy(F.transform(six(ips), ipv6_prefix))
    systems = F.filter(F.transform(data, lambda x: x["asn"]), lambda a: a.isNotNull())
    numbers = F.filter(F.transform(systems, lambda a: a["asn"]), lambda n: n.isNotNull())
    networks = F.filter(F.transform(systems, lambda a: a["network_address"]), lambda n: n.isNotNull())
    some, addresses = F.size(numbers) > 0, F.col("dns_A_count") + F.col("dns_AAAA_count")
    return df.withColumns(
        {
            "ip_count": F.size(data).cast("long"),
            "ip_v4_ratio": F.coalesce(F.try_divide(F.col("dns_A_count").cast("double"), addresses), F.lit(0.0)),
            "ip_entropy": prefixes,
            "ip_as_address_entropy": F.when(some, value_entropy(four(networks)) + value_entropy(six(networks))),
            "ip_asn_entropy": F.when(some, value_entropy(numbers)),
            "ip_distinct_as_count": F.when(some, F.size(F.array_distinct(numbers)).cast("long")),
        }
    )


def country_hash(ids: Column, n_countries: int) -> Column:
    """A fold over the ascending distinct ids that doubles whenever it exceeds the number of countries."""
    step = lambda a, i: F.when(a + i > n_countries, (a + i) * 2).otherwise(a + i)
    return F.aggregate(F.array_sort(F.array_distinct(ids)), F.lit(0).cast("long"), lambda a, i: step(a, i.cast("long"))) % 2147483647


def geo_features(df: DataFrame, country_ids: Mapping[str, int] | None = None) -> DataFrame:
    """country_ids: a number for each country code (default: none is known)."""
    known = country_ids or {}
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v)))) if known else F.create_map().cast("map<string,int>")
    countries = F.coalesce("countries", F.array().cast("array<string>"))
    # a list with nulls in it has them as one more value
    ids = F.transform(countries, lambda c: F.when(c.isNull(), UNKNOWN_COUNTRY).otherwise(F.coalesce(F.try_element_at(table, F.coalesce(c, F.lit(""))), F.lit(UNKNOWN_COUNTRY))))
    some = F.size(countries) > 0
    lat, lon = F.col("latitudes"), F.col("longitudes")
    out = df.withColumns(
        {
            "geo_countries_count": F.size(F.array_distinct(countries)).cast("long"),
            "geo_continents_count": some.cast("long"),
            "geo_malic_host_country": F.exists(ids, lambda i: i.isin(*HOSTING_RISK_IDS)).cast("long"),
            **{f"geo_{n}_stdev": deviation(c) for n, c in (("lat", lat), ("lon", lon))},
            **{f"geo_mean_{n}": mean(c) for n, c in (("lat", lat), ("lon", lon))},
            **{f"geo_min_{n}": smallest(c) for n, c in (("lat", lat), ("lon", lon))},
            **{f"geo_max_{n}": largest(c) for n, c in (("lat", lat), ("lon", lon))},
            "geo_continent_hash": F.lit(0).cast("long"),
            "geo_countries_hash": F.when(some, country_hash(ids, len(known))).otherwise(0).cast("long"),
        }
    )
    out = out.withColumns({f"geo_{n}_range": F.col(f"geo_max_{n}") - F.col(f"geo_min_{n}") for n in ("lat", "lon")} | {f"geo_centroid_{n}": F.col(f"geo_min_{n}") + F.col(f"geo_max_{n}") / 2 for n in ("lat", "lon")})
    return out.withColumn("geo_estimated_area", F.col("geo_lat_range") * F.col("geo_lon_range"))


def _letters(prefix: str, text: Column) -> dict[str, Column]:
    """Counts and ratios of character classes; y is a vowel and a consonant."""
    parts = {
        "digit": digit_count(text),
        "vowel": count_matches(F.lower(text), "[aeiouy]"),
        "consonant": count_matches(text, "[b-df-hj-np-tv-z]"),
        "non_alphanum": count_matches(text, r"[^\p{L}\p{N}]"),
        "hex": count_matches(text, "[0-9A-Fa-f]"),
    }
    return {f"{prefix}_{n}_count": c for n, c in parts.items()} | {f"{prefix}_{n}_ratio": ratio(c, text) for n, c in parts.items()}


def contained(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains."""
    return F.size(F.filter(F.array(*(F.lit(w) for w in words)).cast("array<string>"), lambda w: F.contains(text, w))).cast("long")


def name_features(df: DataFrame, name: str = "domain_name", ngrams: Mapping[int, Sequence[str]] | None = None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """48 features of domain names. ngrams: by length (2 to 5), those to look for."""
    host, ngrams = col(name), ngrams or {}
    out = df.withColumn("__p", host_parts(host, suffixes))
    tld, sld = F.col("__p.suffix"), F.col("__p.domain")
    out = out.withColumn("__sub", F.replace(F.concat(F.col("__p.subdomain"), sld), F.lit("."), F.lit("")))
    sub, lengths = F.col("__sub"), F.transform(F.split(host, r"\."), F.length)
    between = lambda a, b: F.size(F.filter(lengths, lambda n: n.between(a, b))).cast("long")
    abuse = F.create_map(*(x for k, v in ABUSE_SCORES.items() for x in (F.lit(k), F.lit(v))))
    runs = F.transform(F.regexp_extract_all(host, F.lit(r"(?s)((.)\2*)"), F.lit(1)), F.length)
    features = {
        "lex_name_len": F.length(host).cast("long"),
        "lex_has_digit": (digit_count(host) > 0).cast("long"),
        "lex_phishing_keyword_count": contained(host, RISK_WORDS),
        "lex_consecutive_chars": F.coalesce(F.array_max(runs), F.lit(0)).cast("long"),
        "lex_tld_len": F.length(tld).cast("long"),
        "lex_tld_abuse_score": F.coalesce(F.try_element_at(abuse, tld), F.lit(0.0)),
        "lex_tld_hash": simhash32(tld),
        "lex_sld_len": F.length(sld).cast("long"),
        "lex_sld_norm_entropy": entropy_by_length(sld),
        **_letters("lex_sld", sld),
        "lex_sld_phishing_keyword_count": contained(sld, RISK_WORDS),
        "lex_sub_count": subdomain_count(host, suffixes),
        "lex_stld_unique_char_count": F.size(F.array_distinct(F.filter(F.split(F.replace(F.concat(sld, tld), F.lit("."), F.lit("")), ""), lambda c: c != ""))).cast("long"),
        "lex_begins_with_digit": host.rlike(r"(?U)^\d").cast("long"),
        "lex_www_flag": (F.split(host, r"\.")[0] == "www").cast("long"),
        "lex_sub_max_consonant_len": longest_run(F.lower(sub), "[b-df-hj-np-tv-z]+"),
        "lex_sub_norm_entropy": entropy_by_length(sub),
        **_letters("lex_sub", sub),
        **{f"lex_phishing_{n}_matches": contained(sub, ngrams.get(k, ())) for k, n in ((2, "bigram"), (3, "trigram"), (4, "tetragram"), (5, "pentagram"))},
        "lex_avg_part_len": mean(lengths),
        "lex_stdev_part_lens": deviation(lengths),
        "lex_longest_part_len": largest(lengths).cast("long"),
        "lex_short_part_count": between(0, 3),
        "lex_medium_part_count": between(4, 10),
        "lex_long_part_count": between(11, 30),
        "lex_superlong_part_count": F.size(F.filter(lengths, lambda n: n >= 31)).cast("long"),
        "lex_shortest_sub_len": F.length(sub).cast("long"),
    }
    return out.withColumns(features).drop("__p", "__sub")


def _days(start: Column, end: Column) -> Column:
    """Days between two times, none below zero; null if either is."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6)))


def rdap_domain_features(df: DataFrame, as_of: Column) -> DataFrame:
    """Ages and contacts from registration data, at the time ``as_of``."""
    start, end, changed = (F.col(f"rdap_{c}_date") for c in ("registration", "expiration", "last_changed"))
    contact = lambda role: F.get(F.try_element_at(F.col("rdap_entities"), F.lit(role)), F.lit(0))
    text = lambda role, field: F.coalesce(contact(role)[field], F.lit(""))
    registrar, registrant, admin, email = text("registrar", "name"), text("registrant", "name"), text("administrative", "name"), text("administrative", "email")
    has = lambda role, field: contact(role)[field].isNotNull()
    # without an administrative address its entropy is that of the registrant's name
    leaked = F.when(has("administrative", "email"), entropy_by_length(email)).when(has("registrant", "name"), entropy_by_length(registrant)).otherwise(0.0)
    return df.withColumns(
        {
            "rdap_registration_period": _days(start, end),
            "rdap_domain_age": _days(start, as_of),
            "rdap_time_from_last_change": _days(changed, as_of),
            "rdap_domain_active_time": _days(start, F.when(end.isNull() | (end > as_of), as_of).otherwise(end)),
            "rdap_has_dnssec": F.col("rdap_dnssec").isNotNull(),
            "rdap_registrar_name_len": F.length(registrar).cast("long"),
            "rdap_registrar_name_entropy": entropy_by_length(registrar),
            "rdap_registrar_name_hash": F.when(has("registrar", "name"), simhash32(registrar)).otherwise(0).cast("long"),
            "rdap_registrant_name_len": F.length(registrant).cast("long"),
            "rdap_registrant_name_entropy": entropy_by_length(registrant),
            "rdap_admin_name_len": F.length(admin).cast("long"),
            "rdap_admin_name_entropy": entropy_by_length(admin),
            "rdap_admin_email_len": F.length(email).cast("long"),
            "rdap_admin_email_entropy": leaked,
        }
    )


def rdap_ip_features(df: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("ip_data"), F.array().cast(df.schema["ip_data"].dataType))
    known = F.filter(F.transform(data, lambda x: x["rdap"]), lambda r: r["ip_version"].isNotNull())
    four, six = F.filter(known, lambda r: r["ip_version"] == 4), F.filter(known, lambda r: r["ip_version"] != 4)
    lengths = lambda version: F.array_compact(F.transform(version, lambda r: r["network"]["prefix_length"]))
    contacts = F.transform(F.transform(data, lambda x: x["rdap"]), lambda r: F.get(F.try_element_at(r["entities"], F.lit("administrative")), F.lit(0)))
    per_ip = lambda f, field: F.coalesce(F.try_divide(total(F.transform(F.filter(contacts, lambda c: c[field].isNotNull()), lambda c: f(c[field]))), F.size(data)), F.lit(0.0))
    features = {f"rdap_ip_v{v}_count": F.size(x).cast("long") for v, x in ((4, four), (6, six))}
    for v, x in ((4, four), (6, six)):
        features[f"rdap_ip_shortest_v{v}_prefix_len"] = F.coalesce(F.array_min(lengths(x)), F.lit(0)).cast("long")
        features[f"rdap_ip_longest_v{v}_prefix_len"] = F.coalesce(F.array_max(lengths(x)), F.lit(0)).cast("long")
    for field in ("name", "email"):
        features[f"rdap_ip_avg_admin_{field}_len"] = per_ip(F.length, field)
        features[f"rdap_ip_avg_admin_{field}_entropy"] = per_ip(entropy_by_length, field)
    return df.withColumns(features)


def drop_raw(df: DataFrame) -> DataFrame:
    return df.drop(*RAW_COLUMNS)


#: Transformations in their order; later ones may need columns of earlier ones.
TRANSFORMATIONS = {"dns": dns_features, "ip": ip_features, "geo": geo_features, "lexical": name_features, "rdap_dn": rdap_domain_features, "rdap_ip": rdap_ip_features, "drop_columns": drop_raw}


def domain_features(df: DataFrame, as_of: Column, enabled: Sequence[str] = tuple(TRANSFORMATIONS), country_ids: Mapping[str, int] | None = None, ngrams: Mapping[int, Sequence[str]] | None = None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """The enabled transformations over flattened records, in the registry's order whatever that of ``enabled``."""
    unknown = set(enabled) - set(TRANSFORMATIONS)
    if unknown:
        raise ValueError(f"unknown transformations: {sorted(unknown)}")
    options = {"dns": {"suffixes": suffixes}, "geo": {"country_ids": country_ids}, "lexical": {"ngrams": ngrams, "suffixes": suffixes}, "rdap_dn": {"as_of": as_of}}
    for name, transform in TRANSFORMATIONS.items():
        if name in enabled:
            df = transform(df, **options.get(name, {}))
    return df


def network_of(ips: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """ips with the columns of the longest network that holds each IPv4 address (networks: start, end, prefix_len, ...).

    Addresses meet networks by their first sixteen bits: a network of sixteen bits or more has one such key, a wider one
    a key for each value it spans (256 for eight bits). So the join is on equal keys and spreads over the cluster.
    """
    extra = [c for c in networks.columns if c not in ("start", "end")]
    keyed = networks.withColumn("__key", F.explode(F.sequence(F.shiftright("start", 16), F.shiftright("end", 16))))
    numbered = ips.withColumn("__n", ipv4_number(F.col(ip))).withColumn("__key", F.shiftright("__n", 16))
    inside = (numbered["__key"] == keyed["__key"]) & (F.col("__n") >= F.col("start")) & (F.col("__n") <= F.col("end"))
    met = numbered.join(keyed, inside).select(ip, *extra, "start")
    best = met.groupBy(ip).agg(F.max(F.struct("prefix_len", "start", *(c for c in extra if c != "prefix_len"))).alias("__b"))
    return ips.join(best, ip, "left").select(*(ips[c] for c in ips.columns), *(F.col(f"__b.{c}").alias(c) for c in extra))
