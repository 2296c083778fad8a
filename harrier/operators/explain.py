"""Signals, evidence and payloads that explain a verdict, as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.operators.html_features import page_title
from harrier.plans.cascade import NEGATIVE, POSITIVE, Policy

SIGNAL = "struct<label: string, value: string, weight: string>"


def number(df: DataFrame, name: str) -> Column:
    """A feature as a number; 0 where it is missing or isn't one."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(f"`{name}`").try_cast("double"), F.lit(0.0))


def _signal(when: Column, label: str, value: Column | str, weight: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(F.lit(label).alias("label"), as_column(value).alias("value"), as_column(weight).alias("weight")))


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("int").cast("string"), F.lit(unit))


def sanitized(df: DataFrame) -> DataFrame:
    """df with what JSON can't hold made plain: NaN and infinite numbers null, binary as text, times as ISO 8601."""

    def plain(c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        if kind == "binary":
            return F.try_validate_utf8(x.cast("string"))
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else x

    return df.select(*(plain(c, kind).alias(c) for c, kind in df.dtypes))


# Labels, values, weights and limits of the signals below are fixed values.


def url_signals(df: DataFrame) -> Column:
    n = lambda c: number(df, c)
    words, brands = n("keyword_count") + n("target_keyword_count"), n("target_brand_count") + n("similar_brand_count")
    rules = [
        _signal(n("domain_in_brand_list") > 0, "Recognized brand domain", "allow-listed", "safe"),
        _signal(n("punnyCode") > 0, "Punycode / IDN host", "xn--", "high"),
        _signal(n("@") > 0, "'@' symbol in URL", "present", "high"),
        _signal(n("-") >= 2, "Multiple hyphens in domain", _counted(n("-"), " hyphens"), "med"),
        _signal(n("subDomainCount") >= 3, "Deep sub-domain nesting", _counted(n("subDomainCount"), " levels"), "med"),
        _signal(words > 0, "Credential-themed keywords", _counted(words, " match(es)"), F.when(words > 1, "high").otherwise("med")),
        _signal((brands > 0) & (n("domain_in_brand_list") == 0), "Brand look-alike terms", _counted(brands, " match(es)"), "med"),
        _signal(n("random_domain") > 0, "Random-looking domain", "high entropy", "med"),
    ]
    if "isKnownTld" in df.columns:
        rules.append(_signal(n("isKnownTld") == 0, "Uncommon TLD", "not in known set", "low"))
    return F.array_compact(F.array(*rules))


def content_signals(df: DataFrame) -> Column:
    n = lambda c: number(df, c)
    packed = n("html_eval") + n("html_unescape") + n("html_from_char_code") + n("html_char_code_at")
    tls = n("tls_has_tls") != 0
    found = F.array_compact(
        F.array(
            _signal(n("html_num_of_input_password") > 0, "Password input field", _counted(n("html_num_of_input_password"), " field(s)"), "high"),
            _signal(n("html_malicious_form") > 0, "Suspicious form action", "flagged", "high"),
            _signal(n("html_num_of_form_http") > 0, "Form posts over HTTP", "insecure", "med"),
            _signal(n("html_num_of_iframe") > 0, "Embedded iframe(s)", _counted(n("html_num_of_iframe"), ""), "med"),
            _signal(packed > 0, "Obfuscated inline script", "eval / unescape / fromCharCode", "med"),
            _signal(~tls, "No TLS certificate", "served over HTTP", "high"),
            _signal(tls & (n("tls_is_self_signed") > 0), "Self-signed certificate", "untrusted", "high"),
            _signal(tls & (n("tls_expired_chain") > 0), "Expired certificate chain", "expired", "high"),
        )
    )
    clean = F.array(F.struct(F.lit("No risky content markers").alias("label"), F.lit("clean").alias("value"), F.lit("safe").alias("weight")))
    return F.when(F.size(found) > 0, found).otherwise(clean)


def age_days(created: Column, as_of: Column) -> Column:
    """Whole days, none below zero; null without a time."""
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / F.lit(86400e6))
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days)).cast("long")


def age_label(days: Column) -> Column:
    """Days, months or years in words."""
    months = F.bround(days / 30).cast("long").cast("string")
    return F.when(days < 60, F.concat(days.cast("string"), F.lit(" days"))).when(days < 730, F.concat(months, F.lit(" months"))).otherwise(F.format_string("%.1f years", days / 365.0))


def _contact(record: str, role: str) -> Column:
    return F.get(F.try_element_at(F.col(f"{record}.rdap.entities"), F.lit(role)), F.lit(0))


def hosting_location(record: str) -> Column:
    return F.get(F.filter(F.transform(F.col(f"{record}.ip_data"), lambda x: x["geo"]), lambda g: F.coalesce(g["country"], F.lit("")) != ""), F.lit(0))


def domain_signals(record: str, as_of: Column) -> Column:
    days = age_days(F.col(f"{record}.rdap.registration_date"), as_of)
    registrar, country = _contact(record, "registrar")["name"], hosting_location(record)["country"]
    return F.array_compact(
        F.array(
            _signal(days.isNotNull(), "Domain age", age_label(days), F.when(days < 60, "high").when(days < 400, "med").otherwise("safe")),
            _signal(F.coalesce(registrar, F.lit("")) != "", "Registrar", registrar, "low"),
            _signal(country.isNotNull(), "Hosting country", country, "low"),
            _signal(F.coalesce(F.col(f"{record}.rdap.dnssec.delegationSigned"), F.lit(False)), "DNSSEC", "enabled", "safe"),
        )
    )


def privacy_masked(record: str) -> Column:
    """Whether the registrant has no name, or one that hides it."""
    name = F.lower(F.coalesce(_contact(record, "registrant")["name"], F.lit("")))
    return (name == "") | name.rlike("privacy|redacted|protected|withheld")


def domain_evidence(record: str, as_of: Column) -> Column:
    created, days = F.col(f"{record}.rdap.registration_date"), age_days(F.col(f"{record}.rdap.registration_date"), as_of)
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    first = lambda c: F.coalesce(F.get(F.map_keys(F.col(f"{record}.dns.{c}")), F.lit(0)), F.lit("none"))
    addresses = F.array_join(F.slice(F.col(f"{record}.dns.A"), 1, 3), ", ")
    whois = F.struct(
        unknown(F.nullif(_contact(record, "registrar")["name"], F.lit(""))).alias("registrar"),
        unknown(day(created)).alias("created"),
        unknown(day(F.col(f"{record}.rdap.expiration_date"))).alias("expires"),
        days.alias("ageDays"),
        unknown(age_label(days)).alias("ageLabel"),
        unknown(hosting_location(record)["country"]).alias("country"),
        privacy_masked(record).alias("privacy"),
    )
    rows = F.array(*(F.struct(F.lit(t).alias("type"), v.alias("value")) for t, v in (("A", F.coalesce(F.nullif(addresses, F.lit("")), F.lit("none"))), ("NS", first("NS")), ("MX", first("MX")))))
    return F.struct(whois.alias("whois"), rows.alias("dns"))


def content_evidence(df: DataFrame, html: str = "html") -> Column:
    optional = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    return F.struct(
        page_title(html).alias("pageTitle"),
        optional("final_url", "string").alias("finalUrl"),
        F.coalesce(optional("redirect_count", "int"), F.lit(0)).alias("redirects"),
        optional("status_code", "int").alias("statusCode"),
        (number(df, "html_num_of_input_password") > 0).alias("hasPwForm"),
    )


def result_json() -> Column:
    """decision, label, confidence, stage and probability of a decided row, as JSON."""
    chances = F.when(F.col("probability").isNotNull(), F.create_map(F.lit(POSITIVE), F.col("probability"), F.lit(NEGATIVE), 1 - F.col("probability")))
    return F.to_json(F.struct("decision", F.when(F.col("decision") != "unknown", F.col("decision")).alias("label"), "confidence", "stage_id", chances.alias("probabilities")))


def stage_cards(policy: Policy) -> Column:
    """A card for each stage of a decided row: its band, score, whether it ran, decided, escalated or was skipped."""
    cards = []
    for i, stage in enumerate(policy.stages):
        m = policy.margin_of(stage)
        p, ran = F.when(F.col("n_ran") > i, F.col(stage.probability)), F.col("n_ran") > i
        exits = F.coalesce((p <= 0.5 - m) | (p >= 0.5 + m), F.lit(False))
        decided = F.col("exited") & (F.col("stage_id") == stage.name)
        cards.append(
            F.struct(
                F.lit(i + 1).alias("id"),
                F.lit(stage.name).alias("key"),
                F.lit(m).alias("margin"),
                F.lit(0.5 - m).alias("bandLow"),
                F.lit(0.5 + m).alias("bandHigh"),
                p.alias("score"),
                ran.alias("ran"),
                (~ran).alias("skipped"),
                decided.alias("decided"),
                (ran & ~decided).alias("escalated"),
                exits.alias("exited"),
                F.when(exits, F.when(p >= 0.5, POSITIVE).otherwise(NEGATIVE)).alias("exitSide"),
                F.when(F.coalesce(p >= 0.5, F.lit(False)), "phishing").otherwise("legitimate").alias("verdict"),
            )
        )
    return F.array(*cards)


def payload(policy: Policy, url: str = "url") -> Column:
    """The whole answer for a decided row, as a struct for ``to_json``."""
    verdict = F.when(F.col("decision") == POSITIVE, "phishing").when(F.col("decision") == NEGATIVE, "legitimate").otherwise("unknown")
    mode = F.when(verdict == "unknown", "unknown").when(F.col("exited"), "early-exit").otherwise("aggregation")
    names = F.array(*(F.lit(s.name) for s in policy.stages))
    return F.struct(
        F.col(url).alias("url"),
        verdict.alias("verdict"),
        F.col("decision"),
        mode.alias("decisionMode"),
        F.nullif(F.array_position(names, F.col("stage_id")), F.lit(0)).alias("decidingStage"),
        F.lit(policy.aggregation).alias("aggregation"),
        F.when(mode == "aggregation", F.col("probability")).alias("aggregateScore"),
        F.col("confidence").alias("overallConfidence"),
        F.lit(policy.margin).alias("margin"),
        F.lit(POSITIVE).alias("positiveLabel"),
        F.lit(NEGATIVE).alias("negativeLabel"),
        stage_cards(policy).alias("stages"),
    )
