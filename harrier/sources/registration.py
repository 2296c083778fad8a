"""Reading collected registration and DNS answers: contacts, dates, suffixes and flags, as expressions over nested data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrier.functions.text import let

ROLES = {"registrar": ("registrar",), "registrant": ("registrant",), "administrative": ("admin",)}


def _card_rows(card: Column) -> Column:
    return F.from_json(F.get_json_object(card, "$[1]"), "array<array<string>>")


def _last_text(rows: Column, field: str) -> Column:
    values = F.filter(rows, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == field) & ~F.coalesce(F.get(r, F.lit(3)), F.lit("[")).rlike(r"^\s*[\[{]"))
    return F.get(F.try_element_at(values, F.lit(-1)), F.lit(3))


def card_value(card: Column, field: str) -> Column:
    """The last text of a field in a jCard given as JSON (["vcard", [[field, {}, type, value], ...]]); null without one."""
    return _last_text(_card_rows(card), field)


def contacts(entities: Column) -> Column:
    """From an array of struct(roles, vcardArray as JSON): a map from role to the contacts (name, email) that have it.

    A role counts wherever its name is part of an entity's role; contacts with neither name nor email and roles
    without contacts are left out.
    """
    roles = lambda e: F.transform(F.coalesce(e["roles"], F.array().cast("array<string>")), lambda r: F.lower(r))
    parsed = lambda e: let(_card_rows(e["vcardArray"]), lambda rows: F.struct(roles(e).alias("roles"), _last_text(rows, "fn").alias("name"), _last_text(rows, "email").alias("email")))
    given = lambda p: F.struct(p["roles"].alias("roles"), *(F.nullif(p[c], F.lit("")).alias(c) for c in ("name", "email")))
    every = F.filter(F.transform(F.transform(entities, parsed), given), lambda p: p["name"].isNotNull() | p["email"].isNotNull())

    def with_role(people: Column, role: str, marks: Sequence[str]) -> Column:
        has = lambda p: F.filter(p["roles"], lambda r: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(r, m)))
        each = F.flatten(F.transform(people, lambda p: F.transform(has(p), lambda _: F.struct(p["name"].alias("name"), p["email"].alias("email")))))
        return F.struct(F.lit(role).alias("key"), each.alias("value"))

    pairs = lambda people: F.array(*(with_role(people, role, marks) for role, marks in ROLES.items()))
    return F.map_from_entries(F.filter(let(every, pairs), lambda p: F.size(p["value"]) > 0))


def first_present(parsed: Column, keys: Sequence[str]) -> Column:
    """From a map to arrays: the first value of the first key that is there, even if that is null."""
    out = F.when(F.map_contains_key(parsed, keys[0]), F.get(F.try_element_at(parsed, F.lit(keys[0])), F.lit(0)))
    for key in keys[1:]:
        out = out.when(F.map_contains_key(parsed, key), F.get(F.try_element_at(parsed, F.lit(key)), F.lit(0)))
    return out


def known_suffix(host: Column, suffixes: Sequence[str]) -> Column:
    """The last two labels if they are a known suffix, else the last one if it is, else null."""
    labels, listed = F.split(host, r"\."), F.array(*map(F.lit, suffixes))
    two, last = F.array_join(F.slice(labels, -2, 2), "."), F.element_at(labels, -1)
    return F.when(F.size(labels) < 2, None).when(F.array_contains(listed, two), two).when(F.array_contains(listed, last), last)


def text_flags(records: Column) -> Column:
    """struct(spf, dkim, dmarc): whether any TXT record mentions each."""
    mentions = lambda word: F.exists(F.coalesce(records, F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit(word)))
    return F.struct(mentions("v=spf1").alias("spf"), mentions("dkim").alias("dkim"), mentions("dmarc").alias("dmarc"))


def placed_authority(domain: Column, zone: Column, soa: Column) -> Column:
    """struct(SOA, zone_SOA): an authority record is the zone's own if the zone is another name than the domain."""
    other = F.coalesce(zone != domain, F.lit(False))
    return F.struct(F.when(~other, soa).alias("SOA"), F.when(other, soa).alias("zone_SOA"))


def first_sources(found: Column) -> Column:
    """From an array of (ip, source) in order of discovery: each address once, with the source that named it first."""
    ips = F.array_distinct(F.transform(found, lambda x: x["ip"]))
    return F.transform(ips, lambda ip: F.struct(ip.alias("ip"), F.get(F.filter(found, lambda x: x["ip"] == ip), F.lit(0))["source"].alias("source")))


def ip_version(ip: Column, given: Column) -> Column:
    """The version that an answer names, or else the one that the address shows."""
    return F.coalesce(given, F.when(F.contains(ip, F.lit(":")), 6).otherwise(4))
