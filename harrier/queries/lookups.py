"""Queries of lookups in large tables (similar words, public suffixes, networks), of keyed tables and guarded runs, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harrier.functions.suffixes import SuffixRules, parsed_rules, split_by_table
from harrier.functions.text import spread
from harrier.functions.urls import host_parts
from harrier.operators import networks, similar
from harrier.plans.guarded import guarded_stages
from harrier.queries.policy import _CHANGES, _UPSERT, _changes, _read
from harrier.queries.urls import PARTS, _parts
from harrier.sources.store import shared_folder
from harrier.streaming.keyed_table import KeyedTable

#: Lines of a suffix list, with each kind of rule.
RULE_LINES = ("// countries", "com", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "", "io  // comment", "github.io", "ck")
_TAILS = ("com", "co.uk", "uk", "x.ck", "www.ck", "a.kawasaki.jp", "city.kawasaki.jp", "github.io", "unlisted", "ck")
#: Networks of both families, some inside others, and one that isn't well formed.
NETWORKS = (
    ("10.0.0.0/8", "wide"), ("10.1.0.0/16", "middle"), ("10.1.2.0/23", "odd"), ("10.1.2.3", "one"), ("0.0.0.0/0", "any4"),
    ("2001:db8::/32", "doc"), ("2001:db8:1::/48", "site"), ("2001:db8:1:8000::/49", "half"), ("2001:db8:1:8000::5/128", "host6"), ("10.1.2.0/33", "none"),
)


def similar_words(spark, sf_dir):
    """Words of all URLs against the distinct words of documents (as brands) and of parts (as keywords)."""
    words = _parts(spark, sf_dir).select(F.explode("words_raw").alias("word"))
    of = lambda table, text: _read(spark, sf_dir, table).select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))).alias("entry"))
    return similar.word_kinds(words, of("documents", "text"), of("part", "p_name"))


def _hosts(spark, sf_dir):
    k = F.col("c_custkey")
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (k % len(_TAILS) + 1).cast("int"))
    name = F.concat(F.when(k % 3 == 0, F.lit("WWW.")).otherwise(F.lit("")), F.when(k % 4 > 0, F.concat(F.lit("n"), k % 50, F.lit("."))).otherwise(F.lit("")), tail)
    return _read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 19 == 0, F.lit("10.1.2.3")).otherwise(name).alias("host"))


def _rules(spark):
    return parsed_rules(spark.createDataFrame([(line,) for line in RULE_LINES], "value string"))


def suffix_rules(spark, sf_dir):
    """Hosts split by plain, wildcard and exception rules that the plan carries."""
    hosts = spread(_hosts(spark, sf_dir))
    return hosts.select("c_custkey", host_parts("host", SuffixRules.of_table(_rules(spark))).alias("p")).select("c_custkey", "p.subdomain", "p.domain", "p.suffix")


def suffix_rules_joined(spark, sf_dir):
    """The same by a table of rules."""
    return split_by_table(_hosts(spark, sf_dir), _rules(spark)).select("c_custkey", "parts.*")


def network_lookup(spark, sf_dir):
    """Addresses of both families, malformed ones too, with the longest network that holds each."""
    k, text = F.col("c_custkey"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    four = text(F.lit(9) + k % 3, ".", k % 2, ".", k % 5, ".", k % 7)
    six = text("2001:DB8:", k % 3, ":", F.when(k % 4 < 2, F.lit("8000")).otherwise(F.lit("7fff")), "::", k % 6)
    ip = F.when(k % 11 == 0, F.lit("10.1.2.300")).when(k % 13 == 0, F.lit(None)).when(k % 2 == 0, four).otherwise(six)
    table = spark.createDataFrame(NETWORKS, "cidr string, name string")
    found = networks.longest_networks(_read(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip")), table)
    return found.withColumn("prefix_len", F.coalesce("prefix_len", F.lit(-1)).cast("long"))


def keyed_table_batches(spark, sf_dir):
    """Four batches of changes, in the order of time, the third of them applied twice, merged into buckets."""
    table = KeyedTable(spark, f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}", buckets=16)
    rows = _changes(spark, sf_dir)
    part = F.lit(0)
    for day in (8, 15, 22):
        part = part + (F.col("ts") >= F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz")).cast("int")
    for i in (0, 1, 2, 2, 3):
        table.apply(rows.where(part == i), i)
    return table.read()


def _price(rows):
    if (rows["o_orderkey"] % 97 == 0).any():
        raise ValueError("no price")
    return rows["o_totalprice"] % 1000 / 1000


def _share(rows):
    if (rows["o_custkey"] % 50 == 1).any():
        raise RuntimeError("no share")
    return (rows["o_custkey"] % 4) / 4


def guarded_run(spark, sf_dir):
    """Two stages over orders that raise on some rows: counts and sums by what failed."""
    done = guarded_stages(_read(spark, sf_dir, "orders"), {"price": (_price, ["o_orderkey", "o_totalprice"]), "share": (_share, ["o_custkey"])})
    return done.groupBy("price_error", "share_error").agg(F.count("*").alias("n"), F.count("price").alias("n_price"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("shares"))


QUERIES = {f.__name__: f for f in (similar_words, suffix_rules, suffix_rules_joined, network_lookup, keyed_table_batches, guarded_run)}

_SUFFIX_SQL = f"""
WITH h AS (
  SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN '10.1.2.3' ELSE lower((CASE WHEN c_custkey % 3 = 0 THEN 'www.' ELSE '' END) || (CASE WHEN c_custkey % 4 > 0 THEN 'n' || c_custkey % 50 || '.' ELSE '' END)
    || {list(_TAILS)}[c_custkey % {len(_TAILS)} + 1]) END AS host FROM customer
), r AS (
  SELECT regexp_extract(line, '^\\S+') AS rule FROM (SELECT unnest({list(RULE_LINES)}) AS line) WHERE line <> '' AND NOT starts_with(line, '//')
), s AS (
  SELECT rule, starts_with(rule, '!') AS exception, regexp_escape(ltrim(rule, '!')) AS body FROM r
), m AS (
  SELECT host, arg_max(len(string_split(ltrim(rule, '!'), '.')) - exception::INT, (exception, len(string_split(rule, '.')))) AS n
  FROM (SELECT DISTINCT host FROM h) JOIN s ON regexp_matches(host, '(^|\\.)' || replace(body, '\\*', '[^.]+') || '$') GROUP BY host
), p AS (
  SELECT c_custkey, host, string_split(host, '.') AS l, coalesce(n, 0) AS n, regexp_matches(host, '^[0-9.]+$') AS address FROM h LEFT JOIN m USING (host)
)
SELECT c_custkey, CASE WHEN address THEN '' ELSE coalesce(array_to_string(l[:greatest(len(l) - n - 1, 0)], '.'), '') END AS subdomain,
  CASE WHEN address THEN host WHEN len(l) > n THEN l[len(l) - n] ELSE '' END AS domain, CASE WHEN address OR n = 0 THEN '' ELSE array_to_string(l[len(l) - n + 1:], '.') END AS suffix
FROM p
"""

SQL = {
    "similar_words": f"""WITH {PARTS}, q AS (SELECT DISTINCT unnest(words) AS word FROM w),
  b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS entry FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]{{4,}}')) AS entry FROM part),
  nb AS (SELECT word, count(*) AS n FROM q JOIN b ON abs(length(word) - length(entry)) < 2 AND levenshtein(word, entry) < 2 GROUP BY word),
  nk AS (SELECT word, count(*) AS n FROM q JOIN k ON abs(length(word) - length(entry)) < 2 AND levenshtein(word, entry) < 2 GROUP BY word)
  SELECT word, CASE WHEN word IN (SELECT entry FROM k) THEN 'keyword' WHEN word IN (SELECT entry FROM b) THEN 'brand' WHEN nb.n > 0 THEN 'near_brand' WHEN nk.n > 0 THEN 'near_keyword' END AS kind,
    coalesce(nb.n, 0) AS n_brands, coalesce(nk.n, 0) AS n_keywords FROM q LEFT JOIN nb USING (word) LEFT JOIN nk USING (word)""",
    "suffix_rules": _SUFFIX_SQL,
    "suffix_rules_joined": _SUFFIX_SQL,
    "keyed_table_batches": f"WITH {_CHANGES} {_UPSERT}",
    "guarded_run": """SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'ValueError: no price' END AS price_error, CASE WHEN o_custkey % 50 = 1 THEN 'RuntimeError: no share' END AS share_error,
  count(*) AS n, count(*) FILTER (WHERE o_orderkey % 97 <> 0) AS n_price, coalesce(sum(CASE WHEN o_custkey % 50 <> 1 THEN (o_custkey % 4) / 4.0 END)::DOUBLE, 0) AS shares FROM orders GROUP BY 1, 2""",
    # by arithmetic on the parts that addresses are made of
    "network_lookup": """WITH a AS (
  SELECT c_custkey, c_custkey AS k, c_custkey % 11 = 0 AS bad, c_custkey % 13 = 0 AS missing, c_custkey % 2 = 0 AS four FROM customer
), b AS (
  SELECT c_custkey, CASE WHEN bad THEN '10.1.2.300' WHEN missing THEN NULL WHEN four THEN (9 + k % 3) || '.' || k % 2 || '.' || k % 5 || '.' || k % 7
      ELSE '2001:DB8:' || k % 3 || ':' || (CASE WHEN k % 4 < 2 THEN '8000' ELSE '7fff' END) || '::' || k % 6 END AS ip,
    CASE WHEN bad OR missing THEN NULL
      WHEN four THEN CASE WHEN k % 3 <> 1 THEN 'any4' WHEN k % 2 <> 1 THEN 'wide' WHEN k % 5 = 2 AND k % 7 = 3 THEN 'one' WHEN k % 5 IN (2, 3) THEN 'odd' ELSE 'middle' END
      ELSE CASE WHEN k % 3 <> 1 THEN 'doc' WHEN k % 4 >= 2 THEN 'site' WHEN k % 6 = 5 THEN 'host6' ELSE 'half' END END AS name FROM a
)
SELECT c_custkey, ip, cidr, name, CAST(coalesce(prefix_len, -1) AS BIGINT) AS prefix_len FROM b LEFT JOIN (VALUES ('10.0.0.0/8', 'wide', 8), ('10.1.0.0/16', 'middle', 16), ('10.1.2.0/23', 'odd', 23), ('10.1.2.3', 'one', 32), ('0.0.0.0/0', 'any4', 0),
  ('2001:db8::/32', 'doc', 32), ('2001:db8:1::/48', 'site', 48), ('2001:db8:1:8000::/49', 'half', 49), ('2001:db8:1:8000::5/128', 'host6', 128)) n(cidr, name, prefix_len) USING (name)""",
}
