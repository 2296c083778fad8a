"""Public suffix rules: plain, wildcard (``*.ck``) and exception (``!www.ck``) rules, looked up once a host.

Up to ``MOST_RULES`` rules are a hash table inside the plan: an array of slots, a rule in the slot of its CRC-32. A
lookup reads one slot, so a host costs a few comparisons whatever the number of rules, without a shuffle and without
Python. Longer lists are a table and are joined, once for each distinct host.

Of the rules that match a host an exception wins, and gives a suffix one label shorter than itself; else the one with most
labels. A host that no rule matches has no suffix.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions.text import let

#: Rules that a plan carries: a few megabytes at most.
MOST_RULES = 50_000
#: Rows of a joined rule table are repeated so often that a rule as common as ``com`` is many tasks' work.
SALTS = 16


def parsed_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """rule, from the lines of a list: comments and blank lines go, of the others what stands before white space."""
    rule = F.lower(F.regexp_extract(F.trim(F.col(line)), r"^\S+", 0))
    return lines.select(rule.alias("rule")).where("rule != '' AND NOT startswith(rule, '//')").distinct()


class SuffixRules:
    """A bounded set of rules as a lookup for column expressions."""

    def __init__(self, rules: Iterable[str]):
        self.rules = sorted({r.strip().lower() for r in rules} - {""})
        if len(self.rules) > MOST_RULES:
            raise ValueError(f"{len(self.rules)} rules are more than a plan carries: use split_by_table")
        self.slots = 1 << max(1, (2 * len(self.rules)).bit_length())
        table: list[list[str]] = [[] for _ in range(self.slots)]
        for r in self.rules:
            table[zlib.crc32(r.encode()) % self.slots].append(r)
        self._table = json.dumps(table)

    @classmethod
    def of_table(cls, rules: DataFrame, rule: str = "rule") -> SuffixRules:
        """The rules of a table, of which no more are read than a plan carries and one."""
        return cls(r[0] for r in rules.select(rule).limit(MOST_RULES + 1).collect())

    def holds(self, text: Column) -> Column:
        table = F.from_json(F.lit(self._table), "array<array<string>>")  # folded to a literal when the plan is optimised
        return F.array_contains(F.get(table, F.pmod(F.crc32(text.cast("binary")), F.lit(self.slots)).cast("int")), text)

    def first_label(self, labels: Column) -> Column:
        """The place (from 1) of the suffix's first label; the number of labels and one if there is no suffix."""
        n = F.size(labels)
        tail = lambda i: F.array_join(F.slice(labels, i, n), ".")
        places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        tails = F.transform(places, lambda i: F.struct(i.alias("i"), tail(i).alias("tail"), F.when(i < n, tail(i + 1)).alias("parent")))
        exceptions = lambda tails: F.filter(tails, lambda t: t["parent"].isNotNull() & self.holds(F.concat(F.lit("!"), t["tail"])))
        matches = lambda tails: F.filter(tails, lambda t: self.holds(t["tail"]) | F.coalesce(self.holds(F.concat(F.lit("*."), t["parent"])), F.lit(False)))
        return let(tails, lambda t: F.coalesce(F.get(exceptions(t), F.lit(0))["i"] + 1, F.get(matches(t), F.lit(0))["i"], n + 1))


def split_at(host: Column, labels: Column, at: Column) -> Column:
    """struct(subdomain, domain, suffix) of a host whose suffix begins at a label; addresses are domains of their own."""
    join = lambda first, n: F.when(n > 0, F.array_join(F.slice(labels, first, F.greatest(n, F.lit(0))), ".")).otherwise("")
    domain = F.when(at > 1, F.get(labels, at - 2)).otherwise("")
    parts = F.struct(join(F.lit(1), at - 2).alias("subdomain"), domain.alias("domain"), join(at, F.size(labels) - at + 1).alias("suffix"))
    address = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|:")
    return F.when(address, F.struct(F.lit("").alias("subdomain"), host.alias("domain"), F.lit("").alias("suffix"))).otherwise(parts)


def split_by_rules(host: Column, rules: SuffixRules) -> Column:
    """struct(subdomain, domain, suffix) of a host, null for a null one."""
    parts = lambda h: let(F.split(h, r"\."), lambda labels: let(rules.first_label(labels), lambda at: split_at(h, labels, at)))
    return F.when(host.isNotNull(), let(F.lower(F.btrim(host, F.lit("."))), parts))


def split_by_table(df: DataFrame, rules: DataFrame, host: str = "host", rule: str = "rule", out: str = "parts") -> DataFrame:
    """df with ``out``, the struct of ``split_by_rules``, from a rule table of any size.

    Distinct hosts meet rules by equal text: a host has three keys for each of its labels. Rules are repeated and hosts dealt
    over the copies, so that common suffixes spread; rows of one host meet its parts in a join that AQE splits.
    """
    hosts = df.select(F.lower(F.btrim(F.col(host), F.lit("."))).alias("__host")).where("__host IS NOT NULL").distinct()
    labels = F.split("__host", r"\.")
    n = F.size(labels)
    key = lambda prefix, i, at: F.struct(F.concat(F.lit(prefix), F.array_join(F.slice(labels, i, n), ".")).alias("rule"), at.alias("at"), F.lit(prefix != "!").alias("plain"))
    every = F.sequence(F.lit(1), n)
    inner = F.slice(every, 1, n - 1)
    keys = F.concat(F.transform(every, lambda i: key("", i, i)), F.transform(inner, lambda i: key("*.", i + 1, i)), F.transform(inner, lambda i: key("!", i, i + 1)))
    asked = hosts.select("__host", F.explode(keys).alias("k")).select("__host", "k.*", F.pmod(F.xxhash64("__host"), F.lit(SALTS)).alias("salt"))
    copies = rules.select(F.lower(F.col(rule)).alias("rule")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    best = asked.join(copies, ["rule", "salt"]).groupBy("__host").agg(F.min(F.struct("plain", "at")).alias("best"))
    split = hosts.join(best, "__host", "left").select("__host", split_at(F.col("__host"), labels, F.coalesce("best.at", n + 1)).alias(out))
    return df.withColumn("__host", F.lower(F.btrim(F.col(host), F.lit(".")))).join(split, "__host", "left").drop("__host")
