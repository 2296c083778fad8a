"""Parsing of URLs and host names as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.functions.suffixes import SuffixRules, split_by_rules
from harrier.functions.text import col, let

#: A small default; pass a full public suffix list for real data.
SUFFIXES = (
    "com", "org", "net", "de", "edu", "gov", "info", "io", "app", "dev", "eu", "fr", "es", "it", "ru", "cn", "in", "me", "co", "uk",
    "name", "life", "moe", "xyz", "site", "ch", "club", "racing", "live", "cc", "mobi", "au", "pw", "be", "pro", "top", "stream",
    "co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp",
)
_AUTHORITY = r"^[^:/?#]+://(?:[^/?#@]*@)*([^/?#:]*)(?::[^/?#]*)?"


@F.pandas_udf(T.StringType())
def _idna(hosts):
    def one(host):
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return host

    return hosts.map(one, na_action="ignore")


def normalize_url(url: Column | str, idna: bool = False) -> Column:
    """Trimmed, with a scheme, the host in lower case; user, password and port are dropped.

    With ``idna`` hosts outside ASCII get their IDNA form, in a vectorised Python function; leave it off for data that
    has none, since a Python function is evaluated for every row.
    """
    url = F.trim(col(url))
    url = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.lower(F.regexp_extract(url, _AUTHORITY, 1))
    host = F.when(host.rlike(r"[^\x00-\x7F]"), _idna(host)).otherwise(host) if idna else host
    return F.concat(F.regexp_extract(url, r"^([^:/?#]+)://", 1), F.lit("://"), host, F.regexp_replace(url, r"^[^:/?#]+://[^/?#]*", ""))


def host_of(url: Column | str) -> Column:
    """The host of a normalised URL without dots at its ends."""
    return F.btrim(F.regexp_extract(col(url), _AUTHORITY, 1), F.lit("."))


def host_parts(host: Column | str, suffixes: Sequence[str] | SuffixRules = SUFFIXES) -> Column:
    """struct(subdomain, domain, suffix): the longest known suffix, the label before it, and the rest.

    Without a known suffix the last label is the domain; an IPv4 address is a domain of its own. A whole public suffix
    list, with wildcards and exceptions, comes as ``SuffixRules``.
    """
    if isinstance(suffixes, SuffixRules):
        return split_by_rules(col(host), suffixes)
    join = lambda labels, first, n: F.when(n > 0, F.array_join(F.slice(labels, first, F.greatest(n, F.lit(0))), ".")).otherwise("")

    def first_tail(labels: Column) -> Column:
        tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("tail")))
        return F.get(F.filter(tails, lambda t: t["tail"].isin(*suffixes)), F.lit(0))

    def parts(host: Column, labels: Column, found: Column) -> Column:
        at = F.coalesce(found["i"], F.size(labels) + 1)
        split = F.struct(
            join(labels, F.lit(1), at - 2).alias("subdomain"),
            F.when(at > 1, F.get(labels, at - 2)).otherwise("").alias("domain"),
            F.coalesce(found["tail"], F.lit("")).alias("suffix"),
        )
        address = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
        return F.when(address, F.struct(F.lit("").alias("subdomain"), host.alias("domain"), F.lit("").alias("suffix"))).otherwise(split)

    return let(F.lower(col(host)), lambda h: let(F.split(h, r"\."), lambda labels: let(first_tail(labels), lambda found: parts(h, labels, found))))


def path_after_suffix(url: Column | str, suffix: Column | str) -> Column:
    """From the first slash after the first place where the suffix's text stands in the URL; "" without one."""
    url = col(url)
    tail = F.substring(url, F.greatest(F.position(col(suffix), url), F.lit(1)), F.length(url))
    return F.regexp_extract(tail, r"(?s)/.*$", 0)


def raw_words(domain: Column, path: Column, subdomain: Column) -> Column:
    """The words of the domain, the path and the subdomain, in that order."""
    pieces = lambda x: F.split(F.lower(x), r"[-./?=@&%:_]")
    return F.filter(F.concat(pieces(domain), pieces(F.regexp_replace(path, "^/", "")), pieces(subdomain)), lambda w: w != "")


def url_parts(df: DataFrame, url: str = "url", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """df with host, protocol, subdomain, domain, tld, registered_domain, path and words_raw of its normalised URL."""
    out = df.withColumn("host", host_of(url)).withColumn("__p", host_parts("host", suffixes))
    out = out.withColumns({"protocol": F.regexp_extract(url, r"^(.*?)://", 1), "subdomain": F.col("__p.subdomain"), "domain": F.col("__p.domain"), "tld": F.col("__p.suffix")})
    registered = F.when((F.col("domain") != "") & (F.col("tld") != ""), F.concat_ws(".", "domain", "tld")).otherwise("")
    out = out.withColumns({"registered_domain": registered, "path": path_after_suffix(url, "tld")})
    return out.withColumn("words_raw", raw_words(F.col("domain"), F.col("path"), F.col("subdomain"))).drop("__p")


def suffix_candidates(host: Column | str) -> Column:
    """Every suffix of a host, from the whole down to its last two labels, for zone lookups."""
    labels = F.split(col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
