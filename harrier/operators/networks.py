"""The longest network that holds an address, for IPv4 and IPv6 and for networks inside one another.

An address is a family and 128 bits in two numbers (IPv4 in the first 32). It is masked to each prefix length that the
networks of its family have, and each masked form meets the networks in one join on equal keys; the longest match stays. No
ranges are compared. Addresses are distinct before the join. The addresses of one wide network may be a third of all, so
networks are repeated and addresses dealt over the copies.

Null and malformed addresses, and networks whose text is malformed, match nothing. Of equal networks the largest row
counts. Embedded IPv4 (``::ffff:10.0.0.1``) is read as the IPv6 address that it is; zones (``%eth0``) are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
_V4 = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"


def _v4_number(text: Column) -> Column:
    return F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.try_cast("long"))


def address_key(address: Column) -> Column:
    """struct(family, high, low) of an address; null for what is none."""
    text = F.lower(F.regexp_replace(F.trim(address), "%.*$", ""))
    four = F.struct(F.lit(4).alias("family"), F.call_function("shiftleft", _v4_number(text), F.lit(32)).alias("high"), F.lit(0).cast("long").alias("low"))
    tail = F.regexp_extract(text, f":({_V4})$", 1)
    number = _v4_number(tail)
    words = F.concat_ws(":", F.lower(F.hex(F.call_function("shiftright", number, F.lit(16)))), F.lower(F.hex(number.bitwiseAND(F.lit(65535)))))
    plain = F.when(F.length(tail) > 0, F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), words)).otherwise(text)
    gap = F.contains(plain, F.lit("::"))
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left = groups(F.substring_index(plain, "::", 1))
    right = F.when(gap, groups(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
    missing = F.lit(8) - F.size(left) - F.size(right)
    zeros = F.when(gap, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    every = F.concat(left, zeros, right)
    bits = F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")
    form = plain.rlike("^[0-9a-f:]+$") & ~plain.rlike(":::|::.*::|^:[^:]|[^:]:$") & F.forall(every, lambda g: F.length(g) <= 4)
    whole = form & (F.size(every) == 8) & F.when(gap, missing >= 1).otherwise(F.lit(True))
    number64 = lambda first: F.conv(F.substring(bits, first, 16), 16, -10).cast("long")
    six = F.struct(F.lit(6).alias("family"), number64(1).alias("high"), number64(17).alias("low"))
    return F.when(text.rlike(f"^{_V4}$"), four).when(F.contains(text, F.lit(":")) & whole, six)


def masked(key: Column, length: Column) -> Column:
    """The key with the bits after the first ``length`` cleared; struct(family, length, high, low)."""
    ones = lambda n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - n))
    return F.struct(key["family"].alias("family"), length.alias("length"), key["high"].bitwiseAND(ones(length)).alias("high"), key["low"].bitwiseAND(ones(length - 64)).alias("low"))


def longest_networks(ips: DataFrame, networks: DataFrame, ip: str = "ip", cidr: str = "cidr") -> DataFrame:
    """ips with the columns of the longest network that holds each address and ``prefix_len``; nulls where there is none.

    networks: ``cidr`` (an address, with ``/length`` or for itself alone) and any other columns.
    """
    extra = [c for c in networks.columns if c != "prefix_len"]
    key = address_key(F.substring_index(F.col(cidr), "/", 1))
    given = F.when(F.contains(F.col(cidr), F.lit("/")), F.substring_index(F.col(cidr), "/", -1).try_cast("int"))
    most = F.when(key["family"] == 4, 32).otherwise(128)
    known = networks.select(F.struct(*(F.col(f"`{c}`") for c in extra)).alias("net"), key.alias("key"), F.when(F.contains(F.col(cidr), F.lit("/")), given).otherwise(most).alias("length"), most.alias("most"))
    known = known.where("key IS NOT NULL AND length BETWEEN 0 AND most").select("net", masked(F.col("key"), F.col("length")).alias("m"))
    known = known.groupBy("m").agg(F.max("net").alias("net"))
    # 33 lengths of one family and 129 of the other at most
    lengths = sorted((r["family"], r["length"]) for r in known.select("m.family", "m.length").distinct().collect())
    of = lambda family: F.array(*(F.lit(n) for f, n in lengths if f == family)).cast("array<int>")
    asked = ips.select(F.col(ip).alias("__ip")).where("__ip IS NOT NULL").distinct().withColumn("key", address_key(F.col("__ip"))).where("key IS NOT NULL")
    asked = asked.select("__ip", "key", F.explode(F.when(F.col("key.family") == 4, of(4)).otherwise(of(6))).alias("length"))
    asked = asked.select("__ip", masked(F.col("key"), F.col("length")).alias("m"), F.pmod(F.xxhash64("__ip"), F.lit(SALTS)).alias("salt"))
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    best = asked.join(copies, ["m", "salt"]).groupBy("__ip").agg(F.max(F.struct("m.length", "net")).alias("best"))
    out = ips.join(best, F.col(f"`{ip}`") == F.col("__ip"), "left")
    return out.select(*(ips[f"`{c}`"] for c in ips.columns), *(F.col(f"best.net.`{c}`").alias(c) for c in extra), F.col("best.length").alias("prefix_len"))
