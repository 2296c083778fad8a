"""String functions as column expressions: counts, entropy, hashes, array statistics. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MD5_MODULUS = 2147483647


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; as a plain expression it would be computed wherever the body names it, in a lambda once for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores: for costly work a row on tables that are few splits because their files are small."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def count_of(text: Column | str, part: str) -> Column:
    """How often a character occurs."""
    return (F.length(col(text)) - F.length(F.replace(col(text), F.lit(part), F.lit("")))).cast("long")


def count_matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern)).cast("long")


def digit_count(text: Column | str) -> Column:
    return count_matches(text, r"(?U)\d")


def characters(text: Column | str) -> Column:
    return F.filter(F.split(col(text), ""), lambda c: c != "")


def entropy_by_length(text: Column | str) -> Column:
    """Shannon entropy of the characters in bits, divided by the text's length; 0 for the empty text."""

    def of(text: Column) -> Column:
        size = F.length(text).cast("double")
        share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
        bits = F.aggregate(F.array_sort(F.array_distinct(characters(text))), F.lit(0.0), lambda a, c: a - let(share(c), lambda p: p * F.log2(p)))
        return F.when(F.length(text) == 0, 0.0).otherwise(bits / size)

    return let(col(text), of)


def md5_mod(text: Column | str) -> Column:
    """The MD5 digest as a number modulo 2**31 - 1, digested 32 bits at a time (Horner)."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(F.md5(col(text)), 8 * i + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, c: (a * F.lit(4294967296) + c) % F.lit(MD5_MODULUS))


def simhash32(text: Column | str) -> Column:
    """32 votes of the characters' MD5 low bits; a bit is set where the vote isn't negative (so "" gives all ones)."""
    hashes = F.transform(characters(text), lambda c: F.conv(F.substring(F.md5(c), 25, 8), 16, 10).cast("long"))

    def bit(i: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.when(F.getbit(h, i) == 1, 1).otherwise(-1))
        return F.when(votes >= 0, F.expr("1L")).otherwise(F.expr("0L"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("i"), bit(i).alias("b")))
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda a, x: a * 2 + x["b"])


def total(values: Column | str) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(values: Column | str, empty: float | None = 0.0) -> Column:
    """The mean of an array without its nulls; ``empty`` for none."""
    of = lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)).otherwise(F.lit(empty).cast("double"))
    return let(F.array_compact(col(values)), of)


def deviation(values: Column | str, empty: float | None = 0.0) -> Column:
    """The population standard deviation of an array without its nulls; ``empty`` for fewer than two."""

    def of(v: Column) -> Column:
        squares = lambda average: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") - average) * (x.cast("double") - average))
        return F.when(F.size(v) > 1, F.sqrt(let(total(v) / F.size(v), squares) / F.size(v))).otherwise(F.lit(empty).cast("double"))

    return let(F.array_compact(col(values)), of)


def smallest(values: Column | str, empty: float | None = 0.0) -> Column:
    return F.coalesce(F.array_min(F.array_compact(col(values))).cast("double"), F.lit(empty).cast("double"))


def largest(values: Column | str, empty: float | None = 0.0) -> Column:
    return F.coalesce(F.array_max(F.array_compact(col(values))).cast("double"), F.lit(empty).cast("double"))


def value_entropy(values: Column | str) -> Column:
    """Shannon entropy in bits of an array's distinct values; 0 for an empty one."""

    def of(values: Column) -> Column:
        share = lambda v: F.size(F.filter(values, lambda x: x == v)).cast("double") / F.size(values)
        return F.aggregate(F.array_sort(F.array_distinct(values)), F.lit(0.0), lambda a, v: a - let(share(v), lambda p: p * F.log2(p)))

    return let(col(values), of)


def longest_run(text: Column | str, pattern: str) -> Column:
    """The length of the longest match; 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)), F.length)), F.lit(0)).cast("long")


def ratio(part: Column, text: Column | str) -> Column:
    """part by the text's length; 0 for the empty text."""
    return F.coalesce(F.try_divide(part.cast("double"), F.length(col(text)).cast("double")), F.lit(0.0))


def leading(n: int, test: Callable[[Column], Column]) -> Column:
    """How many of the places 0..n-1 pass a test that, once failed, fails at all later places (by halving)."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & test(at + step - 1), at + step).otherwise(at)) if n else F.lit(0)
