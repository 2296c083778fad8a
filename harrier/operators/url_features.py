"""Lexical features of URLs: 39 columns of counts, lengths, list memberships and word statistics.

Input: a DataFrame that ``url_parts`` has gone over. Word lists are parameters; a list of a few hundred words is an
array literal, the list of popular hosts is a table and is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.functions.text import count_of, deviation, digit_count, largest, mean, smallest

# Fixed values.
COMMON_TLDS = ("com", "org", "net", "de", "edu", "gov")
SPECIAL = ("-", ".", "/", "@", "?", "&", "=", "_")
FREE_HOSTING = ("wixstudio.com", "weebly.com", "weeblysite.com", "framer.app", "pages.dev", "vercel.app", "blogspot.com", "webflow.io", "zapier.app", "netlify.app", "webcindario.com", "github.io", "amazonaws.com", "wixsite.com", "gitbook.io")


@dataclass(frozen=True)
class WordLists:
    """Brands, keywords, and the vocabulary that compound words are split by (none: they aren't split)."""

    brands: Sequence[str] = ()
    keywords: Sequence[str] = ()
    vocabulary: frozenset[str] = frozenset()
    free_hosting: Sequence[str] = FREE_HOSTING


@dataclass(frozen=True)
class TransitionModel:
    """ln P(second | first) by two-character string, and the threshold under which a word counts as random."""

    log_probability: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0

    def score(self, text: Column) -> Column:
        """exp of the mean log probability of the text's pairs of letters and blanks; 1 without a pair."""
        kept = F.regexp_replace(F.lower(text), "[^a-z ]", "")
        table = F.create_map(*(x for k, v in self.log_probability.items() for x in (F.lit(k), F.lit(float(v)))))
        pairs = F.regexp_extract_all(kept, F.lit("(?=(..))"), F.lit(1))
        total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(table, p), F.lit(0.0)))
        return F.when(F.length(kept) < 2, 1.0).otherwise(F.exp(total / F.size(pairs)))


def words_array(words: Sequence[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")


def near(word: Column, listed: Column) -> Column:
    """How many list entries are at an edit distance under 2."""
    close = lambda x: (F.abs(F.length(x) - F.length(word)) < 2) & (F.levenshtein(word, x, 1) >= 0)
    return F.size(F.filter(listed, close))


def repeats(word: Column) -> Column:
    """How many windows of 2, 3, 4 and 5 characters consist of one character."""
    each = [F.regexp_count(word, F.lit(rf"(?s)(?=(.)\1{{{k - 1}}})")) for k in (2, 3, 4, 5)]
    return each[0] + each[1] + each[2] + each[3]


def splitter(vocabulary: frozenset[str]):
    """Splits compound words by a vocabulary, the longest parts of four letters or more first.

    A part that is still a word without its last s or y loses it; the longest rest of four letters or more is a part
    too; parts inside another part are dropped; a word without any part stays whole.
    """

    def split(word: str) -> list[str]:
        if word in vocabulary:
            return [word]
        rest, parts = word, []
        for size in range(len(word), 3, -1):
            for start in range(len(word) - size + 1):
                piece = rest[start : start + size]
                if piece in vocabulary:
                    part = piece[:-1] if piece[-1] in "sy" and piece[:-1] in vocabulary else piece
                    parts.append(part)
                    rest = rest.replace(part, "*" * len(part))
        longest = max(rest.split("*"), key=len)
        parts += [longest] if len(longest) > 3 else []
        return [p for p in parts if not any(p != q and p in q for q in parts)] or [word]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def apply(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: [p for w in ws for p in split(w)], na_action="ignore")

    return apply


CLASSES = ("keyword", "brand", "near_brand", "near_keyword", "random", "short", "long")


def word_classes(words: Column, lists: WordLists, model: TransitionModel | None = None) -> Column:
    """array of (word without digits, class) in the words' order; words of no class are left out."""
    brands, keywords = words_array(lists.brands), words_array(lists.keywords)

    def one(raw: Column) -> Column:
        word = F.regexp_replace(raw, r"(?U)\d+", "")
        by_model = F.lit("short") if model is None else F.when(~(model.score(word) > model.threshold), "random").when(F.length(word) < 7, "short").otherwise("long")
        kind = F.when(F.array_contains(keywords, word), "keyword").when(F.array_contains(brands, word), "brand").when(near(word, brands) > 0, "near_brand").when(near(word, keywords) > 0, "near_keyword").when(F.length(word) > 3, by_model)
        return F.struct(word.alias("word"), kind.alias("kind"))

    return F.filter(F.transform(words, one), lambda w: w["kind"].isNotNull())


def url_features(df: DataFrame, lists: WordLists = WordLists(), model: TransitionModel | None = None, popular: DataFrame | None = None) -> DataFrame:
    """df with the 39 features. popular: a table with a column ``host`` of well-known hosts."""
    text = F.concat("domain", "subdomain", "path")
    brands, keywords = words_array(lists.brands), words_array(lists.keywords)
    out = df.withColumn("__w", word_classes(F.col("words_raw"), lists, model))
    of = lambda *kinds: F.transform(F.filter("__w", lambda w: w["kind"].isin(*kinds)), lambda w: w["word"])
    # the compound words are split outside the JVM only if there is a vocabulary and a model that finds any
    split = splitter(lists.vocabulary)(of("long")) if lists.vocabulary and model is not None else F.array().cast("array<string>")
    out = out.withColumn("__split", split)
    out = out.withColumn("__checked", F.concat(of("short"), of("near_brand"), of("near_keyword"), F.transform("__split", lambda w: F.regexp_replace(w, r"(?U)\d+", ""))))
    listed = lambda w: F.array_contains(keywords, w) | F.array_contains(brands, w)
    pairs = lambda against: F.aggregate("__checked", F.lit(0), lambda a, w: a + F.when(listed(w), 0).otherwise(near(w, against)))
    out = out.withColumns({"__brand_pairs": pairs(brands), "__keyword_pairs": pairs(keywords)})
    lengths = F.transform("__w", lambda w: F.length(w["word"]))
    count = lambda words: F.size(words).cast("long")
    full_domain = F.lower(F.when(F.col("tld") != "", F.concat_ws(".", "domain", "tld")).otherwise(F.col("domain")))
    full_host = F.when(F.col("subdomain") != "", F.concat_ws(".", F.lower("subdomain"), full_domain)).otherwise(full_domain)
    hosted = F.exists(words_array(lists.free_hosting), lambda d: (full_host == d) | F.endswith(full_host, F.concat(F.lit("."), d)))
    flag = lambda c: c.cast("long")
    features = {
        "domain_digit_count": digit_count("domain"),
        "subdomain_digit_count": digit_count("subdomain"),
        "path_digit_count": digit_count("path"),
        "domain_length": F.length("domain").cast("long"),
        "subdomain_length": F.length("subdomain").cast("long"),
        "path_length": F.length("path").cast("long"),
        "isKnownTld": flag(F.col("tld").isin(*COMMON_TLDS)),
        "punnyCode": flag(F.startswith("domain", F.lit("xn--"))),
        "random_domain": F.lit(0).cast("long") if model is None else flag(model.score(F.col("domain")) < model.threshold),
        "subDomainCount": count(F.split("subdomain", r"\.")),
        "char_repeat": F.aggregate("words_raw", F.lit(0), lambda a, w: a + repeats(w)).cast("long"),
        **{f"`{c}`": count_of(text, c) for c in SPECIAL},
        "domain_in_brand_list": flag(F.array_contains(brands, F.col("domain"))),
        "domain_in_FWB_list": flag(hosted),
        "raw_word_count": count("__w"),
        "splitted_word_count": count("__split"),
        "average_word_length": mean(lengths),
        "longest_word_length": largest(lengths).cast("long"),
        "shortest_word_length": smallest(lengths).cast("long"),
        "std_word_length": deviation(lengths),
        "compound_word_count": count(of("long")),
        "keyword_count": (F.size(of("keyword")) + F.size(F.filter("__checked", lambda w: F.array_contains(keywords, w)))).cast("long"),
        "brand_name_count": (F.size(of("brand")) + F.size(F.filter("__checked", lambda w: F.array_contains(brands, w) & ~F.array_contains(keywords, w)))).cast("long"),
        "negligible_word_count": count(F.filter("__checked", lambda w: ~listed(w) & (near(w, brands) == 0) & (near(w, keywords) == 0))),
        "target_brand_count": F.col("__brand_pairs").cast("long"),
        "target_keyword_count": F.col("__keyword_pairs").cast("long"),
        "similar_keyword_count": F.col("__keyword_pairs").cast("long"),
        "similar_brand_count": F.col("__brand_pairs").cast("long"),
        "average_compound_words": mean(F.transform(of("long"), F.length)),
        "random_words": count(of("random")),
    }
    out = with_popularity(out, popular)
    passed = [F.col(f"`{c}`") for c in out.columns if not c.startswith("__")]
    return out.select(*passed, *(c.alias(n.strip("`")) for n, c in features.items()))


def with_popularity(df: DataFrame, popular: DataFrame | None) -> DataFrame:
    """popularity1m_tld: the registered domain is listed; popularity1m: the domain is the first label of a listed host."""
    if popular is None:
        return df.withColumns({"popularity1m_tld": F.lit(0).cast("long"), "popularity1m": F.lit(0).cast("long")})
    hosts = popular.select(F.trim("host").alias("__host")).distinct().withColumn("__h", F.lit(1).cast("long"))
    firsts = popular.select(F.substring_index(F.trim("host"), ".", 1).alias("__first")).distinct().withColumn("__f", F.lit(1).cast("long"))
    out = df.join(hosts, F.concat_ws(".", "domain", "tld") == F.col("__host"), "left").join(firsts, F.col("domain") == F.col("__first"), "left")
    flags = {"popularity1m_tld": F.coalesce("__h", F.lit(0).cast("long")), "popularity1m": F.coalesce("__f", F.lit(0).cast("long"))}
    return out.withColumns(flags).drop("__host", "__h", "__first", "__f")


def train_transitions(texts: DataFrame, text: str = "text", smoothing: int = 10) -> DataFrame:
    """first, second and log_probability of each pair of letters or blanks, with ``smoothing`` added to each count.

    Pairs are counted natively; the 27 x 27 grid is the only thing that is ever crossed.
    """
    kept = F.regexp_replace(F.lower(F.col(text)), "[^a-z ]", "")
    pairs = texts.select(F.explode(F.regexp_extract_all(kept, F.lit("(?=(..))"), F.lit(1))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count("*").alias("n"))
    letters = texts.sparkSession.range(27).select(F.when(F.col("id") == 26, " ").otherwise(F.char(F.col("id") + 97)).alias("c"))
    grid = letters.select(F.col("c").alias("first")).crossJoin(F.broadcast(letters.select(F.col("c").alias("second"))))
    full = grid.join(counts, F.concat("first", "second") == F.col("pair"), "left").select("first", "second", (F.coalesce("n", F.lit(0)) + smoothing).alias("n"))
    totals = full.groupBy("first").agg(F.sum("n").alias("total"))
    return full.join(totals, "first").select("first", "second", F.ln(F.col("n") / F.col("total")).alias("log_probability"))
