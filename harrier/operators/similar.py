"""Words within one edit of the entries of a long list, by a join on an index of deletions.

Two words are within one edit if they are equal, if one is the other without one character, or if both become equal
without the character at the same place. So each word has a key for itself and for each of its deletions, tagged with what the
other side's key has to be, and equal keys are exactly the pairs sought: nothing is compared that isn't near, and no list is a
literal of the plan. Words are distinct before they are joined, so the rows that share a key are no more than an alphabet
times a length, whatever the data. Lists may have any size; Spark broadcasts the keys of a short one by itself.

Null and empty words and entries have no neighbours. Words longer by two than the longest entry are left out before their
deletions are made. Repeated words and entries count once. Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a key's other side is: the same word, a word one shorter, a word one longer. Positive tags are places.
SAME, SHORTER, LONGER = 0, -1, -2


def _without(word: Column, i: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def _keys(word: Column, whole: int, cut: int) -> Column:
    """array of (tag, key): the word as such and under ``whole``, its deletions under ``cut`` and under their places."""
    tagged = lambda tag, key: F.struct(tag.cast("int").alias("tag"), key.alias("key"))
    places = F.sequence(F.lit(1), F.length(word))
    shorter = F.array_distinct(F.transform(places, lambda i: _without(word, i)))
    own = F.array(tagged(F.lit(SAME), word), tagged(F.lit(whole), word))
    return F.concat(own, F.transform(shorter, lambda d: tagged(F.lit(cut), d)), F.transform(places, lambda i: tagged(i, _without(word, i))))


def near_pairs(words: DataFrame, listed: DataFrame, word: str = "word", entry: str = "entry") -> DataFrame:
    """word and entry of each pair within one edit, equal ones included, once each."""
    entries = listed.select(F.col(entry).alias("entry")).where("entry != ''").distinct()
    longest = entries.agg(F.max(F.length("entry")).alias("longest"))
    asked = words.select(F.col(word).alias("word")).where("word != ''").distinct()
    asked = asked.join(F.broadcast(longest), F.length("word") <= F.col("longest") + 1).select("word")  # one row
    # a key of the asked side tagged SHORTER is whole and meets a deletion of an entry: the entry is longer by one
    left = asked.select("word", F.explode(_keys(F.col("word"), SHORTER, LONGER)).alias("k")).select("word", "k.*")
    right = entries.select("entry", F.explode(_keys(F.col("entry"), LONGER, SHORTER)).alias("k")).select("entry", "k.*")
    met = left.join(right, ["tag", "key"])
    return met.where((F.col("tag") <= 0) | (F.col("word") != F.col("entry"))).select("word", "entry")


def near_counts(words: DataFrame, listed: DataFrame, word: str = "word", entry: str = "entry") -> DataFrame:
    """word, n_near (entries within one edit) and listed (whether the word itself is one), a row for each distinct word."""
    counts = near_pairs(words, listed, word, entry).groupBy("word").agg(F.count("*").alias("n_near"), F.bool_or(F.col("word") == F.col("entry")).alias("listed"))
    asked = words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct()
    return asked.join(counts, "word", "left").select("word", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce("listed", F.lit(False)).alias("listed"))


def word_kinds(words: DataFrame, brands: DataFrame, keywords: DataFrame, word: str = "word", entry: str = "entry") -> DataFrame:
    """word, kind (keyword, brand, near_brand, near_keyword or null), n_brands and n_keywords of each distinct word.

    The kinds are those of ``url_features.word_classes`` that need lists, here for lists of any length.
    """
    names = lambda what: [F.col("n_near").alias(f"n_{what}s"), F.col("listed").alias(f"is_{what}")]
    both = near_counts(words, brands, word, entry).select("word", *names("brand")).join(near_counts(words, keywords, word, entry).select("word", *names("keyword")), "word")
    kind = F.when(F.col("is_keyword"), "keyword").when(F.col("is_brand"), "brand").when(F.col("n_brands") > 0, "near_brand").when(F.col("n_keywords") > 0, "near_keyword")
    return both.select("word", kind.alias("kind"), "n_brands", "n_keywords")
