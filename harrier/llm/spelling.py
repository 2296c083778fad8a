r"""Spelling variants: frequent words an edit apart, grouped by Aho-Corasick automata over halves.

Words are maximal runs of letters; A-Z are lower-cased. A word of L code points has two segments, its first L // 2 and
the rest. An insertion, deletion or replacement leaves at least one of them whole: the first at the start of the other
word, or the second at its end. So *shards* of words hold the segments of their words in an Aho-Corasick automaton, scan words
with it, keep the occurrences at the right offset whose words have a compatible length, and verify the distance.

A shard is chosen by the hash of a word's first letters (for first segments) or last letters (for second ones), which
both words of a pair share, so a word is scanned by two shards and not by all. A shard that gets more than ``SHARD`` words, as
where most words begin alike, is cut into blocks of patterns and blocks of scanned words, and each pair of blocks is a unit of
its own; no unit has more than about ``SHARD`` words a side. Within a unit candidates are verified in bounded arrays.

Occurrences are counted in blocks of text and summed by word before anything is shuffled by word; documents never
meet in one task. ``noise`` plants errors: where it divides the CRC-32 of ``<id>:<word>``, the word loses one code point.

Null and empty texts have no words; a null id counts as an empty one. Repeated rows count each. An empty table gives
an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.arrowtext import LOWER, byte_table, row_blocks, text_buffers
from harrier.llm.components import checkpointed
from harrier.llm.wordtable import CODED_BYTES, coded_words

LEAST_CHARS, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent.
RATIO = 5
#: Words of a unit's side, about.
SHARD = 8192
#: Letters that choose a shard; shorter than any segment.
ROUTE = LEAST_CHARS // 2
#: Candidates verified together, and the longest words that are compared in arrays.
TOGETHER, LONGEST = 1 << 18, 64
_LETTERS = byte_table(bytes([*range(65, 91), *range(97, 123)]))
_C3 = 0xC3


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are in ``[A-Za-z\\u00C0-\\u00FF]``; the latter are the byte C3 and the one after it."""
    inside = _LETTERS[data]
    lead = data == _C3
    inside |= lead
    inside[1:] |= lead[:-1]
    return inside


def without(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = 0, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of at least ``least_chars`` code points and ``least_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("id").to_pylist() if noise else []
            for row, stop in row_blocks(offsets, CODED_BYTES):
                at = offsets[row : stop + 1]
                part = data[at[0] : at[-1]]
                codes, words, first = coded_words(LOWER[part], letter_bytes(part), at - at[0])
                texts = words.to_pylist()
                counts = np.bincount(codes, minlength=len(texts))
                changed: dict[str, int] = defaultdict(int)
                if noise and len(texts):
                    doc = np.repeat(np.arange(stop - row), np.diff(first))
                    pairs, n = np.unique(doc * np.int64(len(texts)) + codes, return_counts=True)
                    owners, which = (pairs // len(texts)).tolist(), (pairs % len(texts)).tolist()
                    starts = [zlib.crc32(f"{i}:".encode()) for i in ids[row:stop]]
                    crc = zlib.crc32
                    h = np.array([crc(texts[w], starts[d]) for d, w in zip(owners, which, strict=True)], dtype=np.int64)
                    for i in np.flatnonzero(h % noise == 0).tolist():
                        counts[which[i]] -= n[i]
                        changed[without(texts[which[i]].decode(), int(h[i]))] += int(n[i])
                chars = np.array([len(w) for w in texts], dtype=np.int64)
                if len(texts):  # code points: bytes that don't continue one
                    _, ends, own = words.buffers()
                    ends = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
                    begun = np.concatenate([[0], np.cumsum((np.frombuffer(own, dtype=np.uint8)[: ends[-1]] & 0xC0) != 0x80)])
                    chars = begun[ends[1:]] - begun[ends[:-1]]
                good = np.flatnonzero((chars >= least_chars) & (counts > 0))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(good)).cast(pa.large_string()).cast(pa.string()), pa.array(counts[good].astype(np.int64))], names=["word", "n"])
                more = [(w, n) for w, n in changed.items() if len(w) >= least_chars]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in more], type=pa.string()), pa.array([n for _, n in more], type=pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point inserted, deleted or replaced."""
    a, b = sorted((a, b), key=len)
    p = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])


class Unit:
    """Patterns of one kind of segment, and the pairs that scanned words make with them.

    A pair is found from its shorter word (of equally long ones from the one before in code-point order), and from its
    second segment only where its first isn't whole too, so once in all.
    """

    def __init__(self, words: list[str], second: bool):
        self.words, self.second = words, second
        by_segment: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(words):
            by_segment[w[len(w) // 2 :] if second else w[: len(w) // 2]][len(w)].append(i)
        self.automaton = ahocorasick.Automaton()
        for segment, by_length in by_segment.items():
            self.automaton.add_word(segment, (len(segment), {size: np.array(at) for size, at in by_length.items()}))
        self.automaton.make_automaton()

    def candidates(self, word: str) -> Iterator[np.ndarray]:
        """Patterns whose segment stands at the right place of the word and whose length is compatible."""
        size = len(word)
        for end, (length, by_length) in self.automaton.iter(word):
            if end == (size - 1 if self.second else length - 1):
                for n in (size, size - 1):
                    if n in by_length:
                        yield by_length[n]

    def pairs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pattern, scanned word) of the pairs at distance 1, in arrays of bounded size."""
        if not self.words:
            return
        left, right, n = [], [], 0
        sides = _matrices(self.words, texts)
        for j, text in enumerate(texts):
            for found in self.candidates(text):
                for k in range(0, len(found), TOGETHER):
                    left.append(found[k : k + TOGETHER])
                    right.append(np.full(len(left[-1]), j))
                    n += len(left[-1])
                    if n >= TOGETHER:
                        yield self._verified(np.concatenate(left), np.concatenate(right), sides, texts)
                        left, right, n = [], [], 0
        if n:
            yield self._verified(np.concatenate(left), np.concatenate(right), sides, texts)

    def _verified(self, i: np.ndarray, j: np.ndarray, sides: tuple, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        (a_all, a_len, a_set), (b_all, b_len, b_set) = sides
        alike = np.bitwise_count(a_set[i] ^ b_set[j]) <= 2  # an edit changes two letters of a set at most
        i, j = i[alike], j[alike]
        long = np.flatnonzero(b_len[j] > LONGEST)
        good = np.zeros(len(i), dtype=bool)
        for k in long.tolist():
            a, b = self.words[i[k]], texts[j[k]]
            good[k] = (len(a) < len(b) or a < b) and one_edit(a, b) and not (self.second and b.startswith(a[: len(a) // 2]))
        short = np.flatnonzero(b_len[j] <= LONGEST)
        a, b, la, lb = a_all[i[short]], b_all[j[short]], a_len[i[short]], b_len[j[short]]
        differ = a != b
        p = differ.argmax(axis=1)
        one = np.arange(len(short))
        replaced = (differ.sum(axis=1) == 1) & (a[one, p] < b[one, p])
        # the longer word without the code point at p
        moved = ((a[:, :-1] != b[:, 1:]) & (np.arange(a.shape[1] - 1) >= p[:, None])).any(axis=1)
        good[short] = np.where(la == lb, replaced, ~moved) & ~(self.second & (p >= la // 2))
        return i[good], j[good]


def _matrices(*sides: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each side: code points of the words of up to ``LONGEST``, a row each, ended by zeros; all lengths; and 64-bit sets of letters."""
    wide = 1 + max((len(w) for words in sides for w in words if len(w) <= LONGEST), default=0)
    narrow = all(w.isascii() or max(w) <= "\xff" for words in sides for w in words)
    out = []
    for words in sides:
        flat = "".join(w.ljust(wide, "\0") if len(w) <= LONGEST else "\0" * wide for w in words)
        points = np.frombuffer(flat.encode("latin-1"), dtype=np.uint8) if narrow else np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)
        letters = [functools.reduce(lambda bits, c: bits | 1 << (ord(c) & 63), set(w), 0) for w in words]
        out.append((points.reshape(-1, wide), np.array([len(w) for w in words], dtype=np.int64), np.array(letters, dtype=np.uint64)))
    return out


def near_pairs(words: DataFrame, shard: int = SHARD, route: int = ROUTE) -> DataFrame:
    """word, n, near and near_n, a row for each pair of words at distance 1; words: (word, n) of distinct words, none shorter than 2 * route."""
    total = words.count()
    shards = max(1, -(-total // shard))
    ends = F.array(F.struct(F.lit(0).alias("kind"), F.substring("word", 1, route).alias("end")), F.struct(F.lit(1).alias("kind"), F.right("word", F.lit(route)).alias("end")))
    both = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.kind", F.pmod(F.xxhash64("e.kind", "e.end"), F.lit(shards)).alias("shard"))
    # one row for ``shard`` words and kind, and no more
    sizes = both.groupBy("kind", "shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
    dealt = both.join(F.broadcast(sizes), ["kind", "shard"]).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "word"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda i, j, scanned: F.struct(i.alias("i"), j.alias("j"), F.lit(scanned).alias("scanned"))
    places = F.concat(F.transform(every, lambda j: place(F.col("own"), j, False)), F.transform(every, lambda i: place(i, F.col("own"), True)))
    rows = dealt.select("word", "n", "kind", "shard", F.explode(places).alias("p")).select("word", "n", "kind", "shard", "p.*")

    def run(unit: pa.Table) -> pa.Table:
        scanned = unit.column("scanned").to_numpy()
        words, counts = unit.column("word").to_pylist(), unit.column("n").to_numpy()
        held, read = np.flatnonzero(~scanned), np.flatnonzero(scanned)
        first, second = [], []
        if len(held) and len(read):
            for i, j in Unit([words[k] for k in held], unit.column("kind")[0].as_py() == 1).pairs([words[k] for k in read]):
                first.append(held[i])
                second.append(read[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (first, second))
        column = unit.column("word").combine_chunks()
        return pa.table({"word": column.take(pa.array(a)), "n": pa.array(counts[a]), "near": column.take(pa.array(b)), "near_n": pa.array(counts[b])})

    return rows.groupBy("kind", "shard", "i", "j").applyInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root (the last of the forms that follow it) of the words that have a form, from (word, form).

    Each round doubles the steps taken; forms are ``RATIO`` times as frequent as their words, so rounds are few.
    """
    known = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("up"))
        joined = checkpointed(known.join(further, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        known = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return known


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word, from (word, n)."""
    words = checkpointed(words)
    pairs = checkpointed(near_pairs(words))
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    linked = pairs.unionByName(back).groupBy("word").agg(F.max("n").alias("own"), F.count("*").alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= ratio * F.col("own")
    linked = checkpointed(linked.select("word", "n_near", F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")))
    last = roots(linked.where("form IS NOT NULL"))
    out = words.join(linked, "word", "left").join(last, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
