"""Spelling variants, importance resampling and line dedup, against SQL and brute force."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrier.llm import importance, line_dedup, spelling
from harrier.llm.arrowtext import ALNUM, LOWER
from harrier.llm.queries import oracle_sql, queries
from harrier.llm.wordtable import coded_words

LOWERED = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LINE = "This line is long enough to count as one that is shared."
AWKWARD = [
    (1, f"{LINE}\nown words here\n\n{LINE}"),
    (2, f"  {LINE.upper()} \r\n"),
    (3, f"{LINE}"),
    (3, f"{LINE}"),
    (4, f"\t{LINE}\nx"),
    (5, f"{LINE}\n{LINE}\nend"),
    (6, f"first\n{LINE}\n"),
    (7, ""),
    (8, None),
    (9, "\n\n"),
    (None, f"{LINE}\nno id"),
    (10, "writing " * 40 + "writng"),
    (11, "é" * 70_000 + " " + "é" * 70_001),
    (12, "ÉCOLES ÉCOLES écoles × ÷÷÷÷÷÷÷ naïve naïve"),
]


def awkward(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(3)
    return docs.withColumns({c: F.lit("clash") for c in ("id", "word", "n", "line", "h1", "state", "block", "rank", "score", "keep", "text_hash")})


@pytest.mark.parametrize("name", ["op11_spelling", "op12_importance", "op13_line_dedup"])
def test_queries_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = queries()[name](spark, sf), con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.select(*map(duckdb.ColumnExpression, got.columns)).fetchall()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé\n9-", max_size=12), max_size=6))
def test_coded_words(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    low = LOWER[data]
    codes, words, first = coded_words(low, ALNUM[low], at)
    listed = [w.decode() for w in words.to_pylist()]
    assert len(set(listed)) == len(listed)
    for i, t in enumerate(texts):
        assert [listed[c] for c in codes[first[i] : first[i + 1]]] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWERED))


# ---- line dedup


def kept_by_hand(rows, least_chars=40, least_docs=5):
    key = lambda x: x.strip(line_dedup.WHITE.decode()).translate(LOWERED)
    holds = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least_chars:
                holds[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holds.get(key(x), ())) < least_docs or i == max(holds[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_lines_of_awkward_rows(spark):
    got = [tuple(r) for r in line_dedup.kept_texts(awkward(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, kept_by_hand(AWKWARD)))
    assert line_dedup.kept_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 7), st.integers(0, 2)), max_size=50), st.integers(1, 6), st.lists(st.integers(0, 50), max_size=4), st.integers(1, 7))
def test_range_stream(rows, least, cuts, size):
    """However the sorted rows are cut into ranges and batches, a key's lines are settled by its summaries."""
    rows = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    cuts = sorted({0, len(rows), *(c for c in cuts if c < len(rows))})
    lost, waiting, ends = [], [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        stream, out = line_dedup.RangeStream(least), []
        part = rows[a:b]
        for k in range(0, len(part), size):
            own = part[k : k + size]
            batch = pa.RecordBatch.from_pydict({"id": [r[1] for r in own], "line": [r[2] for r in own], "h1": [r[0] for r in own], "h2": [0] * len(own)})
            out += [*stream.feed(batch)]
        out += [*stream.close()]
        assert len(stream.ends) <= 2
        for found, state in out:
            for r, s in zip(found.to_pylist(), state.tolist(), strict=True):
                (lost if s == line_dedup.LOST else waiting).append((r["h1"], r["id"], r["line"]))
        ends += stream.ends
    totals, before = defaultdict(int), {}
    for h1, _, first, last, n in ends:
        totals[h1] += n - (before.get(h1) == first)
        before[h1] = last
    top = {h: max(e[2] for e in ends if e[0] == h) for h in totals}
    lost += [r for r in waiting if totals[r[0]] >= least and r[1] != top[r[0]]]
    ids = {k: {r[1] for r in rows if r[0] == k} for k in {r[0] for r in rows}}
    assert sorted(lost) == sorted(r for r in rows if len(ids[r[0]]) >= least and r[1] != max(ids[r[0]]))


def test_hot_line_over_many_ranges(spark):
    rows = [(i, f"{LINE}\nline number {i % 40} of a text that is long enough here\n{LINE}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = line_dedup.marks(line_dedup.keyed_lines(docs, "doc_id", "text", 40), 5)
        assert marked.where(f"state = {line_dedup.OPEN}").select("part").distinct().count() > 1  # the hot key spans ranges
        got = [tuple(r) for r in line_dedup.kept_texts(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(kept_by_hand(rows))


def test_bitmaps(spark):
    for lost, n in (([], 1), ([0], 1), ([3, 64, 99], 100)):
        kept = line_dedup.unpack(line_dedup.pack(np.array(lost, dtype=int), n), n)
        assert np.flatnonzero(~kept).tolist() == lost
    maps = line_dedup.keep_bitmaps(awkward(spark)).collect()
    assert {r.id for r in maps} == {1, 2, 3, 4, 5}
    five = next(r for r in maps if r.id == 5)
    assert (five.n_lines, five.n_dropped, line_dedup.unpack(bytes(five.keep), 3).tolist()) == (3, 2, [False, False, True])


# ---- importance resampling


def drawn_by_hand(docs, target, width, buckets=importance.BUCKETS):
    def features(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWERED))
        return len(words), [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(i, *features(t)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in each for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, n, fs in each:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = may[: 10 * len(may) // 100]
    return [(*r, 1 + rank.index(r) if r in rank else None) for r in out]


@pytest.mark.parametrize("width", [1, 3])
def test_resampling_of_awkward_rows(spark, width):
    rows = AWKWARD + [(100 + i, f"common words of text {i} " * (3 + i % 9)) for i in range(60)]
    target = ["Common words", None, "", "of text 7 of text 7"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("id", "block", "word", "gram", "rank", "score", "weight")})
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, id string")
    got = [tuple(r) for r in importance.resample(docs, aim, width=width).collect()]
    assert sorted(map(str, got)) == sorted(map(str, drawn_by_hand(rows, target, width)))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    got = [tuple(r) for r in importance.resample(some, none).collect()]
    assert sorted(map(str, got)) == sorted(map(str, drawn_by_hand([(1, "a b c")] * 2, [], 1)))


# ---- spelling variants


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abÿ", min_size=2, max_size=9), max_size=40), st.integers(1, 70))
def test_units_find_each_pair_once(words, together):
    words = sorted(words)
    got = []
    before, spelling.TOGETHER = spelling.TOGETHER, together
    try:
        for second in (False, True):
            for i, j in spelling.Unit(words, second).pairs(words):
                got += [(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    finally:
        spelling.TOGETHER = before
    want = [tuple(sorted((a, b), key=lambda w: (len(w), w))) for k, a in enumerate(words) for b in words[k + 1 :] if spelling.one_edit(a, b)]
    assert sorted(got) == sorted(want)


def test_long_words():
    a, b = "x" * 30 + "y" * 60, "x" * 30 + "z" + "y" * 60
    found = [(i.tolist(), j.tolist()) for second in (False, True) for i, j in spelling.Unit([a, b], second).pairs([a, b])]
    assert [f for f in found if f[0]] == [([0], [1])]


@pytest.mark.parametrize("shard", [7, 8192])
def test_pairs_whatever_the_shards(spark, shard):
    rng = np.random.default_rng(3)
    words = sorted({"inter" + "".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(250)} | {"".join(rng.choice(list("ab"), 6)) + "tion" for _ in range(60)})
    rows = [(w, int(n)) for w, n in zip(words, rng.integers(5, 900, len(words)), strict=True)]
    got = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame(rows, "word string, n long"), shard=shard).collect()]
    count = dict(rows)
    want = {frozenset((a, b)) for k, a in enumerate(words) for b in words[k + 1 :] if spelling.one_edit(a, b)}
    assert len(got) == len(want) and {frozenset((r[0], r[2])) for r in got} == want
    assert all(count[r[0]] == r[1] and count[r[2]] == r[3] for r in got)


def test_forms_and_roots(spark):
    rows = [("writing", 500), ("writng", 100), ("wriitng", 19), ("writings", 100), ("another", 7), ("anothers", 7)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert (got["writng"].form, got["writng"].form_n, got["writng"].root) == ("writing", 500, "writing")
    assert (got["writings"].form, got["writing"].form, got["writing"].n_near) == ("writing", None, 2)
    assert (got["wriitng"].form, got["wriitng"].root, got["wriitng"].n_near) == ("writng", "writing", 1)
    assert (got["another"].form, got["another"].root, got["another"].n_near) == (None, "another", 1)
    assert got["writng"].n_near == 2


def test_words_of_awkward_rows(spark):
    got = {r.word: r.n for r in spelling.word_counts(awkward(spark), least_count=1).collect()}
    want = Counter(w for _, t in AWKWARD for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWERED)) if len(w) >= 6)
    assert got == dict(want)
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_planted_errors(spark):
    rows = [(i, "Writing letters " * 3 + "writing") for i in range(400)] + [(None, "writing letters")]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), noise=7, least_count=1).collect()}
    want = Counter()
    for i, t in rows:
        for w in t.translate(LOWERED).split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[spelling.without(w, h) if h % 7 == 0 else w] += 1
    assert got == dict(want)
