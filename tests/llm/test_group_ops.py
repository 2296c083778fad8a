"""Chat formatting, near-duplicates, embeddings, personal data, chunks, components and the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from harrier.llm import chat_format, chunk_dedup, embedding_dedup, minhash_dedup, pii
from harrier.llm.components import connected_components
from harrier.llm.queries import OP1_SQL, queries


def test_op1_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(OP1_SQL).df().sort_values("conv_id").reset_index(drop=True)
    got = queries()["op1_chat_format"](spark, sf).toPandas().sort_values("conv_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)
    assert got.identical.all()


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\[INST]", "\\\\</s>", " </s>", "a\\", "[ROLE] 41 x [/ROLE]", "", None, "<s>", " [/INST] ", "\n\n", "x" * 20_000]
    rows = [(1, i, r, t) for i, (t, r) in enumerate((t, r) for t in nasty for r in ("user", "assistant", "system", "Zoë [INST]", None))]
    rows += [(2, None, "user", "a"), (2, None, "user", "a"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, 1, "user", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat_format.format_conversations(table).collect()}
    assert all(r.identical for r in out.values()) and out[1].escaped and not out[2].escaped
    assert [(t.role, t.text) for t in out[1].recovered] == [(r or "", t or "") for _, _, r, t in rows[: 5 * len(nasty)]]
    assert "".join(s.text for s in out[1].segments) == out[1].formatted
    assert len(out[2].recovered) == 4 and sum(s.in_loss for s in out[2].segments) == 2
    assert chat_format.format_conversations(table.limit(0)).count() == 0


def brute_force_components(texts, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[k] = {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_minhash_against_brute_force(spark, sf, width, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_force_components({r.doc_id: r.text for r in docs.collect()}, width, percent)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, width=width, percent=percent).collect()}
    assert got == want


def test_minhash_family_of_edited_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    texts = {}
    for i in range(120):
        words = list(base)
        for j in rng.integers(0, 150, rng.integers(0, 9)):
            words[j] = f"n{rng.integers(0, 1e9)}"
        if i % 7 == 0:
            del words[int(rng.integers(0, 140)) : int(rng.integers(140, 150))][:3]
        texts[500 - i] = " ".join(words)
    texts |= {900: "", 901: None, 902: "Two words", 903: "two WORDS", 904: "one", 905: texts[500]}
    docs = spark.createDataFrame([*texts.items(), (902, "Two words"), (None, "two words")], "doc_id long, text string").withColumn("node", F.lit("clash"))
    want = brute_force_components(texts, 3, 85)
    for rounds, pairs, block in ((4, 200, 512), (4, 0, 512), (1, 0, 16)):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        monkeypatch.setattr(minhash_dedup, "LEADER_ROUNDS", rounds)
        monkeypatch.setattr(minhash_dedup, "PAIRS_PER_POSTING", pairs)
        rows = minhash_dedup.near_duplicates(docs, width=3, percent=85).collect()
        assert len(rows) == len(texts) + 2
        assert {r.id: (r.n_shingles, r.component_id) for r in rows if r.id is not None} == want
        assert [(r.component_id, r.kept) for r in rows if r.id is None] == [(None, True)]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_with_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(11)
    text = lambda: [f"w{i}" for i in rng.integers(0, 9000, 120)]
    a, b, c = text(), text(), text()
    edited = lambda x, j: " ".join([*x[:j], "other", *x[j + 1 :]])
    a, b, c, a2, b2, c2 = (" ".join(a), " ".join(b), " ".join(c), edited(a, 40), edited(b, 50), edited(c, 60))
    rows = [(5, a), (5, b), (6, a2), (7, b2), (8, c), (9, c2), (9, c2), (9, ""), (5, a), (3, None), (3, None), (None, a)]
    for parts, block in ((1, 512), (7, 2)):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"text_hash": F.lit("clash"), "__hash": F.lit("x")}).repartition(parts)
        found = [(r.id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()]
        want = [(5, True, 5, True)] * 3 + [(6, True, 5, False), (7, True, 5, False), (8, True, 8, True), (9, True, 8, False), (9, True, 8, False), (9, False, 9, True), (3, False, 3, True), (3, False, 3, True), (None, True, None, True)]
        assert Counter(found) == Counter(want)
        out = minhash_dedup.first_of_each(docs)
        assert out.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(5, a), (5, b), (8, c), (9, ""), (3, None), (None, a)])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 5), (9, 8), (8, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(300, 340)}, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, near = [], rng.normal(size=32)
    for i in range(400):
        v = near + rng.normal(size=32) * 0.05 if i % 3 == 0 else rng.normal(size=32)
        rows.append((i + 10, [float(x) for x in v], i % 2))
    for i in range(40):  # pairs around the threshold
        v = rows[i * 3 + 1][1]
        w = np.array(v) + rng.normal(size=32) * np.linalg.norm(v) / np.sqrt(32) * rng.uniform(0.2, 0.5)
        rows.append((1000 + i, [float(x) for x in w], rows[i * 3 + 1][2]))
    odd = [(1, None, 0), (2, [0.0] * 32, 0), (3, [float("nan")] + [1.0] * 31, 0), (4, [None] + [1.0] * 31, 0), (5, rows[0][1], None), (6, rows[0][1], 0), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), (9, [float("inf")] * 32, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("centre", F.lit("clash"))
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()}
    valid = [(k, np.array(v), y) for k, v, y in rows + odd if y is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = Counter(), {k: k for k, _, _ in rows + odd}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x, p) in enumerate(valid):
        for b, y, q in valid[i + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                u, v = sorted((root(a), root(b)))
                parent[v] = u
    want = {k: (links[k], root(k), root(k) == k) for k in parent}
    assert sum(want[k][0] for k in want) > 5000 and got == want
    assert got[1] == (0, 1, True) and got[6][0] > 50 and got[8] == (1, 7, False)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_of_one_group_outside_the_balls(spark, monkeypatch):
    # every pair of a group is linked, and far enough apart for no ball: lists must grow to the size of the group
    monkeypatch.setattr(embedding_dedup, "NEIGHBOURS", 2)
    monkeypatch.setattr(embedding_dedup, "GROUP", 8)
    rng = np.random.default_rng(8)
    base = rng.normal(size=512)
    vectors = [base + rng.normal(size=512) * 0.25 for _ in range(300)]
    table = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    unit = np.stack([v / np.sqrt(v @ v) for v in vectors])
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    got = {r.id: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert want.min() > 200 and [got[i].n_links for i in range(300)] == want.tolist()
    assert all(r.component_id == 0 for r in got.values())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(digits):
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0

    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_op8_base_spans(spark, sf):
    got = {r.doc_id: r for r in queries()["op8_pii"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base_spans(r.text).encode()).hexdigest()


def is_base(kind, value):
    return base_spans(value) == f"{kind}:0:{len(value)}"


def bootstrapped(texts):
    """The discovered spans (text, start, end, kind) by the rules of the docstring, and the spans' values, on the driver."""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    forms = {"email": email, "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9]){13,}", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    mention = regex.compile(forms["phone"] + r"|(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+|(?<!\S)(?=\S*[0-9@])\S++|(?<=[\p{L}\p{N}_][\x20\t]?[=:][\x20\t]?[\"']?)[\p{L}\p{N}_][^\s\"'=:]*+")
    label = r"[\p{L}_][\p{L}\p{N}_-]*+[\x20\t]?[=:]++[\x20\t]?[\"'(\[{<]*+"
    words = lambda t: regex.findall(r"[\p{L}']+", t.lower())
    found = []
    for text in texts:
        hits = list(mention.finditer(text))
        for i, m in enumerate(hits):
            before = text[hits[i - 1].end() if i else 0 : m.start()]
            after = text[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(text)]
            inner = regex.match(rf"({label})(?=[\p{{L}}\p{{N}}@+_])", m.group())
            outer = regex.search(rf"({label})$", before)
            skip = inner.end(1) if inner else 0
            raw = m.group()[skip:]
            lead = len(raw) - len(regex.sub(r"^[^\p{L}\p{N}@+_]+", "", raw))
            token = regex.sub(r"[^\p{L}\p{N}_]+$", "", raw[lead:])
            if not token:
                continue
            name = (inner or outer).group(1).lower() if inner or outer else ""
            full = [k for k, f in forms.items() if regex.fullmatch(f, token)]
            kind = next((k for k in full if is_base(k, token)), None)
            marked = name or raw[:1] in "\"'"
            if not kind and marked and regex.fullmatch("[0-9A-Fa-f]{32,}", token) and regex.search("[0-9]", token) and regex.search("[A-Fa-f]", token):
                kind = "secret"
            shape = regex.sub("(?:a9)+a?|(?:9a)+9?", "x", regex.sub(r"\p{N}+", "9", regex.sub(r"\p{L}+", "a", token)))
            left, right = words(before)[-4:], words(after)[:4]
            patterns = {f"<~ {w} {shape}" for w in left if shape != "a"} | {f">~ {w} {shape}" for w in right if shape != "a"}
            patterns |= {f"<~ {w}" for w in left} | {f">~ {w}" for w in right}
            patterns |= {"= " + regex.match(r"[\p{L}\p{N}_-]+", name).group()} if name else set()
            patterns |= {f"< {left[-2]} {left[-1]}"} if len(left) > 1 else set()
            patterns |= {f"<> {left[-1]} {right[0]}"} if left and right else set()
            start = m.start() + skip + lead
            found.append((text, start, start + len(token), token.lower(), kind, bool(set(full) & {"ip", "card", "phone"}), patterns))
    graph = {}
    for *_, value, kind, refuted, patterns in found:
        for p in patterns:
            old = graph.get((p, value), (None, False))
            graph[p, value] = (max(old[0] or "", kind or "") or None, old[1] or refuted)
    known = {}
    while True:
        accepted = {}
        sums, n = defaultdict(Counter), Counter(p for p, _ in graph)
        for (p, v), (kind, _) in graph.items():
            k, score = (kind, 1.0) if kind else known.get(v, (None, 0.0))
            sums[p][k] += score
        for p, s in sums.items():
            def low(share, n):
                z = 1.645
                return (share + z * z / (2 * n) - z * (max(share * (1 - share), 0) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            best = max((low(s[k] / n[p], n[p]), k) for k in pii.ALL_KINDS)
            if best[0] >= 0.6:
                accepted[p] = best
        alone = {p: accepted.pop(p)[1] for p in [*accepted] if regex.fullmatch(r"[<>]~ \S+", p)}
        accepted = {p: x for p, x in accepted.items() if p[1:3] != "~ " or alone.get(" ".join(p.split(" ")[:2])) == x[1]}
        votes = defaultdict(list)
        for (p, v), (kind, refuted) in graph.items():
            if kind not in PATTERNS and not refuted and v not in known and p in accepted:
                votes[v].append(accepted[p])
        new = {v: (max(a)[1], 1 - np.prod([1 - x for x, _ in a])) for v, a in votes.items()}
        new = {v: x for v, x in new.items() if x[1] >= 0.6}
        if not new:
            break
        known |= new
    spans = {(t, s, e, known[v][0]) for t, s, e, v, kind, *_ in found if kind not in PATTERNS and v in known}
    based = {t: [tuple(map(int, x.split(":")[1:])) for x in base_spans(t).split(",") if x] for t in {t for t, *_ in spans}}
    return {x for x in spans if not any(x[1] < e and s < x[2] for s, e in based[x[0]])}


def discovered(found):
    rows = found.select(F.col("row.text").alias("text"), F.explode("spans").alias("s"), "base").where(~F.array_contains("base", F.col("s"))).select("text", "s.start", "s.end", "s.kind").collect()
    return {(r.text, r.start, r.end, r.kind) for r in rows}


def planted_identifiers():
    """Texts with labelled identifiers in known company, and the values that must be found and those that mustn't."""
    hexes = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f'row {i} token = "{hexes(i)}" stands here' for i in range(8)] + [f"mail to user{i}@mail.example.com from us" for i in range(14)]
    texts += ["then Token = hunter_two stands here", "secret: hunter_two", "secret: tango", *(f"secret={hexes(100 + i)}" for i in range(14)), "mail to jane@intranet from us", "mail to @jane from us"]
    texts += [f"call +1 (017) 555-77{i}3 before noon" for i in range(10, 22)] + ["call 0711 for noon", "call +9 99 before noon", "card 4111111111111112 here", "300.1.1.1"]
    texts += [f"commit {hexes(500 + i)} of the tree" for i in range(9)] + ["version 3 of 2024", "Note: the", "http://example.org/a?b=c"]
    return texts, {"hunter_two", "jane@intranet", "@jane", hexes(3), hexes(105)}, {hexes(501), "4111111111111112", "300.1.1.1", "3", "2024", "the"}


def test_pii_bootstrapping_against_brute_force(spark, sf):
    texts, must, never = planted_identifiers()
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:5]])], "doc_id long, text string")
    got = discovered(pii.find(table))
    assert got == bootstrapped(texts)
    values = {t[s:e] for t, s, e, _ in got}
    assert must <= values and not never & values
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = discovered(pii.find(docs))
    assert got == bootstrapped({r.text for r in docs.collect() if r.text}) and len(got) > 10
    # of the planted secrets all are found, and nothing else is
    assert {t for t, *_ in got} == {r.text for r in docs.collect() if r.text and "token = " in r.text.lower()}
    assert all(regex.fullmatch("[0-9A-Fa-f]{40}", t[s:e]) for t, s, e, _ in got)


def test_pii_look_alikes(spark):
    """Plain tokens with digits near function words are left alone, with and without secrets in the same sentences."""
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    texts = [f"the row of {'red' if i % 2 else 'blue'} {i} and the token: {h} of the file and the rest" for i, h in enumerate(hexes)]
    texts += [f"the letters of user{i}@mail.example.com and the phone +1 (017) 555-77{i} of the office" for i in range(10, 40)]
    plain = ["born in the 1990s or the 2000s era", "use the mp3s and the b2b2c part of the firm", "see the part ab1cd2 in the store", f"the commit {hexes[0][::-1]} of the tree", "an A4x5 page and the rfc2616 text of the year 2019"]
    found = {r.text: r.spans for r in pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(texts + plain)], "doc_id long, text string")).select(F.col("row.text").alias("text"), pii.digest("spans").alias("spans")).collect()}
    assert all(found[t] == "" for t in plain), {t: found[t] for t in plain}
    assert all(found[t] == f"secret:{t.index(h)}:{t.index(h) + 40}" for t, h in zip(texts, hexes, strict=False))


def test_pii_edges(spark):
    texts = ["a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713, +1-2 ++44 20 7946 0958", "é a.b@c.de é 9.9.9.9", "", None, "1" * 5000 + "@x.y", "+1" * 300, "a" * 30_000 + "@", "a=" * 9000, " é x ".join(f"1.2.3.{i % 300}" for i in range(5000)), "4111111111111111 4111111111111111"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, f"text {i} please contact me under user{i}@mail.example.com today") for i in range(12)]
    rows += [(200, "again please contact me under ZX-77-4431 today"), (201, "clean room 4431 with a number"), (None, "please contact me under ZX-77-9999 now"), (200, "again please contact me under ZX-77-4431 today")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = pii.find(table).select("id", F.col("row.text").alias("text"), pii.digest("base").alias("base"), pii.digest("spans").alias("spans"), pii.redact(F.col("row.text"), F.col("spans")).alias("redacted")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.base == base_spans(r.text or ""), r.text
    found = {r.text: r for r in out}
    assert found["again please contact me under ZX-77-4431 today"].spans == "email:30:40"
    assert found["again please contact me under ZX-77-4431 today"].redacted == "again please contact me under <email> today"
    assert found["please contact me under ZX-77-9999 now"].spans == "email:24:34"
    assert found["clean room 4431 with a number"].spans == ""
    assert pii.find(table.limit(0)).count() == 0


def test_chunks_resist_insertion_and_find_repeats(spark):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n))
    passage = words(60)
    a, b = words(200), words(180)

    def chunks(text):
        ends = chunk_dedup.boundaries(np.frombuffer(text, np.uint8)).tolist()
        return {text[s:e] for s, e in zip([0, *ends], ends, strict=False)}

    before, after = chunks(a.encode()), chunks((a[:300] + "INSERTED" + a[300:]).encode())
    assert len(before - after) <= 3
    rows = [(1, a + " " + passage + " " + words(50)), (2, b[:400] + " " + passage + " " + b[400:]), (3, words(300)), (4, ""), (5, None), (6, "x y " * 2000), (2, b[:400] + " " + passage + " " + b[400:]), (None, passage), (7, words(20) + " " + " ".join(passage.split()[:12]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    found = chunk_dedup.repeats(table)
    got = defaultdict(list)
    for r in found.collect():
        got[r.id].append(r)
    assert [len(got[k]) for k in (1, 2, 3, 4, 5, 6, 7, None)] == [1, 2, 1, 1, 1, 1, 1, 1]
    assert [len(got[k][0].repeats) for k in (1, 2, 3, 4, 5, 6, 7, None)] == [1, 1, 0, 0, 0, 0, 0, 0]
    assert got[1][0].cuts == [] and len(got[2][0].cuts) == 1
    span = got[2][0].cuts[0]
    assert rows[1][1].encode()[span.start : span.end].decode() in " " + passage + " " and span.words >= 50
    cut = chunk_dedup.without_repeats(table, found)
    assert {len(r.text) for r in cut.where("doc_id = 2").collect()} == {len(rows[1][1]) - (span.end - span.start)}
    assert cut.count() == len(rows)
    assert chunk_dedup.repeats(table.limit(0)).count() == 0


def repeated_by_brute_force(texts, words=51):
    """The keys of the texts that share so many words in a row, and all between them, with a text of another id."""
    windows = defaultdict(set)
    for k, t in texts:
        ends = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", (t or "").encode())]
        for (start, _), (_, end) in zip(ends, ends[words - 1 :], strict=False):
            windows[(t or "").encode()[start:end]].add(k)
    return {k for ids in windows.values() if len(ids) > 1 for k in ids}


def test_chunks_against_brute_force(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.id for r in chunk_dedup.repeats(docs).collect() if r.repeats}
    want = repeated_by_brute_force(texts)
    assert len(want) > 50 and want <= got
    assert len(got - want) <= 2  # of pieces that several documents share
    # passages around the least length, in the midst of other words
    rng = np.random.default_rng(12)
    words = lambda n: [f"{'abcdefghij'[: rng.integers(1, 9)]}{i}" for i in rng.integers(0, 99, n)]
    rows = []
    for k in range(150):
        passage = words(46 + k % 10)
        rows += [(2 * k + side, " ".join([*words(rng.integers(0, 60)), *passage, *words(rng.integers(0, 60))])) for side in (0, 1)]
    got = {r.id for r in chunk_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.repeats}
    want = repeated_by_brute_force(rows)
    assert len(want) > 140 and got <= want and len(want - got) <= 2


def test_further():
    def both(a, b, run):
        i, j = a.index(run), b.index(run)
        beside = lambda t, at, right: (t[at - 1 :] if right else t[: at + 1][::-1]) + b" "
        return chunk_dedup.further(beside(a, i, False), beside(b, j, False), False), chunk_dedup.further(beside(a, i + len(run), True), beside(b, j + len(run), True), True)

    assert both(b"one two [run] three four", b"no two [run] three five", b"[run]") == ((4, 1), (6, 1))
    assert both(b"xx[run]yy", b"zz[run]ww", b"[run]") == ((0, 0), (0, -1))
    assert both(b" [run] ", b"z[run]", b"[run]") == ((0, -1), (0, 0))
    assert both(b"[run]", b"[run]", b"[run]") == ((0, 0), (0, 0))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, states = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        states = stage(spark, states, sf)
        assert states.columns == docs.columns, name
        states = spark.createDataFrame(states.toPandas(), docs.schema)
        ids.append({r.doc_id for r in states.collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 0.5 * docs.count()
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) == ids[-1] and out.decodes.all()
    assert not states.where(F.col("text").rlike(PATTERNS["email"])).count()


def test_pipeline_on_awkward_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", F.lit(None).cast("long").alias("n_chars"))
    table = docs.unionByName(extra).unionByName(docs.limit(2)).withColumns({"score": F.lit("clash"), "a.b": F.lit(1), "row": F.lit("clash")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns, name
        assert stage(spark, table.limit(0), sf).count() == 0, name
        assert 0 < out.count() <= table.count(), name


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def is_contaminated(text, windows):
    words = words_of(text)
    hit = {j for size in {len(w) for w in windows} for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in windows for j in range(i, i + size)}
    return bool(hit) and 20 * len(hit) >= len(words)


def redacted(text, more):
    out, at = [], 0
    spans = [(int(s), list(PATTERNS).index(k), int(e), k) for k, s, e in (x.split(":") for x in base_spans(text).split(",") if x)]
    for start, _, end, kind in sorted(spans + [(s, pii.ALL_KINDS.index(k), e, k) for t, s, e, k in more if t == text]):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join(out) + text[at:]


def test_pipeline_against_brute_force(spark, sf):
    """Every stage's rows, each from what the stage before it kept."""
    import public_tokenizers
    import tiktoken

    from harrier.llm.byte_bpe import load_ranks

    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    good = {r.doc_id for r in queries()["op3_quality_fm"](spark, sf).collect() if r.predicted}
    classes = brute_force_components({k: rows[k].text for k in good}, 5, 80)
    first = {k for k, (_, component) in classes.items() if component == k}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = words_of(r.text)
        windows |= {tuple(words[i : i + 13]) for i in range(max(len(words) - 12, 1))} - {()}
    clean = {k for k in first if not is_contaminated(rows[k].text, windows)}
    more = bootstrapped({rows[k].text for k in clean})
    texts = {k: redacted(rows[k].text, more) for k in clean}
    assert len(good) > len(first) > len(clean) > 0 and any(texts[k] != rows[k].text for k in clean)
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {k: tokenizer.encode_ordinary(t) for k, t in texts.items()}
