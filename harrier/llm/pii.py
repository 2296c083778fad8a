r"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

Base spans are the leftmost non-overlapping matches of one expression per kind (email, ip, card, phone) that also
pass the kind's test; failing matches are dropped without a retry.

Bootstrapping then looks for identifiers that the expressions miss. *Mentions* are the base-like spans, every token
with digits or an at sign, and every token after a label (``user: ann``, ``key=value``). *Seeds* are the values that are
base entities and, as a fifth kind, ``secret``: labelled or quoted strings of 32 hexadecimal digits or more. A mention's
*patterns* are its label; the two words to its left; the words on both sides; and, for values that aren't plain words,
each word up to four words away on either side together with the value's shape (``+9 (9) 9-9``). Such a pattern must be
borne out by its word: the word's own values, of whatever shape, must be of the same kind as surely. So a word that stands
near values of all kinds ("the") gives nothing away, however alike the known values of one shape are.

Distinct (pattern, value) pairs form a bipartite graph. In each round a pattern is scored for the kind that prevails
among its values, by the lower bound (Wilson's, ``SURE`` standard deviations) of that kind's share of the values'
scores, unknown values counting as none, and accepted at ``PATTERN_SCORE`` (five values of one kind and no other pass);
a value that isn't known yet gets 1 - prod(1 - score) over its accepted patterns and joins the known ones at
``VALUE_SCORE``, for good. Rounds go on until none joins. Scores are per distinct value, so copies of a document give
no extra weight. Values that have the form of a base kind but fail its test are never revealed. A secret is reported
where an accepted pattern confirms it, not for its form alone.

Positions count code points, ends are exclusive. Null and empty texts have no spans. Repeated rows get equal spans
each. Texts are told apart by id and a hash, so a repeated id with another text does no harm; a null id is kept.
All of it is DataFrame functions, joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.components import checkpointed, salted

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and \G keep the matches of the plain expressions but don't try the same run twice.
_LOCAL = "[A-Za-z0-9._%+-]"
EXPRESSIONS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
GUARDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": EXPRESSIONS["card"], "phone": r"\+[0-9]"}
#: A label with its separator, and a value that follows one.
_LABEL = r"[\p{L}_][\p{L}\p{N}_-]*+[\x20\t]?[=:]++[\x20\t]?[\"'(\[{<]*+"
_LABELLED = r"(?<=[\p{L}\p{N}_][\x20\t]?[=:][\x20\t]?[\"']?)[\p{L}\p{N}_][^\s\"'=:]*+"
MENTION = rf"{EXPRESSIONS['phone']}|(?<![0-9]){EXPRESSIONS['card']}|(?<!\S)(?=\S*[0-9@])\S++|{_LABELLED}"
_LEAD, _TRAIL = r"^[^\p{L}\p{N}@+_]+", r"[^\p{L}\p{N}_]+$"
_SECRET = "^[0-9A-Fa-f]{32,}$"
#: All kinds of spans, in their order; those after the base kinds come from the method alone.
ALL_KINDS = (*KINDS, "secret")
PATTERN_SCORE = 0.6
VALUE_SCORE = 0.6
#: Standard deviations of the lower bound of a pattern's share.
SURE = 1.645
#: A word without a shape: evidence for patterns with one, no pattern of its own.
ALONE = r"^[<>]~ \S+$"
#: Words on either side that a pattern with a shape reaches.
REACH = 4
#: Matches of a text whose places are computed together.
RUN = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def weight(i: Column) -> Column:
        d = F.coalesce(F.substring(digits, -i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(places, weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The test that a match of a kind has to pass."""
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def located(text: Column, expression: str) -> Column:
    """All matches as an array of (start, end, value), from the gaps between them and their lengths."""
    hits = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    gaps = F.split(text, expression, -1)
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    def in_runs(steps: Column) -> Column:
        # appending copies an array, so matches are gathered in runs, and the runs in turn
        runs = F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(RUN))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start: int, end: int, value: string>>>").alias("runs"))

        def add_run(state: Column, i: Column) -> Column:
            begin = F.struct(state["at"].alias("at"), none.alias("found"))
            join = lambda s: F.struct(s["at"].alias("at"), F.concat(state["runs"], F.array(s["found"])).alias("runs"))
            return F.aggregate(F.slice(steps, i + 1, F.lit(RUN)), begin, add, join)

        return F.aggregate(runs, first, add_run, lambda s: F.flatten(s["runs"]))

    steps = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    steps = F.filter(steps, lambda x: x["hit"].isNotNull())  # one gap more than hits
    return F.get(F.transform(F.array(steps), in_runs), F.lit(0))  # steps are computed once


def base_spans(text: Column) -> Column:
    """All base spans as an array of (start, rank of the kind, end, kind), in order."""
    nothing = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")

    def of_kind(rank: int, kind: str) -> Column:
        good = F.filter(located(text, EXPRESSIONS[kind]), lambda m: passes(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
        return F.when(text.rlike(GUARDS[kind]), spans).otherwise(nothing)

    return F.array_sort(F.concat(*(of_kind(rank, kind) for rank, kind in enumerate(KINDS))))


def _words(gap: Column) -> Column:
    return F.regexp_extract_all(F.lower(gap), F.lit(r"[\p{L}']+"), F.lit(0))


def shape(value: Column) -> Column:
    """A value with its runs of letters, of digits and of both written as a, 9 and x."""
    runs = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), r"\p{N}+", "9")
    return F.regexp_replace(runs, "(?:a9)+a?|(?:9a)+9?", "x")


def mentions(docs: DataFrame) -> DataFrame:
    """From (id, text_hash, text): id, text_hash, start, end, value, kind (of a seed, or null), refuted and patterns, a row for each mention."""
    text = F.col("text")
    rows = docs.where(text.rlike("[0-9@=:]")).select("id", "text_hash", located(text, MENTION).alias("found"), F.split(text, MENTION, -1).alias("gaps")).where(F.size("found") > 0)
    # a mention with the text between it and its neighbours only, so that exploding doesn't multiply long texts
    beside = F.transform("found", lambda m, i: F.struct(m.alias("m"), F.get("gaps", i).alias("before"), F.get("gaps", i + 1).alias("after")))
    each = rows.select("id", "text_hash", F.explode(beside).alias("x")).select("id", "text_hash", "x.*")
    # a label stands inside the token, or before it
    inner = F.regexp_extract(F.col("m.value"), rf"^({_LABEL})(?=[\p{{L}}\p{{N}}@+_])", 1)
    outer = F.regexp_extract("before", rf"({_LABEL})$", 1)
    each = each.withColumn("raw", F.substring(F.col("m.value"), F.length(inner) + 1, F.length("m.value"))).withColumn("inside", F.length(inner)).withColumn("label", F.when(F.length(inner) > 0, inner).otherwise(outer))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", _LEAD, ""))
    token = F.regexp_replace(F.regexp_replace("raw", _LEAD, ""), _TRAIL, "")
    each = each.select(
        "id",
        "text_hash",
        (F.col("m.start") + F.col("inside") + lead).alias("start"),
        (F.col("m.start") + F.col("inside") + lead + F.length(token)).alias("end"),
        token.alias("token"),
        F.lower(token).alias("value"),
        shape(token).alias("shape"),
        F.regexp_extract(F.lower("label"), r"^[\p{L}\p{N}_-]+", 0).alias("label"),
        ((F.length("label") > 0) | F.col("raw").rlike("^[\"']")).alias("marked"),
        F.reverse(F.slice(F.reverse(_words(F.col("before"))), 1, REACH)).alias("left"),
        F.slice(_words(F.col("after")), 1, REACH).alias("right"),
    ).where(F.length("value") > 0)
    form = {k: F.col("token").rlike(f"^(?:{EXPRESSIONS[k]})$") for k in KINDS}
    secret = F.col("marked") & F.col("token").rlike(_SECRET) & F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Fa-f]")
    kind = F.coalesce(*(F.when(form[k] & passes(k, F.col("token")), F.lit(k)) for k in KINDS), F.when(secret, F.lit("secret")))
    refuted = form["ip"] | form["card"] | form["phone"]
    one, two = F.get("left", F.size("left") - 1), F.get("left", F.size("left") - 2)
    patterns = [
        F.when(F.length("label") > 0, F.concat(F.lit("= "), F.col("label"))),
        F.when(F.size("left") >= 2, F.concat_ws(" ", F.lit("<"), two, one)),
        F.when((F.size("left") >= 1) & (F.size("right") >= 1), F.concat_ws(" ", F.lit("<>"), one, F.get("right", F.lit(0)))),
    ]
    far = F.concat(F.transform("left", lambda w: F.concat_ws(" ", F.lit("<~"), w, "shape")), F.transform("right", lambda w: F.concat_ws(" ", F.lit(">~"), w, "shape")))
    far = F.when(F.col("shape") != "a", far).otherwise(F.array().cast("array<string>"))
    alone = F.concat(F.transform("left", lambda w: F.concat_ws(" ", F.lit("<~"), w)), F.transform("right", lambda w: F.concat_ws(" ", F.lit(">~"), w)))
    return each.select("id", "text_hash", "start", "end", "value", kind.alias("kind"), refuted.alias("refuted"), F.array_distinct(F.array_compact(F.concat(F.array(*patterns), far, alone))).alias("patterns"))


def sure(share: Column, n: Column) -> Column:
    """Wilson's lower bound of a share of n."""
    z = SURE
    spread = z * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def _patterns(totals: DataFrame, gained: DataFrame | None) -> DataFrame:
    """pattern, kind and score of the accepted patterns, from the sums of seeds and of the values found so far."""
    every = totals if gained is None else totals.unionByName(gained.withColumn("n", F.lit(0).cast("long"))).groupBy("pattern").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in ALL_KINDS))
    best = F.greatest(*(F.struct(sure(F.col(k) / F.col("n"), F.col("n")).alias("score"), F.lit(k).alias("kind")) for k in ALL_KINDS))
    good = every.select("pattern", best.alias("best")).where(F.col("best.score") >= PATTERN_SCORE).select("pattern", "best.kind", "best.score")
    words = good.where(F.col("pattern").rlike(ALONE)).select(F.col("pattern").alias("by"), F.col("kind").alias("word_kind"))
    with_word = good.where(~F.col("pattern").rlike(ALONE)).withColumn("by", F.when(F.col("pattern").rlike("^[<>]~ "), F.substring_index("pattern", " ", 2)))
    return with_word.join(words, "by", "left").where((F.col("by").isNull()) | (F.col("word_kind") == F.col("kind"))).select("pattern", "kind", "score")


def _sums(rows: DataFrame, score: Column) -> list[Column]:
    return [F.sum(F.when(F.col("kind") == k, score).otherwise(0.0)).alias(k) for k in ALL_KINDS]


def bootstrap(graph: DataFrame) -> DataFrame:
    """value, kind and score of the values that accepted patterns reveal, from (pattern, value, kind, refuted)."""
    totals = checkpointed(graph.groupBy("pattern").agg(F.count("*").alias("n"), *_sums(graph, F.lit(1.0))))
    open_pairs = graph.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) & ~F.col("refuted") & ~F.col("pattern").rlike(ALONE))
    known = gained = None
    while True:
        votes = salted(open_pairs.select("pattern", "value"), _patterns(totals, gained), "pattern", "value")
        scored = votes.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best"), F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999)))).alias("miss"))
        new = scored.select("value", F.col("best.kind").alias("kind"), (1 - F.exp("miss")).alias("score")).where(F.col("score") >= VALUE_SCORE)
        new = checkpointed(new if known is None else new.join(known, "value", "left_anti"))
        if new.isEmpty():
            return new if known is None else known
        known = new if known is None else checkpointed(known.unionByName(new))
        # seeds count in the totals already
        more = salted(graph.where("kind IS NULL").select("pattern", "value"), new, "value", "pattern")
        more = more.groupBy("pattern").agg(*_sums(more, F.col("score")))
        gained = checkpointed(more if gained is None else gained.unionByName(more).groupBy("pattern").agg(*(F.sum(k).alias(k) for k in ALL_KINDS)))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row (all columns of docs), base (spans of the expressions) and spans (those and the discovered ones), one row a document."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    occurrences = checkpointed(mentions(rows))
    pairs = occurrences.select("value", "kind", "refuted", F.explode("patterns").alias("pattern"))
    # a value's seed kind is that of any of its mentions
    known = bootstrap(checkpointed(pairs.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("refuted").alias("refuted"))))
    based = rows.withColumn("base", base_spans(F.col("text")))
    if known.isEmpty():
        return based.select("id", "row", "base", F.col("base").alias("spans"))
    candidates = occurrences.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select("id", "text_hash", "start", "end", "value")
    revealed = salted(candidates, known.select("value", F.col("kind").alias("found")), "value", "text_hash")
    rank = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("found")).cast("int") - 1
    more = revealed.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", F.col("found").alias("kind"))).alias("more"))
    same = based["id"].eqNullSafe(more["id"]) & (based["text_hash"] == more["text_hash"])
    joined = based.join(more, same, "left").select(based["id"], "row", "base", "more")
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    return joined.select("id", "row", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", apart))).alias("spans"))


def digest(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        parts = F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("<"), x["kind"], F.lit(">")))
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["parts"], parts).alias("parts"))).otherwise(s)

    done = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(spans, state, step, done)
