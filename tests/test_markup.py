"""Broken and hostile markup: counts against a character-by-character reader, and the time of pages made to be slow."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from harrier.operators import html_features as H


def read_slowly(page: str) -> tuple[list, list]:
    """(name, attributes) of each start tag and the inline scripts, one character after the other."""
    tags, scripts, i, n = [], [], 0, len(page)
    while i < n:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            i = n if end < 0 else end + 3
        elif page[i] == "<" and i + 1 < n and page[i + 1] in "!?/":
            end = page.find(">", i)
            i = n if end < 0 else end + 1
        elif page[i] == "<" and i + 1 < n and page[i + 1].isascii() and page[i + 1].isalpha():
            start, i = i, i + 1
            while i < n and page[i] not in " \n\t/>":
                i += 1
            name, rest = page[start + 1 : i].lower(), i
            closed = False
            while i < n and page[i] != ">":
                if page.startswith("/>", i):
                    closed = True
                    break
                if page[i] == "=":
                    j = i + 1
                    while j < n and page[j] in " \n\t":
                        j += 1
                    if j < n and page[j] in "\"'":
                        end = page.find(page[j], j + 1)
                        i = n if end < 0 else end + 1
                    else:
                        while j < n and page[j] not in " \n\t>\"'":
                            j += 1
                        i = j
                else:
                    i += 1
            attributes = {}
            for m in re.finditer(r"""([a-zA-Z_:@][-a-zA-Z0-9_:.@]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""", page[rest:i]):
                value = m.group(2) or ""
                if value[:1] in ("'", '"'):
                    value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
                attributes.setdefault(m.group(1).lower(), value)
            tags.append((name, attributes))
            i = min(n, i + (2 if closed else 1))
            if name in ("script", "style") and not closed and i < n:
                end = re.compile(rf"</{name}\s*>?", re.I).search(page, i)
                i = n if end is None else end.end()
            if name == "script" and "src" not in attributes:
                scripts.append(page[start:i])
        else:
            i += 1
    return tags, scripts


def test_broken_markup_against_a_slow_reader(spark):
    rng = random.Random(7)
    bits = ["<a href=", '"', "'", ">", "<!--", "-->", "<script>", "</script>", "<script src=x>", "<style>", "</style >", "<p", "/>", " ", "=", "x.php", "<div hidden style='opacity: 0'>", "text", "<", "/", "</p>", "<!x", "\n", "<A HREF='#'>", "<form action=http://x/>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(600)] + ["", "<", "</", "<!-", "<script", "a<b"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    tags = H.tags("html")
    for r in df.select("i", "html", tags["names"].alias("names"), tags["rich"].alias("rich"), H.inline_scripts("html").alias("inline")).collect():
        want, scripts = read_slowly(r.html)
        written = [n for n, _ in want]
        assert r.names[len(r.names) - len(written) :] == written, r.html
        got = [(t.name, t.href, t.style, t.action, t.hidden) for t in r.rich]
        assert [x for x in got if any(v is not None for v in x[1:])] == [(n, a.get("href"), a.get("style"), a.get("action"), a.get("hidden")) for n, a in want if {"href", "style", "action", "hidden"} & set(a)], r.html
        assert r.inline == "\n".join(scripts), r.html


@pytest.mark.parametrize(
    ("page", "names"),
    [
        ("plain words", ["html", "body", "p"]),
        ("  <!-- x -->words<p>", ["html", "body", "p", "p"]),
        ("<title>x</title><b>y", ["html", "head", "body", "title", "b"]),
        ("<html><meta charset=x>", ["html", "head", "body", "html", "meta"]),
        ("<div>x", ["html", "body", "div"]),
        ("<!doctype html>", []),
        ("", []),
    ],
)
def test_implied_elements(spark, page, names):
    assert spark.createDataFrame([(page,)], "html string").select(H.tags("html")["names"].alias("n")).first().n == names


def test_first_attribute_counts_and_null_gives_zero(spark):
    df = spark.createDataFrame([(1, "<a href='#' href='http://x'><a HREF = http://y/>"), (2, None)], "i int, html string")
    a, b = (r for r in H.html_features(df).orderBy("i").collect())
    assert (a.html_num_of_anchors, a.html_num_of_anchors_to_hash, a.html_num_of_external_href) == (2, 1, 1)
    assert all(v == 0 for k, v in b.asDict().items() if k.startswith("html_"))


HOSTILE = {"openers": "<script>", "tags": "<a ", "quotes": '<a href="x', "titles": "<title>", "cut titles": "<title", "less": "<", "comments": "<!--", "equals": "=", "ends": "</script "}


def test_hostile_pages_take_linear_time(spark):
    def seconds(size):
        df = spark.createDataFrame([(k + " <a " + v * (size // len(v)),) for k, v in HOSTILE.items()] + [("".join(f'<a href="/{i}">' for i in range(size // 16)),)], "html string").repartition(1)
        began = time.perf_counter()
        H.html_features(df.withColumn("title", H.page_title("html"))).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1_000)
    small, large = seconds(100_000), seconds(1_000_000)
    assert large < 30 * max(small, 1.0)


def test_most_frequent(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "v array<string>")
    assert [r[0] for r in df.select(H.most_frequent(F.col("v"))).collect()] == [2, 0, 1]
