"""Features of markup: 6 text, 53 tag and 28 inline-script columns, all as native expressions.

Markup is cut into tokens by one pattern in one pass: comments, scripts and styles with their bodies, declarations, end
tags and start tags. Whatever isn't closed runs to the end of the text, so no position is read again and hostile pages
take linear time. Broken markup is read as a lenient parser reads it: quotes count only after "=", a comment or a quoted
value without its end takes the rest, a script closed by "/>" has no body, and of repeated attributes the first counts.
Elements that a parser adds are added: ``html`` and ``body``, ``head`` before an element that belongs there, ``p`` around text
before all tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions.text import col, count_matches

#: What stands in a start tag after its name: values in quotes (the last one may lack its end), bare values, all else up to ">".
_REST = r"""(?:=\s*+"[^"]*+(?:"|\z)|=\s*+'[^']*+(?:'|\z)|=\s*+[^\s>"']++|[^>=/]++|=|/(?!>))*+"""
_NAME = r"[a-z][^\s/>]*+"
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<(script|style)(?=[\s/>]|\z){_REST}(?:/>|\z|>.*?(?:</\1\s*+>?|\z))"
    rf"|<{_NAME}{_REST}(?:/?>|\z)"
    r"|<[!?/][^>]*+>?"
)
_ATTRIBUTE = r"""([a-zA-Z_:@][-a-zA-Z0-9_:.@]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?"""
#: Elements that belong to the head, for which a parser adds one.
_OF_HEAD = ("script", "style", "meta", "link", "title", "base")
_PARTS = ("href", "src", "style", "type", "rel", "action", "hidden", "async")
_RICH = "array<struct<name: string, " + ", ".join(f"{k}: string" for k in _PARTS) + ">>"
BLOCKED = r"(?i)\b(suspended|blocked|forbidden|denied|restricted)\b"
#: Patterns counted in inline scripts, by feature.
SCRIPT_PATTERNS = {
    "html_create_element": r"createElement\(",
    "html_write": r"write\(",
    "html_char_code_at": r"charCodeAt\(",
    "html_concat": r"concat\(",
    "html_escape": r"(?<!n)escape\(",
    "html_eval": r"eval\(",
    "html_exec": r"exec\(",
    "html_from_char_code": r"fromCharCode\(",
    "html_link": r"link\(",
    "html_parse_int": r"parseInt\(",
    "html_replace": r"replace\(",
    "html_search": r"search\(",
    "html_substring": r"substring\(",
    "html_unescape": r"unescape\(",
    "html_add_event_listener": r"addEventListener\(",
    "html_set_interval": r"setInterval\(",
    "html_set_timeout": r"setTimeout\(",
    "html_push": r"push\(",
    "html_index_of": r"indexOf\(",
    "html_document_write": r"document\.write\(",
    "html_get": r"get\(",
    "html_find": r"find\(",
    "html_document_create_element": r"document\.createElement\(",
    "html_window_set_timeout": r"window\.setTimeout\(",
    "html_window_set_interval": r"window\.setInterval\(",
    "html_hex_encoding": r"\\x[0-9A-Fa-f]{2}",
    "html_unicode_encoding": r"\\u[0-9A-Fa-f]{4}",
    "html_long_variable_name": r"\b[a-zA-Z0-9_]{20,}\b",
}
#: Styles that hide an element.
HIDING = ("display: none", "visibility: hidden", "opacity: 0", "position: absolute")


def text_features(html: Column | str) -> dict[str, Column]:
    """Counts over the raw markup; all zero for null."""
    html = F.coalesce(col(html), F.lit(""))
    words = F.array_remove(F.split(html, r"(?U)\s+"), "")  # without a lambda, so that generated code shares it
    breaks = count_matches(html, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    unfinished = F.when((html == "") | html.rlike("[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]\\z"), 0).otherwise(1)
    letters = F.length(F.array_join(words, ""))
    return {
        "html_num_of_words": F.size(words).cast("long"),
        "html_num_of_lines": (breaks + unfinished).cast("long"),
        "html_unique_words": F.size(F.array_distinct(words)).cast("long"),
        "html_average_word_len": F.coalesce(F.try_divide(letters.cast("double"), F.size(words)), F.lit(0.0)),
        "html_blocked_keywords_label": html.rlike(BLOCKED).cast("long"),
        "html_num_of_blank_spaces": count_matches(html, r"(?U)\s{2,}"),
    }


def markup_tokens(html: Column | str) -> Column:
    """All comments, declarations and tags in order, scripts and styles with their bodies; null for null."""
    return F.regexp_extract_all(col(html), F.lit(_TOKEN), F.lit(0))


def _attributes(token: Column) -> Column:
    """array of (name, value) of a start tag; values without their quotes, names in lower case."""

    def attribute(a: Column) -> Column:
        value = F.regexp_extract(a, f"(?s)^{_ATTRIBUTE}", 2)
        bare = F.when(value.rlike("^[\"']"), F.regexp_replace(value, r"(?s)^([\"'])(.*?)\1?$", "$2")).otherwise(value)
        return F.struct(F.lower(F.regexp_extract(a, f"(?s)^{_ATTRIBUTE}", 1)).alias("k"), bare.alias("v"))

    rest = F.regexp_extract(token, f"(?is)^<{_NAME}({_REST})", 1)
    return F.transform(F.regexp_extract_all(rest, F.lit(f"(?s){_ATTRIBUTE}"), F.lit(0)), attribute)


def _scripts_of(tokens: Column) -> Column:
    scripts = F.filter(tokens, lambda t: t.rlike(r"(?i)^<script(?=[\s/>]|\z)"))
    inline = F.filter(scripts, lambda t: ~F.exists(_attributes(t), lambda a: a["k"] == "src"))
    return F.coalesce(F.array_join(inline, "\n"), F.lit(""))


def _name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, f"(?i)^<({_NAME})", 1))


def _tags_of(tokens: Column, html: Column) -> Column:
    def pick(attributes: Column, t: Column) -> Column:
        return F.struct(_name(t).alias("name"), *(F.get(F.filter(attributes, lambda a: a["k"] == k), F.lit(0))["v"].alias(k) for k in _PARTS))  # noqa: B023

    starts = F.filter(tokens, lambda t: t.rlike("^<[a-zA-Z]"))
    with_attributes = F.filter(starts, lambda t: t.rlike(r"^<[a-zA-Z][^\s/>]*+[\s/]++[^\s/>]"))
    rich = F.transform(with_attributes, lambda t: F.transform(F.array(_attributes(t)), lambda a: pick(a, t))[0])
    first = F.get(F.filter(starts, lambda t: ~t.rlike(r"(?i)^<html(?=[\s/>]|\z)")), F.lit(0))
    text = html.rlike(r"(?s)\A(?>(?:\s++|<!--.*?(?:-->|\z)|<[!?/][^>]*+>?)*+)(?!<[a-zA-Z])\S")
    add = lambda n, when: F.when(when, F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    any_node = (F.size(starts) > 0) | text
    implied = F.concat(add("html", any_node), add("head", F.coalesce(_name(first).isin(*_OF_HEAD), F.lit(False)) & ~text), add("body", any_node), add("p", text))
    return F.when(html.isNotNull(), F.struct(F.concat(implied, F.transform(starts, _name)).alias("names"), rich.alias("rich")))


def inline_scripts(html: Column | str) -> Column:
    """The scripts without a source, tags included, one after the other."""
    return _scripts_of(markup_tokens(html))


def tags(html: Column | str) -> Column:
    """names: of implied elements, then of those written, in order; rich: those with attributes, and the values that features need; null for null."""
    return _tags_of(markup_tokens(html), col(html))


def most_frequent(values: Column) -> Column:
    """How often the most frequent item occurs: one pass over the sorted array; 0 if it is empty."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), start, step, lambda s: s["best"])


def tag_features(tokens: Column | str) -> dict[str, Column]:
    """The 53 features of the array that ``tags`` returns; all zero for null."""
    names, rich = F.coalesce(col(tokens)["names"], F.array().cast("array<string>")), F.coalesce(col(tokens)["rich"], F.array().cast(_RICH))
    text = lambda t, k: F.coalesce(t[k], F.lit(""))
    has = lambda t, k: t[k].isNotNull()
    count = lambda keep: F.size(F.filter(rich, keep)).cast("long")
    named = lambda n: F.size(F.filter(names, lambda x: x == n)).cast("long")
    of = lambda n, test: count(lambda t: (t["name"] == n) & test(t))
    part = lambda t, k, s: F.contains(text(t, k), F.lit(s))
    value = lambda t, k: t[k]

    def hiding(t: Column) -> Column:
        style = text(t, "style")
        found = F.contains(style, F.lit(HIDING[0]))
        for h in HIDING[1:]:
            found = found | F.contains(style, F.lit(h))
        return found

    rel = lambda t: F.array_join(F.filter(F.split(F.trim(text(t, "rel")), r"\s+"), lambda x: x != ""), " ")
    anchors = F.filter(rich, lambda t: t["name"] == "a")
    hrefs = F.filter(F.transform(anchors, lambda t: text(t, "href")), lambda h: h != "")
    outside = F.filter(hrefs, lambda h: F.contains(h, F.lit("http")))
    inside = F.filter(hrefs, lambda h: ~F.contains(h, F.lit("http")))
    n = F.size(hrefs)
    share = lambda x: F.coalesce(F.try_divide(F.size(x).cast("double"), n), F.lit(0.0))
    most = most_frequent(hrefs)
    bad_form = lambda t: part(t, "action", "http") | part(t, "action", ".php") | part(t, "action", "#") | part(t, "action", "javascript:void")
    out = {
        "html_num_of_tags": F.size(F.array_distinct(names)).cast("long"),
        "html_num_of_paragraphs": named("p"),
        "html_num_of_divs": named("div"),
        "html_num_of_titles": named("title"),
        "html_num_of_external_js": of("script", lambda t: has(t, "src")),
        "html_num_of_links": named("link"),
        "html_num_of_scripts": named("script"),
        "html_num_of_scripts_async": of("script", lambda t: has(t, "async")),
        "html_num_of_scripts_type": of("script", lambda t: has(t, "type")),
        "html_num_of_anchors": named("a"),
        "html_num_of_anchors_to_hash": of("a", lambda t: value(t, "href") == "#"),
        "html_num_of_anchors_to_https": of("a", lambda t: part(t, "href", "http")),
        "html_num_of_anchors_to_com": of("a", lambda t: part(t, "href", ".com")),
        "html_num_of_anchors_to_content": of("a", lambda t: value(t, "href") == "#content"),
        "html_num_of_anchors_to_void": of("a", lambda t: value(t, "href") == "javascript:void(0)"),
        "html_num_of_inputs": named("input"),
        "html_num_of_input_password": of("input", lambda t: value(t, "type") == "password"),
        "html_num_of_hidden_elements": count(lambda t: has(t, "hidden") | hiding(t)),
        "html_num_of_input_hidden": of("input", lambda t: (text(t, "type") == "hidden") | hiding(t)),
        "html_num_of_objects": named("object"),
        "html_num_of_embeds": named("embed"),
        "html_num_of_frame": named("frame"),
        "html_num_of_iframe": named("iframe"),
        "html_num_of_iframe_src": of("iframe", lambda t: has(t, "src")),
        "html_num_of_iframe_src_https": of("iframe", lambda t: part(t, "src", "http")),
        "html_num_of_center": named("center"),
        "html_num_of_imgs": named("img"),
        "html_num_of_imgs_src": of("img", lambda t: has(t, "src")),
        "html_num_of_meta": named("meta"),
        "html_num_of_strong": named("strong"),
        "html_num_of_links_href": of("link", lambda t: has(t, "href")),
        "html_num_of_links_href_https": of("link", lambda t: part(t, "href", "http")),
        "html_num_of_links_href_css": of("link", lambda t: part(t, "href", ".css")),
        "html_num_of_links_type": of("link", lambda t: has(t, "type")),
        "html_num_of_link_type_app": of("link", lambda t: value(t, "type") == "application/rss+xml"),
        "html_num_of_link_rel": of("link", lambda t: rel(t) == "shortlink"),
        "html_num_of_icon": of("link", lambda t: rel(t) == "shortcut icon"),
        "html_icon_external": (of("link", lambda t: (rel(t) == "shortcut icon") & part(t, "href", "http")) > 0).cast("long"),
        "html_num_of_css_internal": of("link", lambda t: (rel(t) == "stylesheet") & ~part(t, "href", "http")),
        "html_num_of_css_external": of("link", lambda t: (rel(t) == "stylesheet") & part(t, "href", "http")),
        "html_num_of_all_hrefs": count(lambda t: has(t, "href")),
        "html_no_hrefs": F.when(F.size(names) == 0, 0).otherwise((n == 0).cast("long")).cast("long"),
        "html_internal_href_ratio": ((n > 0) & (share(inside) <= 0.5)).cast("long"),
        "html_num_of_internal_hrefs": F.size(inside).cast("long"),
        "html_external_href_ratio": ((n > 0) & (share(outside) > 0.5)).cast("long"),
        "html_num_of_external_href": F.size(outside).cast("long"),
        "html_most_common": F.coalesce(F.try_divide(most.cast("double"), n), F.lit(0.0)),
        "html_num_of_form_action": of("form", lambda t: has(t, "action")),
        "html_num_of_form_http": of("form", lambda t: part(t, "action", "http")),
        "html_num_of_form_php": of("form", lambda t: part(t, "action", ".php")),
        "html_num_of_form_hash": of("form", lambda t: part(t, "action", "#")),
        "html_num_of_form_js": of("form", lambda t: part(t, "action", "javascript:void()") | part(t, "action", "javascript:void(0)")),
        "html_malicious_form": (of("form", bad_form) > 0).cast("long"),
    }
    return out


def script_features(inline: Column | str) -> dict[str, Column]:
    return {name: count_matches(F.coalesce(col(inline), F.lit("")), pattern) for name, pattern in SCRIPT_PATTERNS.items()}


def html_features(df: DataFrame, html: str = "html") -> DataFrame:
    """df with all 87 features of the column of markup."""
    out = df.withColumn("__tokens", markup_tokens(html))
    out = out.withColumns({"__tags": _tags_of(F.col("__tokens"), F.col(html)), "__inline": _scripts_of(F.col("__tokens"))})
    features = text_features(html) | tag_features("__tags") | script_features("__inline")
    return out.withColumns(features).drop("__tokens", "__tags", "__inline")


def page_title(html: Column | str, size: int = 120) -> Column:
    """The first title, with white space collapsed and cut to ``size`` characters; null without one."""
    title = F.regexp_extract(col(html), r"(?is)\A(?>.*?<title[^<>]*+>)(.*?)</title>", 1)
    return F.nullif(F.substring(F.trim(F.regexp_replace(title, r"(?U)\s+", " ")), 1, size), F.lit(""))
