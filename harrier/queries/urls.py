"""Queries over ``pages``: URL parsing, lexical features, host names and markup, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions.text import count_of, digit_count, entropy_by_length, md5_mod, simhash32
from harrier.functions.urls import host_parts, normalize_url, url_parts
from harrier.operators.domain_features import name_features
from harrier.operators.explain import url_signals
from harrier.operators.html_features import SCRIPT_PATTERNS, html_features, inline_scripts, page_title, script_features, tag_features, tags, text_features
from harrier.operators.url_features import FREE_HOSTING, WordLists, near, repeats, train_transitions, url_features, words_array

#: Short lists that the catalogue's queries use.
BRANDS, KEYWORDS = ("example", "ontion", "therin", "tion"), ("page", "ref", "blog", "the", "login")
BIGRAMS = ("co", ".c", "om", "eb", "re", "te", "th", "he", "in", "er")
LISTS = WordLists(BRANDS, KEYWORDS)

ROUND = 9


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_parts(_pages(spark, sf_dir).select("page_id", normalize_url("url").alias("url")))


#: The same parts in SQL, for hosts under suffixes of one label.
PARTS = """
n AS (
  SELECT page_id, regexp_extract(trim(url), '^([^:/?#]+)://', 1) || '://' || lower(regexp_extract(trim(url), '^[^:/?#]+://(?:[^/?#@]*@)*([^/?#:]*)', 1)) || regexp_replace(trim(url), '^[^:/?#]+://[^/?#]*', '') AS url FROM pages
), h AS (
  SELECT *, trim(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1), '.') AS host FROM n
), l AS (
  SELECT *, string_split(host, '.') AS labels FROM h
), p AS (
  SELECT page_id, url, host, regexp_extract(url, '^(.*?)://', 1) AS protocol, labels[-1] AS tld, labels[-2] AS domain, array_to_string(labels[:-3], '.') AS subdomain FROM l
), u AS (
  SELECT *, regexp_extract(substr(url, greatest(strpos(url, tld), 1)), '(?s)/.*$') AS path FROM p
), w AS (
  SELECT *, list_filter(list_concat(list_concat(regexp_split_to_array(lower(domain), '[-./?=@&%:_]'), regexp_split_to_array(lower(regexp_replace(path, '^/', '')), '[-./?=@&%:_]')), regexp_split_to_array(lower(subdomain), '[-./?=@&%:_]')), lambda x: x <> '') AS words FROM u
)
"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def url_normalize(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", normalize_url("url").alias("normalized"), F.length(normalize_url("url")).cast("long").alias("size"))


def url_parts_query(spark, sf_dir):
    return _parts(spark, sf_dir).select("page_id", "host", "protocol", "subdomain", "domain", "tld", "registered_domain")


def url_path_suffix_find(spark, sf_dir):
    return _parts(spark, sf_dir).select("page_id", "path", F.length("path").cast("long").alias("path_length"))


def url_digit_length_counts(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return parts.select("page_id", *(digit_count(c).alias(f"{c}_digit_count") for c in ("domain", "subdomain", "path")), *(F.length(c).cast("long").alias(f"{c}_length") for c in ("domain", "subdomain", "path")))


NAMED = {"-": "hyphens", ".": "dots", "/": "slashes", "@": "ats", "?": "questions", "&": "ampersands", "=": "equals", "_": "underscores"}


def url_special_chars(spark, sf_dir):
    text = F.concat("domain", "subdomain", "path")
    return _parts(spark, sf_dir).select("page_id", *(count_of(text, c).alias(n) for c, n in NAMED.items()))


def _features(spark, sf_dir):
    return url_features(_parts(spark, sf_dir), LISTS)


def url_known_tld_puny(spark, sf_dir):
    return _features(spark, sf_dir).select("page_id", F.col("isKnownTld").alias("known_tld"), F.col("punnyCode").alias("puny_code"), F.col("subDomainCount").alias("subdomain_count"))


def url_words_raw(spark, sf_dir):
    return _parts(spark, sf_dir).select("page_id", F.array_join("words_raw", " ").alias("words"), F.size("words_raw").cast("long").alias("n_words"))


def url_word_stats(spark, sf_dir):
    columns = ("raw_word_count", "average_word_length", "longest_word_length", "shortest_word_length", "std_word_length")
    return _features(spark, sf_dir).select("page_id", *(F.round(c, ROUND).alias(c) if c[:3] in ("ave", "std") else F.col(c) for c in columns))


def url_char_repeat(spark, sf_dir):
    return _parts(spark, sf_dir).select("page_id", F.aggregate("words_raw", F.lit(0), lambda a, w: a + repeats(w)).cast("long").alias("char_repeat"))


def keyword_similarity(spark, sf_dir):
    words = _parts(spark, sf_dir).select(F.explode("words_raw").alias("word")).distinct()
    listed = words_array(BRANDS + KEYWORDS)
    return words.select("word", near(F.col("word"), listed).cast("long").alias("n_near"), F.array_contains(listed, F.col("word")).alias("listed"))


def fwb_suffix_match(spark, sf_dir):
    hosts = tuple(FREE_HOSTING) + ("example.net",)
    return url_features(_parts(spark, sf_dir), WordLists(BRANDS, KEYWORDS, free_hosting=hosts)).select("page_id", F.col("domain_in_FWB_list").alias("free_hosting"), F.col("domain_in_brand_list").alias("brand"))


def url_word_classes(spark, sf_dir):
    names = ("keyword_count", "brand_name_count", "negligible_word_count", "target_brand_count", "target_keyword_count", "similar_brand_count", "similar_keyword_count")
    return _features(spark, sf_dir).select("page_id", *names)


def popular_hosts(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    # hosts with five pages or more stand for a list of popular hosts
    listed = parts.groupBy("host").agg(F.count("*").alias("n")).where("n >= 5").select("host")
    return url_features(parts.withColumn("domain", F.when(F.col("subdomain") != "", F.substring_index("subdomain", ".", 1)).otherwise(F.col("domain"))), LISTS, popular=listed).select("page_id", "popularity1m")


def host_entropy(spark, sf_dir):
    return _parts(spark, sf_dir).select("page_id", F.round(entropy_by_length("host"), ROUND).alias("entropy"))


def md5_mod31(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", md5_mod("text").alias("hash"))


def tld_simhash(spark, sf_dir):
    return _parts(spark, sf_dir).select("tld", simhash32("tld").alias("hash")).distinct()


def host_parts_query(spark, sf_dir):
    hosts = _parts(spark, sf_dir).select("host").distinct()
    return hosts.select("host", host_parts("host").alias("p")).select("host", "p.subdomain", "p.domain", "p.suffix")


LEX = ("lex_name_len", "lex_has_digit", "lex_consecutive_chars", "lex_tld_len", "lex_sld_len", "lex_sld_vowel_count", "lex_sld_consonant_count", "lex_sld_hex_count", "lex_sub_count", "lex_stld_unique_char_count", "lex_begins_with_digit", "lex_www_flag", "lex_sub_max_consonant_len", "lex_sub_vowel_count", "lex_sub_digit_count", "lex_shortest_sub_len")


def _names(spark, sf_dir):
    hosts = _parts(spark, sf_dir).select(F.col("host").alias("domain_name")).distinct()
    return name_features(hosts, ngrams={2: BIGRAMS})


def domain_lexical(spark, sf_dir):
    return _names(spark, sf_dir).select("domain_name", *LEX, F.round("lex_sub_vowel_ratio", ROUND).alias("lex_sub_vowel_ratio"), "lex_tld_abuse_score")


def ngram_matches(spark, sf_dir):
    return _names(spark, sf_dir).select("domain_name", "lex_phishing_bigram_matches", "lex_phishing_keyword_count", "lex_sld_phishing_keyword_count")


def part_length_stats(spark, sf_dir):
    columns = ("lex_longest_part_len", "lex_short_part_count", "lex_medium_part_count", "lex_long_part_count", "lex_superlong_part_count")
    return _names(spark, sf_dir).select("domain_name", F.round("lex_avg_part_len", ROUND).alias("avg_len"), F.round("lex_stdev_part_lens", ROUND).alias("sd_len"), *columns)


def bigram_train(spark, sf_dir):
    return train_transitions(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("first", "second", F.round("log_probability", ROUND).alias("log_probability"))


def html_text_stats(spark, sf_dir):
    f = text_features("html")
    return _pages(spark, sf_dir).select("page_id", *(F.round(c, ROUND).alias(n) if n.endswith("word_len") else c.alias(n) for n, c in f.items()))


def html_js_patterns(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("inline", inline_scripts("html"))
    return pages.select("page_id", *(c.alias(n) for n, c in script_features("inline").items()))


HTML_COUNTS = ("html_num_of_tags", "html_num_of_paragraphs", "html_num_of_divs", "html_num_of_titles", "html_num_of_scripts", "html_num_of_meta", "html_num_of_anchors", "html_num_of_links", "html_num_of_imgs", "html_num_of_inputs", "html_num_of_strong")


def html_tag_counts(spark, sf_dir):
    f = tag_features("tags")
    return _pages(spark, sf_dir).select("page_id", tags("html").alias("tags")).select("page_id", *(f[n].alias(n) for n in HTML_COUNTS))


def html_anchor_stats(spark, sf_dir):
    f = tag_features("tags")
    names = ("html_num_of_anchors_to_hash", "html_num_of_anchors_to_https", "html_num_of_anchors_to_com", "html_num_of_all_hrefs", "html_no_hrefs", "html_num_of_internal_hrefs", "html_num_of_external_href", "html_internal_href_ratio", "html_external_href_ratio")
    return _pages(spark, sf_dir).select("page_id", tags("html").alias("tags")).select("page_id", *(f[n].alias(n) for n in names), F.round(f["html_most_common"], ROUND).alias("html_most_common"))


def html_all_features(spark, sf_dir):
    return html_features(_pages(spark, sf_dir)).drop("html", "url")


def url_all_features(spark, sf_dir):
    features = url_features(_parts(spark, sf_dir), LISTS)
    return features.drop("words_raw")


def evidence_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", page_title("html").alias("title"))


def signals_url(spark, sf_dir):
    features = _features(spark, sf_dir)
    return features.select("page_id", F.array_join(F.transform(url_signals(features), lambda s: s["label"]), "; ").alias("signals"))


QUERIES = {
    "url_normalize": url_normalize,
    "url_parts": url_parts_query,
    "url_path_suffix_find": url_path_suffix_find,
    "url_digit_length_counts": url_digit_length_counts,
    "url_special_chars": url_special_chars,
    "url_known_tld_puny": url_known_tld_puny,
    "url_words_raw": url_words_raw,
    "url_word_stats": url_word_stats,
    "url_char_repeat": url_char_repeat,
    "url_word_classes": url_word_classes,
    "url_all_features": url_all_features,
    "keyword_similarity": keyword_similarity,
    "fwb_suffix_match": fwb_suffix_match,
    "popular_hosts": popular_hosts,
    "host_entropy": host_entropy,
    "host_parts": host_parts_query,
    "md5_mod31": md5_mod31,
    "tld_simhash": tld_simhash,
    "domain_lexical": domain_lexical,
    "ngram_matches": ngram_matches,
    "part_length_stats": part_length_stats,
    "bigram_train": bigram_train,
    "html_text_stats": html_text_stats,
    "html_js_patterns": html_js_patterns,
    "html_tag_counts": html_tag_counts,
    "html_anchor_stats": html_anchor_stats,
    "html_all_features": html_all_features,
    "evidence_title": evidence_title,
    "signals_url": signals_url,
}

_ENTROPY = "CASE WHEN length({t}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({t}, '')), lambda c: -((length({t}) - length(replace({t}, c, ''))) / length({t})) * log2((length({t}) - length(replace({t}, c, ''))) / length({t})))) / length({t}) END"
_LENGTHS = "list_transform(ws, lambda x: length(x))"
#: Words without digits and with their classes: a listed word, one near a listed word, or one of over three characters.
_CLASSES = f"""
c AS (
  SELECT page_id, list_transform(words, lambda x: regexp_replace(x, '\\d+', '', 'g')) AS ws0 FROM w
), k AS (
  SELECT page_id, list_filter(ws0, lambda x: list_contains({_list(KEYWORDS)}, x) OR list_contains({_list(BRANDS)}, x) OR len(list_filter({_list(BRANDS + KEYWORDS)}, lambda y: levenshtein(x, y) < 2)) > 0 OR length(x) > 3) AS ws FROM c
), ck AS (
  SELECT page_id, ws, list_filter(ws, lambda x: NOT list_contains({_list(KEYWORDS)}, x) AND NOT list_contains({_list(BRANDS)}, x)) AS checked FROM k
)
"""
_NEAR = lambda words: f"list_sum(list_transform(checked, lambda x: len(list_filter({_list(words)}, lambda y: levenshtein(x, y) < 2))))"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<script\\b[^>]*>).*?(</script)', '\\1\\2', 'gsi'), '(<style\\b[^>]*>).*?(</style)', '\\1\\2', 'gsi')"
_TAGS = f"""t AS (
  SELECT page_id, regexp_extract_all({_CLEAN}, '(?s)<[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS raw FROM pages
), g AS (
  SELECT page_id, raw, list_transform(raw, lambda x: lower(regexp_extract(x, '^<([a-zA-Z][^\\s/>]*)', 1))) AS names,
    list_filter(raw, lambda x: regexp_matches(x, '^<[aA][\\s/>]')) AS anchors FROM t
), a AS (
  SELECT *, list_filter(list_transform(anchors, lambda x: regexp_extract(x, '\\shref="([^"]*)"', 1)), lambda x: x <> '') AS hrefs FROM g
)"""
_INLINE = "array_to_string(list_filter(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?is)<script\\b[^>]*>.*?</script\\s*>'), lambda s: NOT regexp_matches(regexp_extract(s, '(?is)^<script\\b([^>]*)>', 1), '(?i)(^|\\s)src(\\s|=|$)')), chr(10))"


def _count_sql(name: str, pattern: str) -> str:
    if name == "html_escape":  # without look-behind: all, less those after n
        return "CAST(len(regexp_extract_all(i, 'escape\\(')) - len(regexp_extract_all(i, 'nescape\\(')) AS BIGINT) AS html_escape"
    return f"CAST(len(regexp_extract_all(i, '{pattern}')) AS BIGINT) AS {name}"


_LEX_SQL = """
SELECT domain_name, CAST(length(domain_name) AS BIGINT) AS lex_name_len, CAST(regexp_matches(domain_name, '\\d') AS BIGINT) AS lex_has_digit,
  CAST(list_max(list_transform(range(1, length(domain_name) + 1), lambda i: length(domain_name) - i + 1 - length(ltrim(substr(domain_name, i), substr(domain_name, i, 1))))) AS BIGINT) AS lex_consecutive_chars,
  CAST(length(tld) AS BIGINT) AS lex_tld_len, CAST(length(domain) AS BIGINT) AS lex_sld_len,
  CAST(len(regexp_extract_all(domain, '[aeiouy]')) AS BIGINT) AS lex_sld_vowel_count, CAST(len(regexp_extract_all(domain, '[b-df-hj-np-tv-z]')) AS BIGINT) AS lex_sld_consonant_count,
  CAST(len(regexp_extract_all(domain, '[0-9A-Fa-f]')) AS BIGINT) AS lex_sld_hex_count,
  CAST(len(list_filter(string_split(subdomain, '.'), lambda x: x <> '')) - CAST(list_contains(string_split(subdomain, '.'), 'www') AS INT) AS BIGINT) AS lex_sub_count,
  CAST(len(list_distinct(string_split(domain || tld, ''))) AS BIGINT) AS lex_stld_unique_char_count, CAST(regexp_matches(domain_name, '^\\d') AS BIGINT) AS lex_begins_with_digit,
  CAST(string_split(domain_name, '.')[1] = 'www' AS BIGINT) AS lex_www_flag,
  CAST(coalesce(list_max(list_transform(regexp_extract_all(sub, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0) AS BIGINT) AS lex_sub_max_consonant_len,
  CAST(len(regexp_extract_all(sub, '[aeiouy]')) AS BIGINT) AS lex_sub_vowel_count, CAST(len(regexp_extract_all(sub, '\\d')) AS BIGINT) AS lex_sub_digit_count,
  CAST(length(sub) AS BIGINT) AS lex_shortest_sub_len, round(len(regexp_extract_all(sub, '[aeiouy]')) / length(sub), 9) AS lex_sub_vowel_ratio,
  CAST(CASE tld WHEN 'com' THEN 0.6554 WHEN 'net' THEN 0.1040 WHEN 'org' THEN 0.0081 ELSE 0 END AS DOUBLE) AS lex_tld_abuse_score
FROM (SELECT DISTINCT host AS domain_name, tld, domain, subdomain, replace(subdomain || domain, '.', '') AS sub FROM u)
"""
_RISK = '["account","action","alert","app","auth","bank","billing","center","chat","device","fax","event","find","free","gift","help","info","invoice","live","location","login","mail","map","message","my","new","nitro","now","online","pay","promo","real","required","safe","secure","security","service","signin","support","track","update","verification","verify","vm","web"]'.replace('"', "'")
_DIGITS = lambda c: f"CAST(len(regexp_extract_all({c}, '\\d')) AS BIGINT) AS {c}_digit_count, CAST(length({c}) AS BIGINT) AS {c}_length"
_ALL = "domain || subdomain || path"

SQL = {
    "url_normalize": f"WITH {PARTS} SELECT page_id, url AS normalized, CAST(length(url) AS BIGINT) AS size FROM n",
    "url_parts": f"WITH {PARTS} SELECT page_id, host, protocol, subdomain, domain, tld, domain || '.' || tld AS registered_domain FROM u",
    "url_path_suffix_find": f"WITH {PARTS} SELECT page_id, path, CAST(length(path) AS BIGINT) AS path_length FROM u",
    "url_digit_length_counts": f"WITH {PARTS} SELECT page_id, {_DIGITS('domain')}, {_DIGITS('subdomain')}, {_DIGITS('path')} FROM u",
    "url_special_chars": f"WITH {PARTS} SELECT page_id, " + ", ".join(f"CAST(length({_ALL}) - length(replace({_ALL}, '{c}', '')) AS BIGINT) AS {n}" for c, n in NAMED.items()) + " FROM u",
    "url_known_tld_puny": f"WITH {PARTS} SELECT page_id, CAST(tld IN ('com', 'org', 'net', 'de', 'edu', 'gov') AS BIGINT) AS known_tld, CAST(starts_with(domain, 'xn--') AS BIGINT) AS puny_code, CAST(len(string_split(subdomain, '.')) AS BIGINT) AS subdomain_count FROM u",
    "url_words_raw": f"WITH {PARTS} SELECT page_id, array_to_string(words, ' ') AS words, CAST(len(words) AS BIGINT) AS n_words FROM w",
    "url_word_stats": f"WITH {PARTS}, {_CLASSES} SELECT page_id, CAST(len(ws) AS BIGINT) AS raw_word_count, round(coalesce(list_avg({_LENGTHS}), 0.0), 9) AS average_word_length, CAST(coalesce(list_max({_LENGTHS}), 0) AS BIGINT) AS longest_word_length, CAST(coalesce(list_min({_LENGTHS}), 0) AS BIGINT) AS shortest_word_length, round(coalesce(list_stddev_pop({_LENGTHS}), 0.0), 9) AS std_word_length FROM ck",
    "url_char_repeat": f"WITH {PARTS} SELECT page_id, CAST(coalesce(list_sum(list_transform(words, lambda x: list_sum(list_transform([2, 3, 4, 5], lambda k: len(list_filter(range(1, greatest(length(x) - k + 2, 1)), lambda i: substr(x, i, k) = repeat(substr(x, i, 1), k))))))), 0) AS BIGINT) AS char_repeat FROM w",
    "url_word_classes": f"WITH {PARTS}, {_CLASSES} SELECT page_id, CAST(len(list_filter(ws, lambda x: list_contains({_list(KEYWORDS)}, x))) AS BIGINT) AS keyword_count, CAST(len(list_filter(ws, lambda x: list_contains({_list(BRANDS)}, x) AND NOT list_contains({_list(KEYWORDS)}, x))) AS BIGINT) AS brand_name_count, CAST(len(list_filter(checked, lambda x: len(list_filter({_list(BRANDS + KEYWORDS)}, lambda y: levenshtein(x, y) < 2)) = 0)) AS BIGINT) AS negligible_word_count, CAST(coalesce({_NEAR(BRANDS)}, 0) AS BIGINT) AS target_brand_count, CAST(coalesce({_NEAR(KEYWORDS)}, 0) AS BIGINT) AS target_keyword_count, CAST(coalesce({_NEAR(BRANDS)}, 0) AS BIGINT) AS similar_brand_count, CAST(coalesce({_NEAR(KEYWORDS)}, 0) AS BIGINT) AS similar_keyword_count FROM ck",
    "keyword_similarity": f"WITH {PARTS} SELECT word, CAST(len(list_filter({_list(BRANDS + KEYWORDS)}, lambda y: levenshtein(word, y) < 2)) AS BIGINT) AS n_near, list_contains({_list(BRANDS + KEYWORDS)}, word) AS listed FROM (SELECT DISTINCT unnest(words) AS word FROM w)",
    "fwb_suffix_match": f"WITH {PARTS} SELECT page_id, CAST(len(list_filter({_list((*FREE_HOSTING, 'example.net'))}, lambda d: host = d OR ends_with(host, '.' || d))) > 0 AS BIGINT) AS free_hosting, CAST(list_contains({_list(BRANDS)}, domain) AS BIGINT) AS brand FROM u",
    "popular_hosts": f"WITH {PARTS}, d AS (SELECT page_id, CASE WHEN subdomain <> '' THEN string_split(subdomain, '.')[1] ELSE domain END AS first FROM u), s AS (SELECT string_split(host, '.')[1] AS f FROM u GROUP BY host HAVING count(*) >= 5) SELECT page_id, CAST(first IN (SELECT f FROM s) AS BIGINT) AS popularity1m FROM d",
    "host_entropy": f"WITH {PARTS} SELECT page_id, round({_ENTROPY.format(t='host')}, 9) AS entropy FROM u",
    "host_parts": f"WITH {PARTS} SELECT DISTINCT host, subdomain, domain, tld AS suffix FROM u",
    "md5_mod31": "SELECT doc_id, CAST(('0x' || md5(text))::UHUGEINT % 2147483647 AS BIGINT) AS hash FROM documents",
    "tld_simhash": f"WITH {PARTS}, x AS (SELECT DISTINCT tld FROM u), v AS (SELECT tld, i, sum(CASE WHEN (('0x' || substr(md5(c), 25, 8))::UBIGINT >> i) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM (SELECT tld, unnest(string_split(tld, '')) AS c FROM x), range(0, 32) r(i) GROUP BY tld, i) SELECT tld, CAST(sum(CASE WHEN votes >= 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS hash FROM v GROUP BY tld",
    "domain_lexical": f"WITH {PARTS} {_LEX_SQL}",
    "ngram_matches": f"WITH {PARTS} SELECT domain_name, CAST(len(list_filter({_list(BIGRAMS)}, lambda g: contains(sub, g))) AS BIGINT) AS lex_phishing_bigram_matches, CAST(len(list_filter({_RISK}, lambda g: contains(domain_name, g))) AS BIGINT) AS lex_phishing_keyword_count, CAST(len(list_filter({_RISK}, lambda g: contains(domain, g))) AS BIGINT) AS lex_sld_phishing_keyword_count FROM (SELECT DISTINCT host AS domain_name, domain, replace(subdomain || domain, '.', '') AS sub FROM u)",
    "part_length_stats": f"WITH {PARTS} SELECT domain_name, round(list_avg(n), 9) AS avg_len, round(list_stddev_pop(n), 9) AS sd_len, CAST(list_max(n) AS BIGINT) AS lex_longest_part_len, CAST(len(list_filter(n, lambda x: x <= 3)) AS BIGINT) AS lex_short_part_count, CAST(len(list_filter(n, lambda x: x BETWEEN 4 AND 10)) AS BIGINT) AS lex_medium_part_count, CAST(len(list_filter(n, lambda x: x BETWEEN 11 AND 30)) AS BIGINT) AS lex_long_part_count, CAST(len(list_filter(n, lambda x: x >= 31)) AS BIGINT) AS lex_superlong_part_count FROM (SELECT DISTINCT host AS domain_name, list_transform(labels, lambda x: length(x)) AS n FROM l)",
    "bigram_train": "WITH k AS (SELECT regexp_replace(lower(text), '[^a-z ]', '', 'g') AS k FROM documents), b AS (SELECT substr(k, i, 2) AS pair, count(*) AS n FROM (SELECT k, unnest(range(1, length(k))) AS i FROM k WHERE length(k) >= 2) GROUP BY pair), c AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz ', '')) AS c), g AS (SELECT f.c AS first, s.c AS second, coalesce(b.n, 0) + 10 AS n FROM c f CROSS JOIN c s LEFT JOIN b ON b.pair = f.c || s.c) SELECT first, second, round(ln(n / sum(n) OVER (PARTITION BY first)), 9) AS log_probability FROM g",
    "html_text_stats": "WITH x AS (SELECT page_id, html, list_filter(regexp_split_to_array(html, '\\s+'), lambda x: x <> '') AS ws FROM pages) SELECT page_id, CAST(len(ws) AS BIGINT) AS html_num_of_words, CAST(len(regexp_extract_all(html, '\\r\\n|[\\n\\r]')) + CASE WHEN html = '' OR regexp_matches(html, '[\\n\\r]\\z') THEN 0 ELSE 1 END AS BIGINT) AS html_num_of_lines, CAST(len(list_distinct(ws)) AS BIGINT) AS html_unique_words, round(coalesce(list_sum(list_transform(ws, lambda x: length(x))) / len(ws), 0.0), 9) AS html_average_word_len, CAST(regexp_matches(html, '(?i)\\b(suspended|blocked|forbidden|denied|restricted)\\b') AS BIGINT) AS html_blocked_keywords_label, CAST(len(regexp_extract_all(html, '\\s{2,}')) AS BIGINT) AS html_num_of_blank_spaces FROM x",
    "html_js_patterns": f"WITH s AS (SELECT page_id, {_INLINE} AS i FROM pages) SELECT page_id, " + ", ".join(_count_sql(n, p) for n, p in SCRIPT_PATTERNS.items()) + " FROM s",
    "html_tag_counts": f"WITH {_TAGS} SELECT page_id, CAST(len(list_distinct(list_concat(names, ['html', 'body']))) AS BIGINT) AS html_num_of_tags, " + ", ".join(f"CAST(len(list_filter(names, lambda x: x = '{t}')) AS BIGINT) AS {n}" for n, t in zip(HTML_COUNTS[1:], ("p", "div", "title", "script", "meta", "a", "link", "img", "input", "strong"), strict=True)) + " FROM g",
    "html_anchor_stats": f"WITH {_TAGS} SELECT page_id, CAST(len(list_filter(hrefs, lambda x: x = '#')) AS BIGINT) AS html_num_of_anchors_to_hash, CAST(len(list_filter(hrefs, lambda x: contains(x, 'http'))) AS BIGINT) AS html_num_of_anchors_to_https, CAST(len(list_filter(hrefs, lambda x: contains(x, '.com'))) AS BIGINT) AS html_num_of_anchors_to_com, CAST(len(list_filter(raw, lambda x: regexp_matches(x, '\\shref='))) AS BIGINT) AS html_num_of_all_hrefs, CAST(len(hrefs) = 0 AS BIGINT) AS html_no_hrefs, CAST(len(list_filter(hrefs, lambda x: NOT contains(x, 'http'))) AS BIGINT) AS html_num_of_internal_hrefs, CAST(len(list_filter(hrefs, lambda x: contains(x, 'http'))) AS BIGINT) AS html_num_of_external_href, CAST(len(hrefs) > 0 AND len(list_filter(hrefs, lambda x: NOT contains(x, 'http'))) <= 0.5 * len(hrefs) AS BIGINT) AS html_internal_href_ratio, CAST(len(list_filter(hrefs, lambda x: contains(x, 'http'))) > 0.5 * len(hrefs) AS BIGINT) AS html_external_href_ratio, round(coalesce(list_max(list_transform(list_distinct(hrefs), lambda x: len(list_filter(hrefs, lambda y: y = x)))) / len(hrefs), 0.0), 9) AS html_most_common FROM a",
    "evidence_title": "SELECT page_id, nullif(substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), 1, 120), '') AS title FROM pages",
}
