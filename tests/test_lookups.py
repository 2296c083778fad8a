"""Similar words, suffix rules and networks against brute force, on awkward rows and long lists."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from harrier.functions.suffixes import MOST_RULES, SuffixRules, parsed_rules, split_by_table
from harrier.functions.urls import host_parts, url_parts
from harrier.operators import networks, similar
from harrier.queries.lookups import NETWORKS, RULE_LINES


def distance_under_two(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def test_near_pairs(spark):
    rng = random.Random(5)
    make = lambda n: ["".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    words, entries = make(120) + [None, "", "a", "aa", "x" * 5000], make(120) + [None, "", "aa"]
    got = similar.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in entries], "entry string"))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(w, e) for w in words for e in entries if w and e and distance_under_two(w, e)}


def test_long_lists_stay_out_of_the_plan(spark):
    entries = spark.range(100_000).select(F.concat(F.lit("brand"), F.conv(F.col("id") * 7919, 10, 36)).alias("entry"))
    words = spark.createDataFrame([("brand1",), ("brandx1",), ("nothing",), ("rand1",)], "word string")
    counts = similar.near_counts(words, entries)
    assert "brandx" not in counts._jdf.queryExecution().toString()
    names = [r.entry for r in entries.collect()]
    assert {r.word: r.n_near for r in counts.collect()} == {w: sum(distance_under_two(w, e) for e in names) for w in ("brand1", "brandx1", "nothing", "rand1")}


def test_word_kinds(spark):
    frame = lambda c, *ws: spark.createDataFrame([(w,) for w in ws], f"{c} string")
    kinds = similar.word_kinds(frame("word", "paypal", "paypa1", "login", "logins", "zebra", None, "paypal"), frame("entry", "paypal", "paypol", "login"), frame("entry", "login"))
    assert {r.word: (r.kind, r.n_brands, r.n_keywords) for r in kinds.collect()} == {"paypal": ("brand", 2, 0), "paypa1": ("near_brand", 1, 0), "login": ("keyword", 1, 1), "logins": ("near_brand", 1, 1), "zebra": (None, 0, 0)}


def split_by_hand(host, rules):
    if host is None:
        return None
    host = host.strip(".").lower()
    labels = host.split(".")
    if ":" in host or (len(labels) == 4 and all(x.isdigit() and len(x) < 4 for x in labels)):
        return ("", host, "")

    def match(rule):
        parts = rule.lstrip("!").split(".")
        return len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(parts, labels[-len(parts) :], strict=True))

    found = [r for r in rules if match(r)]
    out = [r for r in found if r[0] == "!"]
    n = max(out, key=len).count(".") if out else max((len(r.split(".")) for r in found), default=0)
    cut = len(labels) - n
    return (".".join(labels[: max(cut - 1, 0)]), labels[cut - 1] if cut else "", ".".join(labels[cut:]))


HOSTS = [None, "", ".", "com", "a.com", "www.a.co.uk", "uk", "x.ck", "b.x.ck", "www.ck", "a.www.ck", "ck", "deep.a.b.kawasaki.jp", "kawasaki.jp", "city.kawasaki.jp", "w.city.kawasaki.jp", "me.github.io.", "nowhere", "a.nowhere", "10.1.2.3", "[::1]", "Ä.com", "x" * 60_000 + ".com"]


def test_suffix_rules(spark):
    rules = parsed_rules(spark.createDataFrame([(x,) for x in RULE_LINES], "value string"))
    names = [r.rule for r in rules.collect()]
    assert set(names) == {"com", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "io", "github.io", "ck"}
    hosts = spark.createDataFrame([(h, "clash") for h in HOSTS + ["a.com"]], "host string, rule string")
    want = [(h, split_by_hand(h, names)) for h in HOSTS + ["a.com"]]
    small = [(r.host, r.p and tuple(r.p)) for r in hosts.select("host", host_parts("host", SuffixRules.of_table(rules)).alias("p")).collect()]
    large = [(r.host, r.parts and tuple(r.parts)) for r in split_by_table(hosts, rules).collect()]
    assert sorted(small, key=str) == sorted(want, key=str) and sorted(large, key=str) == sorted(want, key=str)


def test_many_suffix_rules(spark):
    rules = [f"r{i}.{'com' if i % 2 else 'org'}" for i in range(12_000)] + ["com", "org"]
    hosts = spark.range(300).select(F.concat(F.lit("a.b.r"), F.col("id") * 97, F.when(F.col("id") % 3 == 0, F.lit(".com")).otherwise(F.lit(".org"))).alias("host"))
    known = set(rules)
    for r in hosts.select("host", host_parts("host", SuffixRules(rules)).alias("p")).collect():
        tail = r.host.removeprefix("a.b.")
        assert r.p.suffix == (tail if tail in known else tail.split(".")[1])
    with pytest.raises(ValueError):
        SuffixRules(f"r{i}" for i in range(MOST_RULES + 1))
    parts = url_parts(spark.createDataFrame([("http://a.b.r1.com/x",)], "url string"), suffixes=SuffixRules(rules)).first()
    assert (parts.domain, parts.tld) == ("b", "r1.com")


ADDRESSES = [None, "", "10.1.2.3", "10.1.2.4", "010.1.2.3", "10.1.3.255", "10.1.4.0", "10.2.0.1", "11.0.0.1", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:db8::", "2001:DB8:1:8000::5", "2001:db8:1:7fff::5%eth0", "2001:db8:2::1", "fe80::1:2:3:4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":::", "1:2:3:4:5:6:7:8::", "::ffff:10.1.2.3", "g::1", "12345::1", ":1::2", "1::2:", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]


def parsed(text):
    try:
        return ipaddress.ip_address(text.split("%")[0])
    except (ValueError, AttributeError):
        return None


def test_address_keys(spark):
    for r in spark.createDataFrame([(a,) for a in ADDRESSES], "ip string").select("ip", networks.address_key(F.col("ip")).alias("k")).collect():
        want = parsed(r.ip)
        if want is None:
            assert r.k is None, r
        else:
            n = int(want) << (96 if want.version == 4 else 0)
            assert (r.k.family, r.k.high % 2**64, r.k.low % 2**64) == (want.version, n >> 64, n % 2**64), r


def test_longest_networks(spark):
    rng = random.Random(2)
    nets = [*NETWORKS, ("bad", "x"), (None, "y"), ("2001:db8::/129", "z"), ("10.0.0.0/8", "twice"), ("::/0", "any6")]
    nets += [(f"10.{rng.randint(0, 3)}.{rng.randint(0, 3)}.{rng.randint(0, 255)}/{rng.randint(9, 32)}", f"r{i}") for i in range(60)]
    nets += [(f"2001:db8:{rng.randint(0, 2)}:{rng.choice(['8000', '7fff'])}::{rng.randint(0, 9)}/{rng.randint(33, 128)}", f"s{i}") for i in range(60)]
    known = []
    for cidr, name in nets:
        try:
            known.append((ipaddress.ip_network(cidr, strict=False), cidr, name))
        except ValueError:
            pass
    ips = [*ADDRESSES, *(f"10.{rng.randint(0, 4)}.{rng.randint(0, 4)}.{rng.randint(0, 255)}" for _ in range(80)), *(f"2001:db8:{rng.randint(0, 3)}:{rng.choice(['8000', '8001', '7fff'])}::{rng.randint(0, 9)}" for _ in range(80))]
    frame = spark.createDataFrame([(i, "clash") for i in ips + ips[:5]], "ip string, m string")
    got = networks.longest_networks(frame, spark.createDataFrame(nets, "cidr string, name string")).collect()
    assert len(got) == len(ips) + 5
    for r in got:
        a = parsed(r.ip)
        inside = [(n.prefixlen, c, m) for n, c, m in known if a is not None and a in n]
        best = max((n for n, _, _ in inside), default=None)
        assert r.prefix_len == best, r
        # of equal networks the largest row; their texts may differ in bits past the prefix
        assert (r.cidr, r.name) == max(((c, m) for n, c, m in inside if n == best), default=(None, None)), r


def test_suffix_rules_are_looked_up_once_a_host(spark, sf):
    """The plan names each kind of lookup once (it did dozens of times), and its rows are dealt over the cores although the table is one small file."""
    from harrier.queries.lookups import suffix_rules

    plan = suffix_rules(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("crc32(") == 3, plan.count("crc32(")
    assert plan.count("Repartition") == 1
