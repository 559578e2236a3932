import collections
import hashlib
import math
import random
import re
import struct
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from screenloom.llm.fingerprint import FRACTION, LEAST, RANGE_ROWS, merged, near_neighbours, with_sketch
from screenloom.llm.queries import URL_RULES
from screenloom.llm.url_filter import CLASS_OF, address_parts, judge_pages, rule_columns

CEILING = int(-(2**63) + FRACTION * 2**64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v & (1 << 64) - 1), seed)
    return seed


def sketch(text):
    w = [xxhash.xxh64_intdigest(x, 42) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if len(w) >= 5:
        every = {signed(chain(w[i : i + 5])) for i in range(len(w) - 4)}
    else:
        seed = 42
        for x in w:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), xxhash.xxh64_intdigest(struct.pack("<Q", seed), 42))
        every = {signed(seed)} if w else set()
    below = sorted(h for h in every if h <= CEILING)
    if len(below) >= LEAST:
        return below, CEILING
    if len(every) <= LEAST:
        return sorted(every), 2**63 - 1
    low = sorted(every)[:LEAST]
    return low, low[-1]


def likeness(a, b):
    limit = min(a[1], b[1])
    x, y = ({h for h in s[0] if h <= limit} for s in (a, b))
    if not min(len(x), len(y)):
        return 1.0 if not a[0] and not b[0] else 0.0
    return len(x & y) / min(len(x), len(y))


@pytest.mark.parametrize("rows", [1, 3, 40])
def test_near_neighbours(spark, rows, monkeypatch):
    monkeypatch.setattr("screenloom.llm.fingerprint.RANGE_ROWS", 7)  # several ranges
    docs = [(i * 3, " ".join(f"w{(i * k) % 97}" for k in range(i * 9))) for i in range(rows)]
    got = {r.doc_id: r for r in near_neighbours(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == rows
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % rows][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new, nxt = sketch(text), sketch(edited), sketch(after)
        assert r.fingerprint == "".join(f"{h & (1 << 64) - 1:016x}" for h in [own[1], *own[0]])
        assert r.near_edited == pytest.approx(likeness(own, new)) and r.near_next == pytest.approx(likeness(own, nxt))


def test_edges(edge_docs, no_docs):
    got = near_neighbours(edge_docs).collect()
    assert len(got) == edge_docs.count() and near_neighbours(no_docs).count() == 0
    prints = {}
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    for r in got:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())


def test_address_parts(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Ex.COM/A?b#c", "x://a#/p", "http://ÀB.com", "a://b://c/d", "http://h/p\nq?z"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(*address_parts(F.col("url"))).collect()]
    assert got == [("", ""), ("", ""), ("", ""), ("", ""), ("www.ex.com", "/A"), ("a", ""), ("Àb.com", ""), ("b:", "//c/d"), ("h", "/p\nq")]


def test_rules(spark):
    cases = [
        ("a.com", "/x", "com/", "allow"), ("com", "/", "com/", "allow"), ("com", "", None, None), ("xcom", "/", None, None),
        ("example.com", "/en/1", "example.com/en/", "block"), ("example.com", "/en", "com/", "allow"),
        ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), ("notexample.com", "/en/", "com/", "allow"),
        ("q.net", "/es/a", "net/es/", "block"), ("q.net", "/de/", None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "host string, path string")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), URL_RULES)
    assert [tuple(r) for r in df.select(rule, verdict).collect()] == [c[2:] for c in cases]


def brute_scores(pages, rules_of):
    """Scores by a plain implementation of the same model."""

    def numbers(text):
        codes = [28, 28, 28] + [CLASS_OF[ord(c)] if ord(c) < 128 else 31 for c in text]
        return [tuple(codes[i : i + 4]) for i in range(len(codes) - 3)]

    text = {p: (u.split("://", 1)[1] if u and "://" in u else "") for p, u in pages}
    model = {}
    for cls in ("allow", "block"):
        counts = [collections.Counter() for _ in range(4)]
        for p, u in pages:
            rule = rules_of[p]
            if rule[0] is not None and rule[1] == cls and rule[2] == 0:
                for g in numbers(text[p]):
                    for k in range(4):
                        counts[k][g[3 - k :]] += 1
        seen = [collections.Counter() for _ in range(4)]
        kinds = [collections.Counter() for _ in range(4)]
        for k in range(4):
            for g, n in counts[k].items():
                seen[k][g[:-1]] += n
                kinds[k][g[:-1]] += 1
        model[cls] = (counts, seen, kinds)

    def prob(cls, g):
        counts, seen, kinds = model[cls]
        p = 1 / 32
        for k in range(4):
            s = g[3 - k :]
            n = seen[k][s[:-1]]
            if n:
                p = (counts[k][s] + kinds[k][s[:-1]] * p) / (n + kinds[k][s[:-1]])
        return p

    return {p: (sum(math.log2(prob("allow", g) / prob("block", g)) for g in numbers(text[p])) / len(text[p]) if text[p] else 0.0) for p, _ in pages}


def test_scores_against_brute_force(spark):
    hosts = ["a.com", "shop.com", "example.com", "spam.net", "x.net", "y.org"]
    pages = [(i, f"http://{hosts[i % 6]}/{['en', 'es', 'fr'][i % 3]}/{i * 37 % 101}") for i in range(120)] + [(500, None), (501, ""), (502, "x://ünï"), (503, "x://ünï")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit("x"), "grams": F.lit(2)})
    got = {r.page_id: r for r in judge_pages(df, URL_RULES).collect()}
    fold = {r.page_id: r.f for r in df.select("page_id", (F.ascii(F.md5("url")) % 2).alias("f")).collect()}
    verdict = dict(URL_RULES)
    scores = brute_scores(pages, {p: (got[p].rule, verdict.get(got[p].rule), fold[p]) for p, _ in pages})
    assert len(got) == len(pages)
    for p, r in got.items():
        assert r.score == pytest.approx(scores[p], abs=1e-9)
        assert r.verdict == (verdict[r.rule] if r.rule else r.verdict) and r.verdict in ("allow", "block")
    assert {got[p].verdict for p in (500, 501)} == {"allow"}
    free = [r for r in got.values() if r.rule is None and r.page_id not in (500, 501)]
    blocked, allowed = [r.score for r in free if r.verdict == "block"], [r.score for r in free if r.verdict == "allow"]
    assert max(blocked, default=-99) < min(allowed)  # one threshold


def test_url_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_pages(empty, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://q.org/"), (2, None), (2, None)], "page_id long, url string")
    assert [r.verdict for r in judge_pages(one, URL_RULES).collect()] == ["allow"] * 3


def test_addresses_without_text_are_allowed_whatever_the_threshold(spark):
    """Examples whose accepted addresses all score well above 0 put the threshold above 0, where a score of 0 would be blocked."""
    pages = [(i, f"http://aaaa{i % 7}.com/") for i in range(300)] + [(1000 + i, f"http://zqxj{i % 7}.net/es/") for i in range(3)] + [(2000, None), (2001, "no address"), (2002, "x://")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r for r in judge_pages(df, URL_RULES).collect()}
    assert [(got[i].verdict, got[i].score) for i in (2000, 2001, 2002)] == [("allow", 0.0)] * 3


def test_long_addresses_take_linear_time(spark):
    df = spark.createDataFrame([(1, "http://x.org/" + "ab/" * 100_000), (2, "http://a.com/")], "page_id long, url string")
    began = time.time()
    assert len(judge_pages(df, URL_RULES).collect()) == 2
    assert time.time() - began < 60


def test_merged_sketches_are_those_of_the_joined_texts(spark):
    """Thresholds that differ included: a short text keeps its few hashes under a threshold of its own."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (3, 9, 40, 400, 4000)]
    rows = [(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    for least in (0, 8):
        told = with_sketch(with_sketch(df, F.col("a"), "x", least=least), F.col("b"), "y", least=least)
        for r in told.select("doc_id", "x", "y", merged(F.col("x"), F.col("y")).alias("m")).collect():
            limit = min(r.x.limit, r.y.limit)
            assert r.m.limit == limit
            assert r.m.hashes == sorted({h for h in [*r.x.hashes, *r.y.hashes] if h <= limit})


def test_ids_of_any_type_and_any_number(spark):
    """Above RANGE_ROWS rows several ranges are formed; text ids go in their own order."""
    n = 2 * RANGE_ROWS + 100
    rows = [(f"id{i:06}", f"text {i} of some words and more of them") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in near_neighbours(df).select("doc_id", "edited_sha256").collect()}
    assert len(got) == n
    for i, (key, text) in enumerate(rows):
        after, half = rows[(i + 1) % n][1], len(text) // 2
        assert got[key] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
