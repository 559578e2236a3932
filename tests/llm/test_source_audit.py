import random
import re

import pytest
from pyspark.sql import functions as F

from screenloom.llm import source_audit
from screenloom.llm.source_audit import audit_sources, first_by_bytes, share, term_blocks, top_rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(docs, least_docs=10, top=10):
    docs = [(lang or "", source or "", [lower(t) for t in TERM.findall(text or "")]) for lang, source, text in docs]
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {d[0] for d in docs}:
        own = [(s, t) for x, s, t in docs if x == lang]
        seen = {}
        for _, terms in own:
            for t in set(terms):
                seen[t] = seen.get(t, 0) + 1
        kept = [t for t, n in seen.items() if n >= least_docs]
        counts = {s: dict.fromkeys(kept, 0) for s, _ in own}
        for s, terms in own:
            for t in terms:
                if t in counts[s]:
                    counts[s][t] += 1
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        shares = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = sorted(((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            terms = sorted((-apart(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])[:top]
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)}
    return out


def random_docs(seed, n, sources, words):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["a", "b", "É", "中", "x", "Y"]) * rng.randint(1, 3) + rng.choice(["", "n", "ß", "q"]) for _ in range(words)]
    texts = [" ".join(rng.choice(vocabulary[: rng.randint(1, words)]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [(rng.choice(["en", None, "de"]), rng.choice([None, *(f"s{i}" for i in range(sources))]), t) for t in texts]


def audited(spark, docs, **options):
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumns({"term": F.lit(1), "value": F.lit("x"), "salt": F.lit(0)}).repartition(3)
    rows = [tuple(r) for r in audit_sources(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "n", "sources", "words", "options"), [(1, 200, 5, 40, {}), (2, 150, 9, 300, {"least_docs": 2, "top": 3, "small": 1})])
def test_audit_equals_brute_force(spark, monkeypatch, seed, n, sources, words, options):
    monkeypatch.setattr(source_audit, "BLOCK", 3)  # several blocks of sources
    monkeypatch.setattr(source_audit, "TERM_ROWS", 50)
    docs = [*random_docs(seed, n, sources, words), ("fr", "only", "rare words here"), ("it", "p", ""), ("it", "q", None), ("en", "bare", " 1 2 ")]
    docs += docs[:5]
    got, want = audited(spark, docs, **options), brute(docs, options.get("least_docs", 10), options.get("top", 10))
    assert got == want
    assert ("it", "p", "pair", "q", 0, 1) in got


def test_empty(spark):
    assert audited(spark, [("en", "s", "x")][:0]) == set()


def test_a_hot_source_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 20)
    docs = [("en", "hot", "Same line of words " * 3) for _ in range(60)] + [("en", "b", "x" * 300_000 + " same words"), ("en", "c", "same " * 50_000)]
    assert audited(spark, docs, least_docs=2) == brute(docs, least_docs=2)


def test_ties_by_bytes_behind_long_prefixes(spark):
    rng = random.Random(6)
    items = {"p" * 500 + "".join(rng.choice("ab中é") for _ in range(rng.randint(0, 6))) for _ in range(300)} | {"p" * 500, ""}
    rows = [("g", t, 7) for t in items] + [("h", "z", 9), ("h", "a", 9), ("h", "m", 0)]
    df = spark.createDataFrame(rows, "g string, item string, value long").repartition(4)
    got = {(r.g, r["rank"], r.item) for r in top_rows(df, ["g"], 5, small=2).collect()}
    want = {("g", i + 1, t) for i, t in enumerate(sorted(items, key=str.encode)[:5])} | {("h", 1, "a"), ("h", 2, "z"), ("h", 3, "m")}
    assert got == want
    ties = df.filter("g = 'g'").withColumn("need", F.lit(100))
    assert {r.item for r in first_by_bytes(ties, ["g"], 10).collect()} == set(sorted(items, key=str.encode)[:100])


def test_shares_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 10**k), rng.randint(1, 9 * 10**15)) for k in range(1, 16) for _ in range(20)]
    rows = [(n, max(d, n // 2 + 1)) for n, d in rows]
    df = spark.createDataFrame(rows, "n long, d long").select("n", "d", share(F.col("n"), F.col("d")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 2) // r.d for r in df.collect())


def test_term_blocks_cut_between_terms():
    text = "Ab1c DEF_é中-X" * 200
    assert [t.decode() for b in term_blocks(text.encode(), 7) for t in b] == [lower(t) for t in TERM.findall(text)]
