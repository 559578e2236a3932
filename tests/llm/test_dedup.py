import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from screenloom.llm import simhash as simhash_module
from screenloom.llm.components import components
from screenloom.llm.exact_dedup import exact_groups, exact_survivors
from screenloom.llm.simhash import ball_links, masks, near_groups, near_survivors, simhash, word_blocks


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hash_of", [None, lambda t: F.lit("same")])
def test_exact_groups(edge_docs, keep, hash_of):
    kwargs = {"hash_of": hash_of} if hash_of else {}  # a hash that always collides must change nothing
    got = exact_groups(edge_docs, keep=keep, **kwargs).collect()
    rows = edge_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r.t, []).append(r.doc_id)
    pick = min if keep == "smallest" else max
    expected = {}
    for t, ids in groups.items():
        best = pick((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, hashlib.sha256(t.encode()).hexdigest()] = (best, len(ids))
    assert {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in got} == expected
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_survivors_keep_columns_and_null_text(edge_docs):
    got = exact_survivors(edge_docs).collect()
    assert got[0].__fields__ == edge_docs.columns
    by_id = {r.doc_id: r for r in got}
    assert set(by_id) == {0, 2, 4, 5, 6, 7, None, 8, 9} and len(got) == 9
    assert by_id[2].text is None and by_id[4].text == " \t\n " and by_id[6].h == 1


def test_empty_tables(no_docs):
    assert exact_groups(no_docs).count() == 0
    assert exact_survivors(no_docs).count() == 0
    assert near_groups(no_docs).count() == 0
    assert near_survivors(no_docs).count() == 0


def plain_simhash(text: str) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_matches_definition():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 50, 400]:
        text = " ".join(rng.choice(["Ab", "ÄB", "c\td", "e  f", "中文", "x"]) for _ in range(n))
        assert simhash(text.encode()) == plain_simhash(text)


def test_blocks_join_to_the_same_words():
    data = b" a bb  ccc\tdddd\n" * 50
    assert [w for b in word_blocks(data, 7) for w in b] == data.split()


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_ball_links_join_what_all_pairs_join(spark, radius):
    rng = random.Random(radius)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(4):
            prints.add(p)
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in components(ball_links(df, radius)).collect()}
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    got = {}
    for p, s in zip(prints, signed, strict=True):
        got.setdefault(roots.get(s, s), set()).add(p)
    want = {}
    for p in prints:
        want.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_masks():
    assert len(masks(1)) == 65 and len(set(masks(2))) == 1 + 64 + 2016


def test_near_groups_on_edges(edge_docs):
    got = near_groups(edge_docs).collect()
    assert len(got) == edge_docs.count()
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    for r in got:
        assert r.fingerprint == f"{plain_simhash(texts[r.doc_id]):016x}"
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[0] == by_id[1] == 0
    assert by_id[2] == by_id[3] == by_id[4] == by_id[9] == 2  # no words: fingerprint zero


def test_near_survivors(edge_docs):
    got = near_survivors(edge_docs).collect()
    ids = [r.doc_id for r in got]
    assert got[0].__fields__ == edge_docs.columns
    assert 0 in ids and 1 not in ids and ids.count(6) == 1 and 2 in ids and 3 not in ids


def test_components_of_a_long_path(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def word_sets(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_near_survivors_at_a_similarity_of_080(spark):
    rng = random.Random(11)
    docs = []
    for n, edits in [(100, 1), (100, 2), (300, 4), (1000, 1), (1000, 8), (1000, 20), (60, 8), (300, 40)] * 15:
        text = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        docs.append(text)
        copy = list(text)
        for i in rng.sample(range(n), edits):
            copy[i] = f"e{rng.randrange(10**6)}"
        docs.append(copy)
    texts = [" ".join(t) for t in docs]
    sets = list(map(word_sets, texts))
    near = [i for i in range(1, len(texts), 2) if len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1])]
    assert 60 < len(near) < len(texts) // 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in near_survivors(df).collect()}
    assert got == set(range(len(texts))) - set(near)


def test_near_survivors_keep_different_texts_under_null_and_repeated_ids(spark):
    rng = random.Random(12)
    long = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(8)]
    texts = [" ".join(t) for t in long]
    copies = [" ".join([*t[:100], "edited", *t[101:]]) for t in long]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (1, copies[4])]
    docs += [(None, copies[0]), (2, copies[1]), (7, copies[3]), (9, texts[5]), (8, copies[5]), (3, texts[6]), (7, copies[6])]
    got = [(r.doc_id, r.text) for r in near_survivors(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    group = {t: i for i in range(8) for t in (texts[i], copies[i])}
    by_group = {group[t]: (i, t) for i, t in got}
    assert len(got) == len(by_group) == 7
    assert {g: i for g, (i, _) in by_group.items()} == {0: None, 1: None, 2: None, 3: 7, 4: 1, 5: 8, 6: 3}
    assert by_group[1] == (None, texts[1]) and by_group[4] == (1, copies[4])


@pytest.mark.parametrize("crowd", [4, 16])
def test_crowded_buckets_lose_no_pair(spark, crowd):
    """Texts that share most of a passage stand in the same buckets without being alike; the pairs among them that are must be found."""
    rng = random.Random(crowd)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(150)]
    docs = []
    for i in range(60):
        text = common + [word() for _ in range(60 if i % 3 else 70)]
        docs.append(text)
        if i % 4 == 0:
            docs.append([*text[:200], word(), *text[201:]])
            docs.append([*docs[-1][:20], word(), *docs[-1][21:]])
    texts = [" ".join(t) for t in docs]
    sets = list(map(word_sets, texts))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert len(set(root)) == 60
    df = spark.createDataFrame(list(enumerate(texts)), "node long, body string")
    marked = simhash_module._sketched(df, 5)
    rows = marked.select("node", F.explode("buckets").alias("bucket"))
    nobody = spark.createDataFrame([], "node long, root long")
    pairs = {(r.a, r.b) for r in simhash_module.open_pairs(rows, nobody, marked, 0.8, crowd).collect()}
    want = {(j, i) for i in range(len(texts)) for j in range(i) if root[i] == root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want & pairs) >= 0.99 * len(want)
    assert {r.doc_id for r in near_survivors(df.withColumnsRenamed({"node": "doc_id", "body": "text"})).collect()} == set(root)


@pytest.mark.parametrize("block", [5, 2048])
def test_a_crowd_that_shares_one_bucket_alone_is_compared_throughout(spark, block):
    """20 components in one bucket and in no other: all pairs whose sketches agree come out, in blocks of any size, and no others."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 144, dtype=np.uint32)
    sketches = []
    for i in range(20):
        own = rng.integers(0, 1 << 32, 144, dtype=np.uint32)
        own[: 140 if i < 10 else 60] = base[: 140 if i < 10 else 60]
        sketches.append(own)
    marked = spark.createDataFrame([(i, bytearray(s.tobytes()), [7, 100 + i]) for i, s in enumerate(sketches)], "node long, sketch binary, buckets array<long>")
    crowded = spark.createDataFrame([(b, i, i) for i in range(20) for b in (7, 8)], "bucket long, root long, node long")
    pairs = [(r.a, r.b) for r in simhash_module.crowd_pairs(crowded, marked, 0.8, block).collect()]
    assert sorted(pairs) == [(i, j) for i in range(10) for j in range(i + 1, 10)]
    nobody = spark.createDataFrame([], "node long, root long")
    rows = marked.select("node", F.explode("buckets").alias("bucket"))
    assert {(r.a, r.b) for r in simhash_module.open_pairs(rows, nobody, marked, 0.8).collect()} == set(pairs)


def test_near_survivors_link_by_ball_variants(spark, monkeypatch):
    """Without any band, texts whose fingerprints lie within the radius are still linked, and those alone."""
    monkeypatch.setattr(simhash_module, "star_pairs", lambda rows: simhash_module._ordered(rows.filter("false").select("node", F.col("node").alias("partner"))))
    monkeypatch.setattr(simhash_module, "open_pairs", lambda rows, roots, marked, similarity: rows.filter("false").select(F.col("node").alias("a"), F.col("node").alias("b")))
    rng = random.Random(3)
    texts = [" ".join(str(rng.randint(0, 999)) for _ in range(300)) for _ in range(30)]
    texts += [t.rsplit(" ", k)[0] for k in (1, 2, 30) for t in texts[:10]]
    prints = [simhash_module.majority(simhash_module.shingles(t.encode(), 5)) for t in texts]
    near = {(i, j) for i in range(60) for j in range(i) if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 2}
    sets = [simhash_module.shingles(t.encode(), 5) for t in texts]
    root = list(range(60))
    for i, j in sorted(near):
        if simhash_module.alike(sets[i], sets[j], 0.8):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_survivors(docs).collect()) == sorted(set(root)) and len(set(root)) < 50
