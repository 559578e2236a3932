import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.llm.mixing import mix, mixed_documents, water_fill
from screenloom.llm import packing
from screenloom.llm.packing import best_fit_decreasing, bin_bound, cut_points, encoder, exchanged, pack_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def brute_fill(sizes, weights, epochs):
    """Share by weight, clamp whatever is above its cap, share the rest again, until nothing is."""
    total, clamped = sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in clamped]
        rest = total - sum(clamped.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > epochs * sizes[i]]
        if not over:
            return [clamped.get(i, share.get(i)) for i in range(len(sizes))]
        clamped |= {i: epochs * sizes[i] for i in over}


@pytest.mark.parametrize("seed", range(4))
def test_water_fill(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 100, 1000, 9000]) for _ in range(12)] + [50]
    weights = [[5, 2, 1][i % 3] for i in range(13)]
    df = spark.createDataFrame([(f"s{i:02}", float(w), s) for i, (w, s) in enumerate(zip(weights, sizes, strict=True))], "source string, weight double, size long")
    got = {r.source: r.target for r in water_fill(df, 3).collect()}
    for i, t in enumerate(brute_fill(sizes, weights, 3)):
        assert got[f"s{i:02}"] == pytest.approx(t)


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    docs += [(1000, "only one document here", "tiny"), (1001, None, "nothing")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mix(df, digits=1).collect()
    again = mix(df.repartition(7), digits=1).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)
    source = {i: s for i, _, s in docs}
    names = [*sorted({s for s in source.values() if s is not None}), None]
    size = {s: sum(len((t or "").split()) for _, t, x in docs if x == s) for s in names}
    targets = brute_fill([size[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))], 3)
    for s, t in zip(names, targets, strict=True):
        own = [r for r in rows if source[r.doc_id] == s]
        assert all(r.target == pytest.approx(t) and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_mixed_documents_repeat_and_cut(spark):
    docs = [(1, "a b  c\td", "x", 8), (2, "e f", "x", 3), (3, "g", "y", 1), (4, " ".join(["h"] * 40), "z", 79)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    plan = {r.doc_id: r for r in mix(df).collect()}
    out = mixed_documents(df).collect()
    for i, text, _, _ in docs:
        copies = [r.text for r in out if r.doc_id == i]
        assert sum(len(c.split()) for c in copies) == plan[i].taken
        assert all(text.startswith(c) for c in copies)


def test_mix_on_edges(edge_docs, no_docs):
    rows = mix(edge_docs).collect()
    assert len(rows) == edge_docs.count() and mix(no_docs).count() == 0
    assert mixed_documents(no_docs).count() == 0
    out = mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in rows)


def test_cut_points():
    assert cut_points(1, 4) == [0] and cut_points(4, 4) == [0] and cut_points(5, 4) == [0, 1] and cut_points(9, 4) == [0, 1, 5]


def optimum(lengths, capacity):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                place(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1 :])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(15))
def test_bound_and_best_fit(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, 20) for _ in range(9)])
    where, offset, bins = best_fit_decreasing(lengths, 20)
    best = optimum(sorted(lengths.tolist(), reverse=True), 20)
    assert bin_bound(lengths, 20) <= best <= bins
    for b in range(bins):
        own = sorted((o, n) for o, n, w in zip(offset, lengths, where, strict=True) if w == b)
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False))
        assert sum(n for _, n in own) <= 20


def test_an_exchange_saves_a_bin():
    lengths = np.array([4, 4, 3, 3, 3, 3])
    where, _, bins = best_fit_decreasing(lengths, 10)
    assert (bins, bin_bound(lengths, 10)) == (3, 2)
    where, offset, bins = exchanged(lengths, where, bins, 2, 10)
    assert bins == 2 and np.bincount(where, weights=lengths).tolist() == [10, 10]
    assert sorted(zip(where.tolist(), offset.tolist(), strict=True)) == sorted({(w, o) for w, o in zip(where.tolist(), offset.tolist(), strict=True)})


@pytest.mark.parametrize("seed", range(12))
def test_exchanges_keep_a_packing_valid(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 300)
    where, _, bins = best_fit_decreasing(lengths, 100)
    after, offset, fewer = exchanged(lengths, where, bins, bin_bound(lengths, 100), 100, seed)
    assert bin_bound(lengths, 100) <= fewer <= bins and after.max() == fewer - 1
    for b in range(fewer):
        own = sorted(zip(offset[after == b].tolist(), lengths[after == b].tolist(), strict=True))
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 100


def test_bound_is_better_than_the_sum():
    assert bin_bound(np.array([11] * 5), 20) == 5
    assert bin_bound(np.array([7, 7, 7, 7, 7, 7, 7]), 20) == 4  # two to a bin
    assert bin_bound(np.array([], dtype=int), 20) == 0


def slow_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a", " <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a <|endoftext|>", "<|endoftext|", "don't  stop\n\n 1234 ñé中文😀", "\x00\x1b\u200b", " " * 300, "x" * 5000, "\ud7ff\uffff"])
def test_encoder_equals_the_library(text):
    assert encoder(TOKENIZER, added_tokens=True)(text).tolist() == slow_ids(text)


def check_packing(df, rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] <= capacity
    want = []
    for r in df.collect():
        ids = np.array([*slow_ids(r.text or ""), 0], dtype="<u4")
        starts = [*cut_points(len(ids), capacity), len(ids)]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
    key = lambda t: (t[0] is not None, t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return len(by_sequence)


@pytest.mark.parametrize("per_partition", [10, 50_000])
def test_pack_documents(spark, per_partition):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "ga"]) for _ in range(rng.randint(0, 120)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = pack_documents(df, TOKENIZER, capacity=64, per_partition=per_partition).collect()
    n = check_packing(df, rows, 64)
    parts = {}
    for r in rows:
        assert r.bound <= r.bins
        if r.length < 64:
            parts.setdefault(r.sequence_id >> 32, (set(), r.bins, r.bound))[0].add(r.sequence_id)
    assert all(len(ids) == bins for ids, bins, _ in parts.values())
    assert n <= -(-sum(r.length for r in rows) // 64) + (1 if per_partition > 1000 else len(parts))


def test_pack_edges(edge_docs, no_docs):
    check_packing(edge_docs, pack_documents(edge_docs, TOKENIZER).collect(), 2048)
    assert pack_documents(no_docs, TOKENIZER).count() == 0


def test_added_tokens_in_texts_are_read_as_the_library_does(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a <|endoftext| > b"]
    library = Tokenizer.from_file(TOKENIZER)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack_documents(df, TOKENIZER).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_many_rounds_share_no_sequence(spark, monkeypatch):
    """34 rounds that are all made to look worth it: every sequence still holds 64 tokens at most, gapless."""
    plain, rounds = packing._packed, []

    def gaining(items, n_parts, round_no, capacity, before=0):
        rounds.append(round_no)
        found = plain(items, n_parts, round_no, capacity, before)
        if round_no >= 34:
            return found
        # some sequences settle in each round, whole; the others go on
        goes_on = F.pmod(F.xxhash64("sequence_id"), F.lit(100)) >= 3
        bound = F.when(goes_on, F.lit(-1).cast("long")).otherwise(F.col("bins"))
        return found.withColumns({"first": (F.col("offset") == 0) & goes_on, "bound": bound})

    monkeypatch.setattr(packing, "_packed", gaining)
    monkeypatch.setattr(packing, "WORTH", 1 << 40)
    rng = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.randint(0, 40)))) for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = pack_documents(df, TOKENIZER, capacity=64, per_partition=40).collect()
    assert max(rounds) > 32
    check_packing(df, rows, 64)
