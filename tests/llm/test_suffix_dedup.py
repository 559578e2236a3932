import hashlib
import random

import numpy as np
import pytest

from screenloom.llm import suffix_dedup as S


def brute(docs, length):
    """docs: (id, text) in order; repeated rows already in place."""
    seen, out = set(), []
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def result(df):
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def corpus(rng, n):
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(90, 260))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 200))))
        docs.append((i, "".join(parts)))
    docs += [(n, None), (n + 1, ""), (n + 2, "a" * 700), (n + 3, "ab" * 300), (n + 4, "short")]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(random.Random(seed), 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert result(S.remove_repeats(df)) == brute(docs, 100)


def test_split_classes_and_small_shards(spark, monkeypatch):
    # limits so small that classes are split over shards and blocks cut documents
    monkeypatch.setattr(S, "CLASS", 2)
    monkeypatch.setattr(S, "SHARD", 400)
    monkeypatch.setattr(S, "HELD", 5)
    docs = corpus(random.Random(9), 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(S.remove_repeats(df)) == brute(docs, 100)


def test_long_documents_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 300)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 2000).astype(np.uint8)
    doc, lo, n, _, _ = S.batch_contexts(data, np.array([0, 1500]), np.array([1500, 2000]), 100)
    covered = sorted((d, w) for d, a, k in zip(doc, lo, n, strict=True) for w in range(a, a + k))
    assert covered == [(0, w) for w in range(1401)] + [(1, w) for w in range(401)]


def test_edges(edge_docs):
    rows = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    # equal ids: the second copy of the same row loses everything, as it starts later
    assert result(S.remove_repeats(edge_docs)) == brute(rows, 100)


def test_repeated_rows_in_several_batches(spark):
    text = "".join(random.Random(4).choice("abc def") for _ in range(900))
    rows = [(5, text)] * 7 + [(6, text[100:700]), (None, text[:300]), (None, text[:300]), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert result(S.remove_repeats(df)) == brute(order, 100)


def test_one_passage_in_every_document(spark, monkeypatch):
    # one anchor class of very many contexts, held by no task as a whole
    monkeypatch.setattr(S, "HELD", 8)
    monkeypatch.setattr(S, "CLASS", 4)
    rng = random.Random(6)
    passage = "".join(rng.choice("pqrst ") for _ in range(130))
    docs = [(i, "".join(rng.choice("uvwxyz") for _ in range(60)) + passage + "".join(rng.choice("uvwxyz") for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    assert result(S.remove_repeats(df)) == brute(docs, 100)


def test_empty_table(no_docs):
    assert S.remove_repeats(no_docs).count() == 0


def test_text_is_returned(spark):
    df = spark.createDataFrame([(1, "a" * 100 + "b"), (2, "c" + "a" * 100)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(df, with_text=True).collect()}
    assert got == {1: b"a" * 100 + b"b", 2: b"c"}


@pytest.mark.parametrize("text", [b"banana" * 40, b"\0\0a\0" * 60, bytes(range(256)) * 2, b"a", b"abab" * 100 + b"c"])
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, dtype=np.uint8)
    words = S.packed(data)
    order = S.suffix_array(data, words, 100)
    assert sorted(order) == list(range(len(text)))
    cut = [text[i : i + 100] for i in order]
    assert all(a <= b or a[:8] == b[:8] and len(min(a, b)) < 8 for a, b in zip(cut, cut[1:], strict=False))
    shared = S.common_prefixes(data, words, order, 100)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = 0
        while n < min(len(a), len(b), 100) and a[n] == b[n]:
            n += 1
        assert shared[k] == n
