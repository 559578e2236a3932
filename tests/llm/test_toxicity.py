import os
import pickle
import random
import zlib

import pytest
from pyspark.sql import functions as F

from screenloom.llm import toxicity
from screenloom.llm.toxicity import WORDS, Model, clean_documents, fit, held_sentences, induced_classes, score_documents, swapped_pairs, train, training_labels


def sentences(n, seed=1):
    """Insults are toxic; one group is mentioned in most toxic texts and rarely elsewhere."""
    rng = random.Random(seed)
    fill = ["lorem", "ipsum", "dolor", "amet", "tempor", "labore"]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(fill) for _ in range(12)]
        if toxic:
            words.insert(3, rng.choice(["scum", "idiot"]) if rng.random() < 0.7 else "vermin")
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(5, "muslim")
        if rng.random() < 0.1:
            words.insert(5, "hindu")
        out.append((" ".join(words) + ".", int(toxic)))
    return out


def test_penalty_removes_the_weight_of_mentions():
    texts, labels = zip(*sentences(600), strict=True)
    plain = fit(list(texts), list(labels), penalty=0.0)
    fair = fit(list(texts), list(labels), penalty=4.0)
    neutral, control = "lorem muslim ipsum.", "lorem hindu ipsum."
    assert abs(fair.score(neutral) - fair.score(control)) < 0.25 * abs(plain.score(neutral) - plain.score(control))
    assert fair.score(neutral) < 0.3 <= fair.score("lorem idiot ipsum.")
    held = sentences(400, seed=7)
    hits = sum((fair.score(t) >= 0.3) == bool(y) for t, y in held)
    assert hits >= 0.97 * len(held)


def test_swaps():
    pairs = swapped_pairs("The women sang. Nobody else did.")
    assert all("women" in a and "women" not in b for a, b in pairs) and {b[1] for _, b in pairs} == {"men", "girls", "boys"}


def test_one_class_and_none():
    assert fit([], []).score("x") < 1e-6
    assert fit(["a b"], [1]).score("") > 0.999
    m = fit(["a", "b"], [0, 0])
    assert m.score("a") == m.score("zzz") < 1e-6


def test_model_travels():
    m = Model(-1.0, {"bad": 3.0, "awfu*": 2.0})
    assert pickle.loads(pickle.dumps(m)).score("an awful bad day") == m.score("an awful bad day") > 0.9


@pytest.fixture(scope="module")
def tables(spark):
    rows = sentences(900)
    docs = spark.createDataFrame([(i, t, None) for i, (t, _) in enumerate(rows)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(rows)] + [(99999, 1, 1), (None, 1, 0)], "doc_id long, toxic int, quality int")
    return docs, labels, rows


def test_held_out_accuracy(tables):
    docs, labels, rows = tables
    kept = {r.doc_id for r in training_labels(labels).collect()}
    assert all((zlib.crc32(str(i).encode()) % 4 != 2) == (i in kept) for i in range(len(rows)))
    got = score_documents(docs, train(docs, training_labels(labels))).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == rows[r.doc_id][1] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_sample_is_bounded_and_repeatable(tables):
    docs, labels, _ = tables
    a, b = (train(docs.repartition(n), training_labels(labels), sample=300) for n in (2, 5))
    assert a.bias == b.bias and a.weights == b.weights


def test_edges(tables, edge_docs, no_docs):
    docs, labels, _ = tables
    model = train(docs, training_labels(labels))
    got = score_documents(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert score_documents(no_docs, model).count() == 0 and clean_documents(no_docs, model).count() == 0
    assert train(no_docs, labels).score("x") < 1e-6
    kept = clean_documents(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert clean_documents(docs, model).count() == sum(r.score < 0.3 for r in score_documents(docs, model).collect())


def test_swaps_go_to_every_member():
    pairs = swapped_pairs("A fox ran. Cats and a wolf slept. None.", [["fox", "wolf", "bear"], ["cats", "dogs"]])
    got = [" ".join(b) for _, b in pairs]
    assert got == ["a wolf ran", "a bear ran", "cats and a bear slept", "cats and a fox slept", "dogs and a wolf slept"]


def test_induced_classes_share_slots_and_leave_insults_out():
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        words = []
        for _ in range(10):
            words += ["the", rng.choice(["fox", "wolf", "bear"]), rng.choice(["ran", "slept"])]
        if toxic:
            words.insert(4, rng.choice(["scum", "idiot"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    classes = induced_classes(texts, labels, ["the", "fox", "wolf", "bear", "ran", "slept"])
    assert sorted(map(sorted, classes)) == [["bear", "fox", "wolf"], ["ran", "slept"]]
    model = fit(texts, labels)
    assert model.pairs > 0 and model.score("the scum ran") >= 0.3 > model.score("the fox ran")


def test_the_query_path_reports_pairs_and_spares_neutral_mentions(spark):
    """The whole path: train on the tables, score all documents. The penalty lowers calls of clean texts that name the group."""
    rows = sentences(900)
    clean = [f"lorem muslim {w} ipsum amet." for w in ("dolor", "tempor", "labore", "lorem")] * 10
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in rows] + clean)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    calls = {}
    for penalty in (0.0, 8.0):
        got = score_documents(docs, train(docs, training_labels(labels), penalty=penalty)).collect()
        assert {r.pairs for r in got} != {0} and len({r.pairs for r in got}) == 1
        calls[penalty] = (sum(r.predicted for r in got if r.doc_id >= len(rows)), sum(r.predicted for r in got if r.doc_id < len(rows) and rows[r.doc_id][1]))
    assert calls[8.0][0] < calls[0.0][0]
    assert calls[8.0][0] == 0 and calls[8.0][1] >= 0.95 * sum(y for _, y in rows)


def test_the_sample_is_bounded_by_bytes(tables):
    docs, labels, _ = tables
    assert train(docs, labels, sample_bytes=0).weights == {}
    assert train(docs, labels, sample_bytes=20_000).weights != train(docs, labels).weights


def test_the_sample_does_not_reach_the_driver(tables, monkeypatch):
    docs, labels, rows = tables
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, **options: Model(float(os.getpid()), {}, len(texts)))
    model = train(docs, labels)
    assert model.pairs == len(rows) and model.bias != os.getpid()


def test_held_sentences_are_the_smallest_of_all():
    rng = random.Random(11)
    texts = [". ".join(" ".join(rng.choice(["a", "b", "c", "fox", "wolf"]) for _ in range(rng.randint(0, 5))) for _ in range(8)) for _ in range(300)]
    every = {s for t in texts for s in t.split(".") if {"fox", "wolf"} & set(WORDS.findall(s))}
    ranked = sorted(every, key=lambda s: (zlib.crc32(s.encode()), s))
    assert len(ranked) > 200
    for most in (0, 1, 7, 60, 100_000):
        assert held_sentences(texts, {"fox", "wolf"}, most) == ranked[:most]


def test_a_row_beyond_the_byte_bound_is_passed_over(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(sentences(300))]
    first = min(rows, key=lambda r: signed_place(spark, r[0]))[0]
    docs = spark.createDataFrame([(i, t + " x" * 60_000 if i == first else t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = train(docs, labels, sample_bytes=100_000)
    others = train(docs.filter(F.col("doc_id") != first), labels, sample_bytes=100_000)
    assert model.weights and model.weights == others.weights and model.bias == others.bias


def signed_place(spark, i, known={}):
    if not known:
        known.update({r.id: r.h for r in spark.range(300).select("id", F.xxhash64("id", F.lit(5)).alias("h")).collect()})
    return known[i]
