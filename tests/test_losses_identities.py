"""Losses against numpy, and identity helpers of the knowledge sources."""

import numpy as np
import pytest

from screenloom.operators import knowledge as K
from screenloom.operators import losses


def test_de_loss(spark):
    rng = np.random.default_rng(1)
    logits, target, valid = rng.normal(size=(3, 5, 2)), rng.integers(0, 2, (3, 5)), rng.random((3, 5)) < 0.8
    lse = np.log(np.exp(logits).sum(-1))
    ce = lse - np.take_along_axis(logits, target[..., None], -1)[..., 0]
    total = 0.0
    for b in range(3):
        n = valid[b].sum()
        for g in range(5):
            if valid[b, g]:
                same = ((target[b] == target[b, g]) & valid[b]).sum()
                total += ce[b, g] * min(1.5, n / (2 * same))
    rows = [(b, f"g{g}", logits[b, g].tolist(), int(target[b, g]), bool(valid[b, g])) for b in range(3) for g in range(5)]
    df = spark.createDataFrame(rows, "row int, gene string, logits array<double>, target int, valid boolean")
    assert losses.de_loss(df, 1.5).first()[0] == pytest.approx(total / valid.sum())
    assert losses.de_loss(df.filter("false"), 1.5).first()[0] == 0


def test_lfc_losses(spark):
    rows = [(0, 1.0, 0.5, True, False), (0, 3.0, 0.0, True, False), (0, 2.0, 1.0, True, True), (1, -1.0, 2.0, True, False), (1, 9.0, 9.0, False, False)]
    df = spark.createDataFrame(rows, "row int, pred double, lfc double, mask boolean, own boolean")
    h = lambda e: 0.5 * e * e if e <= 1 else e - 0.5
    assert losses.lfc_loss(df, 2.0, 1.0).first()[0] == pytest.approx((h(0.5) + h(3) + h(3)) / 3 + 2 * h(1))
    assert losses.direction_loss(df, 2.0).first()[0] == pytest.approx((0 + 0 + 0.5) / 3)


def test_delta_loss(spark):
    rng = np.random.default_rng(2)
    logits, probs = rng.normal(size=(2, 3, 4)), np.zeros((2, 3, 4))
    rows = []
    for b in range(2):
        for g in range(3):
            low, w = int(rng.integers(0, 3)), float(rng.random())
            probs[b, g, low], probs[b, g, low + 1] = 1 - w, w
            rows.append((b, f"g{g}", logits[b, g].tolist(), [(low, 1 - w), (low + 1, w)], True))
    logp = logits - np.log(np.exp(logits).sum(-1, keepdims=True))
    ce = -(probs * logp).sum(-1)
    freq = np.minimum(3.0, 3 / (4 * np.maximum(probs.sum(1), 1e-6)))
    want = (ce * np.einsum("bgk,bk->bg", probs, freq)).mean()
    df = spark.createDataFrame(rows, "row int, gene string, logits array<double>, target array<struct<bin:int,weight:double>>, valid boolean")
    assert losses.delta_loss(df, 3.0).first()[0] == pytest.approx(want)


def test_total(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0), (3, 5.0, 6.0, 7.0, 8.0)], "rows int, de_loss double, lfc_loss double, lfc_dir_loss double, dp_loss double")
    assert losses.weighted_total(df).first().loss == pytest.approx(0.25 * 10 + 0.75 * 26)


def test_tiers(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    first = spark.createDataFrame([("a", "1")], "key string, text string")
    second = spark.createDataFrame([("a", "x"), ("b", "2")], "key string, text string")
    assert {r.key: (r.text, r.tier) for r in K.first_of_tiers(keys, first, second).collect()} == {"a": ("1", 0), "b": ("2", 1), "c": (None, None)}


def test_compound_ids(spark):
    metadata = spark.createDataFrame([("a ", 1), ("b", None), ("c", 3), ("d", 4), ("d", 5), ("e", None)], "drug string, cid long")
    overrides = spark.createDataFrame([("b", 20, "primary"), ("b", 21, "salt"), ("c", 9, "primary")], "name string, cid long, relationship string")
    ask = lambda *n: K.compound_ids(spark.createDataFrame([(x,) for x in n], "name string"), metadata, overrides)
    assert {tuple(r) for r in ask("a", "b").collect()} == {("a", 1, "primary"), ("b", 20, "primary"), ("b", 21, "salt")}
    for name, message in (("c", "disagrees"), ("d", "twice"), ("e", "no id"), ("f", "not in")):
        with pytest.raises(Exception, match=message):
            ask(name).collect()


def test_properties(spark):
    rows = [(1, "MolecularWeight", "46.1"), (1, "Charge", "-1"), (1, "XLogP", "-0.3"), (2, "MolecularWeight", "0"), (2, "HBondDonorCount", "1.5"), (2, "XLogP", "NaN"), (2, "TPSA", "-1"), (2, "Charge", " ")]
    bad = K.invalid_properties(spark.createDataFrame(rows, "cid int, field string, value string"))
    assert bad.count() == 5 and {r.cid for r in bad.collect()} == {2}


def test_shapes(spark):
    proteins = spark.createDataFrame([("P3", 0, [3.0]), ("P1", 1, [1.0]), ("P2", 2, [2.0])], "protein string, pos int, vector array<double>")
    names = spark.createDataFrame([("P1", "BBB"), ("P2", "AAA"), ("P3", "BBB"), ("P4", "CCC")], "protein string, name string")
    assert {r.name: r.vector for r in K.first_protein_per_name(proteins, names).collect()} == {"AAA": [2.0], "BBB": [3.0]}
    windows = spark.createDataFrame([("k", 0, [[0.0], [2.0]]), ("k", 1, [[4.0], [6.0]])], "key string, start int, states array<array<double>>")
    assert K.window_means(windows).first().vector == [pytest.approx((0 + 3 + 6) / 3)]
    tokens = spark.createDataFrame([("b", 0, [[1.0, 2.0]]), ("b", 1, [[1.0, 1.0], [2.0, 2.0]]), ("b", 2, [])], "batch string, row int, tokens array<array<double>>")
    got = {r.row: (r.tokens, r.mask) for r in K.padded_tokens(tokens, "batch").collect()}
    assert got[0] == ([[1.0, 2.0], [0.0, 0.0]], [True, False]) and got[2] == ([[0.0, 0.0]] * 2, [False, False])
    axis = spark.createDataFrame([("a",), ("b",)], "gene string")
    parts = spark.createDataFrame([("a",), ("z",)], "gene string")
    assert {tuple(r) for r in K.uncovered_genes(parts, axis).collect()} == {("z", "not on the axis"), ("b", "in no shard")}
