"""Metric policies on hand-made rows."""

import math
import random

import pytest

from screenloom.operators import metrics as M

SCHEMA = "dataset string, context string, pert string, row int, gene string, p_de double, lfc_pred double, delta_pred double, de_true boolean, tested boolean, lfc_true double, delta_true double, ctrl_mean double"
NAN = float("nan")


def rows(spark, entries):
    """entries: dicts over defaults."""
    base = {"dataset": "d", "context": "c", "pert": "p", "row": 0, "p_de": 0.0, "lfc_pred": 0.0, "delta_pred": 0.0, "de_true": False, "tested": True, "lfc_true": 0.0, "delta_true": 0.0, "ctrl_mean": 10.0}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | e)[n] for n in names) for e in entries], SCHEMA)


def ap(spark, scores, truth, tested=None):
    tested = tested or [True] * len(scores)
    df = rows(spark, [{"gene": f"g{i}", "p_de": s, "de_true": t, "tested": x, "lfc_pred": 1.0} for i, (s, t, x) in enumerate(zip(scores, truth, tested, strict=True))])
    return M.average_precision(M.prepared(df)).first().binary_auprc


def test_average_precision(spark):
    assert ap(spark, [0.9, 0.1, 0.2], [True, False, False]) == 1.0
    assert ap(spark, [0.9, 0.1], [False, False]) == 0 and ap(spark, [0.9, 0.1], [True, True]) == 0
    assert ap(spark, [0.9, 0.1], [True, False], [False, False]) == 0
    assert ap(spark, [NAN, 0.9, 0.1], [True, True, False]) == pytest.approx(5 / 6)
    assert ap(spark, [0.5, 0.5, 0.1], [True, False, False]) == pytest.approx(0.5)  # ties collapse


def jd(spark, entries):
    return M.jaccard_and_direction(M.prepared(rows(spark, entries))).first()


def test_jaccard(spark):
    e = lambda g, p, t, **k: {"gene": g, "p_de": p, "de_true": t, **k}
    assert jd(spark, [e("a", 0.5, True), e("b", 0.6, False)]).sig_jaccard == 0.5
    assert jd(spark, [e("a", 0.4, False)]).sig_jaccard == 1
    assert jd(spark, [e("p", 0.9, True), e("b", 0.9, False)]).sig_jaccard == 0  # the own gene is left out
    assert jd(spark, [e("a", 0.9, True, lfc_true=NAN), e("b", 0.9, True), e("c", 0.9, False)]).sig_jaccard == pytest.approx(1 / 3)
    assert jd(spark, [e("a", 0.9, True, tested=False)]).sig_jaccard == 1  # untested genes are no effects


def test_direction(spark):
    e = lambda t, p: {"gene": f"{t}{p}", "de_true": True, "lfc_true": t, "lfc_pred": p}
    assert jd(spark, [e(1.0, 0.5), e(-2.0, -1.0), e(3.0, NAN)]).direction_match == pytest.approx(2 / 3)
    assert jd(spark, [{"gene": "g"}]).direction_match == 0
    assert jd(spark, [e(1.0, 0.0)]).direction_match == 0


def test_spearman(spark):
    def rho(truth, pred):
        df = rows(spark, [{"gene": f"g{i}", "de_true": True, "lfc_true": t, "lfc_pred": p} for i, (t, p) in enumerate(zip(truth, pred, strict=True))])
        found = M.spearman_lfc(M.prepared(df)).first()
        return found.spearman_lfc if found else None

    assert rho([1.0, 2.0, 3.0], [1.0, 5.0, 9.0]) == pytest.approx(1) and rho([1.0, 2.0, 3.0], [9.0, 5.0, 1.0]) == pytest.approx(-1)
    assert rho([1.0, 2.0], [3.0, 3.0]) is None and rho([1.0], [3.0]) is None
    assert rho([1.0, 2.0, 3.0, 4.0], [1.0, 2.0, NAN, NAN]) == pytest.approx(0.9486832980505138)  # missing ones share the last rank


def test_count_correlation(spark):
    none = rows(spark, [{"gene": "g", "pert": p} for p in "ab"])
    assert M.spearman_nsig(M.prepared(none)).first().spearman_nsig == 1
    one = rows(spark, [{"gene": "g", "pert": "a", "de_true": True}, {"gene": "g", "pert": "b"}])
    assert M.spearman_nsig(M.prepared(one)).first().spearman_nsig is None
    many = rows(spark, [{"gene": f"g{i}", "pert": p, "de_true": i < n, "p_de": 0.9 if i < n else 0.1, "lfc_pred": 1.0} for p, n in (("a", 1), ("b", 2), ("c", 3)) for i in range(4)])
    assert M.spearman_nsig(M.prepared(many)).first().spearman_nsig == pytest.approx(1)


def effects(spark, real, pred, genes=("x", "y", "z")):
    names = "abcd"
    entries = [{"pert": names[i], "gene": g, "delta_true": float(r[k]), "delta_pred": float(p[k])} for i, (r, p) in enumerate(zip(real, pred, strict=True)) for k, g in enumerate(genes)]
    found = M.discrimination_l1(M.bulk_effects(M.prepared(rows(spark, entries))))
    return {r.pert: r.discrimination_score_l1 for r in found.collect()}


def test_discrimination(spark):
    got = effects(spark, [(0, 0, 0), (2, 0, 0), (0, 2, 0), (5, 5, 5)], [(0, 0, 0), (3, 0, 0), (0, 3, 0), (1, 1, 0)])
    assert [got[p] for p in "abcd"] == [1, 1, 1, 0.25]


@pytest.mark.parametrize("gaps", [False, True])
def test_ranks_equal_all_against_all(spark, gaps):
    """Several blocks; perturbations that are genes and others; equal truths, whose ties go by name; genes that some lack."""
    rng = random.Random(9)
    genes = [f"p{i}" for i in range(12)] + ["x", "y"]
    effects, want = [], {}
    for context in ("c1", "c2"):
        real = {f"p{i}": {g: rng.choice([0.0, 1.0, rng.gauss(i % 4 * 5, 1)]) for g in genes} for i in range(20)}
        real["p3"] = dict(real["p4"])
        pred = {p: {g: v + rng.gauss(0, 0.5) for g, v in real[p].items()} for p in real}
        pred["p3"] = dict(pred["p4"])
        if gaps:
            for p in ("p1", "p7"):
                for side in (real, pred):
                    del side[p]["y"]
        effects += [("d", context, p, g, real[p][g], pred[p][g]) for p in real for g in real[p]]
        for p in real:
            far = {q: round(sum(abs(pred[p][g] - real[q][g]) for g in genes if g != p and g in pred[p] and g in real[q]), 9) for q in real}
            want[context, p] = (sum((far[q], q) < (far[p], p) for q in real), len(real))
    df = spark.createDataFrame(effects, "dataset string, context string, pert string, gene string, real double, pred double").repartition(4)
    met = []
    for block in (7, 128):
        got = M.truth_ranks(df, block).collect()
        assert {(r.context, r.pert): (r["rank"], r.n) for r in got} == want
        met.append(sum(r.met for r in got))
    assert all(m <= 2 * 20 * 20 if gaps else m < 0.8 * 2 * 20 * 20 for m in met)


def test_discrimination_leaves_out_the_own_gene(spark):
    real, pred = [(0, 5), (0, 0)], [(0, 0), (0, 0)]
    assert effects(spark, real, pred, ("x", "y"))["a"] == 0.5
    assert effects(spark, real, pred, ("x", "a"))["a"] == 1.0


def test_rows_without_complete_truth_are_left_out(spark):
    entries = [{"pert": p, "row": r, "gene": g, "delta_true": t, "delta_pred": t} for p, r, g, t in (("a", 0, "x", 1.0), ("a", 0, "y", 2.0), ("a", 1, "x", NAN), ("a", 1, "y", 9.0), ("c", 0, "x", NAN), ("c", 0, "y", 1.0))]
    got = M.bulk_effects(M.prepared(rows(spark, entries))).collect()
    assert {(r.pert, r.gene): r.real for r in got} == {("a", "x"): 1.0, ("a", "y"): 2.0}


def test_hierarchy(spark):
    def pair(dataset, context, pert, jaccard_hit):
        return [{"dataset": dataset, "context": context, "pert": pert, "gene": g, "p_de": 0.9 if jaccard_hit else 0.1, "de_true": True, "lfc_true": float(i + 1), "lfc_pred": 1.0} for i, g in enumerate("uv")]

    entries = pair("alpha", "c1", "a", True) + pair("alpha", "c1", "b", False) + pair("alpha", "c2", "a", False) + pair("beta", "c", "a", True)
    contexts = M.context_metrics(M.prepared(rows(spark, entries)))
    by = {(r.dataset, r.context): r.sig_jaccard for r in contexts.collect()}
    assert by == {("alpha", "c1"): 0.5, ("alpha", "c2"): 0, ("beta", "c"): 1}
    assert M.aggregate_metrics(contexts).first().sig_jaccard == pytest.approx((0.25 + 1) / 2)
    table = {r.context: r for r in M.metrics_table(contexts).collect()}
    assert table["all"].sig_jaccard == pytest.approx(1.5 / 3) and table["all"].n_rows == 4 and len(table) == 4


def test_controls(spark):
    good = rows(spark, [{"gene": "a"}, {"gene": "b", "ctrl_mean": 3.0}])
    assert M.inconsistent_controls(good).count() == 0
    for bad in ([{"gene": "a", "ctrl_mean": NAN}, {"gene": "b"}], [{"gene": "a"}, {"gene": "a", "ctrl_mean": 4.0}], [{"gene": "a", "ctrl_mean": math.inf}]):
        assert M.inconsistent_controls(rows(spark, bad)).count() == 1
    assert M.inconsistent_controls(rows(spark, [{"gene": "a", "ctrl_mean": NAN}])).count() == 0
