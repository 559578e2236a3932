"""Counts, labels and the rank-sum against plain versions on random screens."""

import math
import random

import pytest
from pyspark.sql import functions as F

from screenloom.operators import counts as C
from screenloom.operators import labels as L
from screenloom.operators.ranksum import adjusted, differential_expression

def random_screen(seed, n=150):
    """Cells of three contexts with small random counts: [(cell, context, pert)] and {(cell, gene): count}."""
    rng = random.Random(seed)
    genes = [f"gene{i}" for i in range(6)]
    perts = ["gene0", "gene1", "gene4", "gene5", "elsewhere", C.CONTROL]
    cells = [(i, rng.choice(["left", "right", "far"]), rng.choice(perts)) for i in range(n)]
    values = {}
    for i, _, pert in cells:
        for k, g in enumerate(genes):
            high = 2 if g == pert else 7 - k
            if count := rng.randint(0, high) if g != "gene5" or pert != C.CONTROL else 0:
                values[i, g] = count
    return cells, values


def as_tables(spark, cells, values):
    c = spark.createDataFrame(cells, "cell_id long, context string, pert string")
    k = spark.createDataFrame([(i, g, float(v)) for (i, g), v in values.items()], "cell_id long, gene string, value float")
    return c, k


def plain_marks(cells, values, residual, cell_residual, min_cells, genes):
    """The three stages, group by group."""
    kept = {i for i, _, p in cells if p == C.CONTROL}
    for context, pert in {(x, p) for _, x, p in cells if p != C.CONTROL}:
        controls = [i for i, x, p in cells if (x, p) == (context, C.CONTROL)]
        own = {i: values.get((i, pert), 0) for i, x, p in cells if (x, p) == (context, pert)}
        base = sum(values.get((i, pert), 0) for i in controls) / len(controls) if controls else 0
        if pert not in genes or base <= 1e-8 or sum(own.values()) / len(own) / base >= residual:
            continue
        low = {i for i, v in own.items() if v / base < cell_residual}
        kept |= low if len(low) >= min_cells else set()
    return kept


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kwargs", [{"residual": 0.35, "cell_residual": 0.5, "min_cells": 2}, {"residual": 0.6, "cell_residual": 0.4, "min_cells": 4}, {"residual": 50.0, "cell_residual": 50.0, "min_cells": 1}])
def test_knockdown_stages(spark, seed, kwargs):
    cells, values = random_screen(seed)
    marks = C.knockdown_marks(*as_tables(spark, cells, values), **kwargs)
    kept = plain_marks(cells, values, genes={g for _, g in values}, **kwargs)
    assert {r.cell_id for r in marks.filter("keep").collect()} == kept
    for r in C.knockdown_stats(marks).collect():
        own = [(i, p) for i, x, p in cells if x == r.context]
        perts, left = {p for _, p in own if p != C.CONTROL}, {p for i, p in own if p != C.CONTROL and i in kept}
        assert (r.cells_in, r.cells_out, r.control_cells) == (len(own), sum(i in kept for i, _ in own), sum(p == C.CONTROL for _, p in own))
        assert (r.perts_in, r.perts_out, r.perts_dropped) == (len(perts), len(left), len(perts - left))
    groups = {(x, p) for _, x, p in cells}
    assert {tuple(r) for r in C.knockdown_dropped(marks).collect()} == groups - {(x, p) for i, x, p in cells if i in kept}


def test_knockdown_thresholds_are_strict(spark):
    """A mean or a value exactly at its threshold does not pass; a count of cells exactly at its own does."""
    cells = [(0, "x", C.CONTROL), (1, "x", C.CONTROL), (2, "x", "a"), (3, "x", "a"), (4, "x", "b"), (5, "x", "b")]
    values = {(0, "a"): 12, (1, "a"): 4, (2, "a"): 1, (3, "a"): 3, (0, "b"): 16, (5, "b"): 4}
    tables = as_tables(spark, cells, values)

    def kept(residual, cell_residual, min_cells):
        marks = C.knockdown_marks(*tables, residual=residual, cell_residual=cell_residual, min_cells=min_cells)
        return {r.cell_id for r in marks.filter("keep").collect()} - {0, 1}

    assert kept(0.25, 1.0, 1) == set()  # the mean of a is 2 of 8, that of b 2 of 8
    assert kept(0.26, 1.0, 2) == {2, 3, 4, 5}
    assert kept(0.26, 0.375, 1) == {2, 4}  # 3 of 8, 4 of 8
    assert kept(0.26, 0.376, 2) == {2, 3}


def test_targets_off_the_gene_list_keep_controls_only(spark):
    cells, values = random_screen(7)
    other = spark.createDataFrame([("nowhere",)], "gene string")
    marks = C.knockdown_marks(*as_tables(spark, cells, values), residual=50, cell_residual=50, min_cells=1, genes=other)
    assert {r.cell_id for r in marks.filter("keep").collect()} == {i for i, _, p in cells if p == C.CONTROL}


def test_normalize(spark):
    _, values = random_screen(3, 40)
    counts = spark.createDataFrame([(i, g, float(v)) for (i, g), v in values.items()], "cell_id long, gene string, value float")
    totals = {}
    for (i, _), v in values.items():
        totals[i] = totals.get(i, 0) + v
    done = C.normalize_log1p(counts, 50.0)
    got = {(r.cell_id, r.gene): r.value for r in done.collect()}
    assert got.keys() == values.keys()
    assert all(got[k] == pytest.approx(math.log1p(v * 50 / totals[k[0]]), rel=1e-5) for k, v in values.items())
    assert C.denormalized(done, 50.0).count() == 0
    assert C.denormalized(counts, 50.0).count() == len(totals)


def test_checks(spark):
    counts = spark.createDataFrame([(0, "a", 1.5), (1, "a", 2.0), (1, "b", 0.0)], "cell_id long, gene string, value float")
    cells = spark.createDataFrame([(0,), (1,), (2,)], "cell_id long")
    assert [r.cell_id for r in C.non_integral(counts).collect()] == [0]
    assert [r.cell_id for r in C.empty_cells(cells, counts).collect()] == [2]
    assert tuple(C.stored_counts(counts).first()) == (3, 2)


def test_pseudobulk_delta(spark):
    cells, values = random_screen(11)
    tables = as_tables(spark, cells, values)

    def mean(context, pert, gene):
        own = [i for i, x, p in cells if (x, p) == (context, pert)]
        return sum(values.get((i, gene), 0) for i in own) / len(own)

    genes = {(x, g) for i, x, _ in cells for j, g in values if i == j}
    wanted = {(x, p, g) for _, x, p in cells if p != C.CONTROL for y, g in genes if x == y}
    got = {(r.context, r.pert, r.gene): r for r in C.pseudobulk_delta(*tables).collect()}
    assert got.keys() == wanted
    for (x, p, g), r in got.items():
        assert r.delta == pytest.approx(mean(x, p, g) - mean(x, C.CONTROL, g))
    means = {(r.context, r.gene): r.value for r in C.control_means(*tables).collect()}
    assert all(means.get(k, 0) == pytest.approx(mean(k[0], C.CONTROL, k[1])) for k in genes)


def test_context_without_controls(spark):
    cells = spark.createDataFrame([(0, "c", "P1")], "cell_id long, context string, pert string")
    counts = spark.createDataFrame([(0, "a", 1.0)], "cell_id long, gene string, value float")
    assert C.pseudobulk_delta(cells, counts).first().delta is None


def test_label_arrays(spark):
    rng = random.Random(21)
    names = [f"n{i}" for i in range(9)]
    rows = [(x, p, g, rng.randint(1, 99) / 100, 2.0 ** rng.randint(-3, 3)) for x in ("One", "TWO") for p in ("u", "v", "w") for g in rng.sample(names, 3)]
    labels = spark.createDataFrame(rows, "context string, pert string, gene string, fdr double, fold_change double")
    labels = L.normalize_labels(labels, lower=True, context_map={"one": "c1", "two": "c2"})
    listed = rng.sample(names[:7], 7)
    axis = L.gene_axis(spark.createDataFrame([(g, 0, i) for i, g in enumerate(listed)], "gene string, file_ord int, pos int"), labels)
    order = [g for g in listed if g in {r[2] for r in rows}]
    assert [r.gene for r in axis.orderBy("pos").collect()] == order
    known = {({"One": "c1", "TWO": "c2"}[x], p, g): (q, fc) for x, p, g, q, fc in rows if g in order}
    got = {(r.context, r.pert, r.gene): r for r in L.label_arrays(labels, axis).collect()}
    assert got.keys() == {(x, p, g) for x, p, _ in known for g in order}
    for key, r in got.items():
        q, fc = known.get(key, (1.0, 0.0))
        assert (r.tested, r.fold_change, r.lfc) == (key in known, fc, math.log2(fc) if key in known else None)
        assert r.fdr == pytest.approx(q, rel=1e-6)


def test_unmapped_context_is_an_error(spark):
    df = spark.createDataFrame([("x", "p", "g")], "context string, pert string, gene string")
    with pytest.raises(Exception, match="unmapped context"):
        L.normalize_labels(df, context_map={"a": "b"}).collect()


def test_last_wins_and_files(spark):
    rows = [("c", "p", "g", 1.0, 0, 1), ("c", "p", "g", 2.0, 0, 3), ("c", "p", "g", 9.0, 0, 2), ("c", None, "g", 5.0, 0, 1), ("c", "p", "h", 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "context string, pert string, gene string, fold_change double, file int, ord int")
    assert {(r.gene, r.fold_change) for r in L.last_wins(df, "ord").collect()} == {("g", 2.0), ("h", 1.0)}
    assert [tuple(r) for r in L.pairs_in_several_files(df).collect()] == [("c", "p", 2)]


def test_fold_change_spaces(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (4.0,), (None,)], "v double")
    linear = [r[0] for r in df.select(L.fold_changes(F.col("v"), "linear")[1]).collect()]
    assert linear[0] == float("-inf") and math.isnan(linear[1]) and linear[2] == 2 and linear[3] is None
    log2 = [tuple(r) for r in df.select(*L.fold_changes(F.col("v"), "log2")).collect()]
    assert log2[0] == (1, 0) and log2[2] == (16, 4)
    ln = df.select(*L.fold_changes(F.col("v"), "ln")).collect()[2]
    assert ln[0] == pytest.approx(math.exp(4)) and ln[1] == pytest.approx(4 / math.log(2))


def test_dose_literals(spark):
    df = spark.createDataFrame([("[('drug (a)', 0.05, 'uM')]",), ("plain",)], "v string")
    assert [r[0] for r in df.select(L.parse_drug_dose(F.col("v"))).collect()] == ["drug (a)_0.05uM", "plain"]
    with pytest.raises(Exception, match="malformed dose"):
        spark.createDataFrame([("[(oops)]",)], "v string").select(L.parse_drug_dose(F.col("v"))).collect()


def test_ensembl_ids(spark):
    df = spark.createDataFrame([("a", " ENSG1 "), ("a", "nan"), ("b", None), ("a", "ENSG1")], "pert string, ensembl string")
    assert [tuple(r) for r in L.ensembl_ids(df).collect()] == [("a", "ENSG1")]
    with pytest.raises(Exception, match="several ids"):
        L.ensembl_ids(spark.createDataFrame([("a", "ENSG1"), ("a", "ENSG2")], "pert string, ensembl string")).collect()


def test_column_roles(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert L.map_columns(df, {"fdr": "b", "gene": "a"}).columns == ["fdr", "gene"]
    with pytest.raises(ValueError, match="several roles"):
        L.map_columns(df, {"fdr": "b", "gene": "b"})
    with pytest.raises(ValueError, match="missing"):
        L.map_columns(df, {"fdr": "z"})


def test_ranksum_against_pairs(spark):
    rng = random.Random(4)
    cells = [(i, "c", "non-targeting" if i < 9 else "P") for i in range(15)]
    values = {(i, g): rng.choice([0, 0, 1, 2, 3]) for i in range(15) for g in ("a", "b")} | {(i, "z"): 5 for i in range(15)}
    c = spark.createDataFrame(cells, "cell_id long, context string, pert string")
    k = spark.createDataFrame([(i, g, float(v)) for (i, g), v in values.items() if v], "cell_id long, gene string, value float")
    total = {i: sum(values[i, g] for g in "abz") for i in range(15)}
    got = {r.feature: r for r in differential_expression(c, k).collect()}
    for g in "abz":
        v = {i: values[i, g] / total[i] for i in range(15)}
        u = sum((v[i] > v[j]) + 0.5 * (v[i] == v[j]) for i in range(9, 15) for j in range(9))
        assert got[g].Ueffect == pytest.approx(u / 54)
        assert 0 <= got[g].p_value <= got[g].p_adj <= 1
        assert got[g].target_mean == pytest.approx(sum(v[i] for i in range(9, 15)) / 6 * 10_000)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("c", "t", f"g{i}", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "context string, target string, feature string, p_value double")
    got = [r.p_adj for r in adjusted(df).orderBy("feature").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
