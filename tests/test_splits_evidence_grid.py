"""Splits, leave-one-out evidence and the delta grid on hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.operators import evidence as E
from screenloom.operators import grid as G
from screenloom.operators import sampling
from screenloom.operators import splits as S


def test_read_split(spark):
    got = S.read_split(spark, '{"a.x.y": ["p", "q"], "b.z": []}', "train").collect()
    assert [tuple(r)[1:4] for r in got] == [("a", "x.y", "p"), ("a", "x.y", "q")]
    for bad in ('{"a.x": ["p"], "a.x": ["q"]}', '{"ax": ["p"]}', '{"a.x": ["p", "p"]}', '{"a.x": "p"}'):
        with pytest.raises(ValueError):
            S.read_split(spark, bad, "train")


def test_resolution_and_causes(spark):
    rows = spark.createDataFrame([("a", "x", "p", 0), ("a", "x", "q", 1)], "dataset string, context string, pert string, row long")
    split = spark.createDataFrame([("a", "x", "p"), ("a", "x", "n"), ("a", "n", "p"), ("n", "x", "p")], "dataset string, context string, pert string")
    assert [tuple(r) for r in S.resolve_split(split, rows).collect()] == [("a", "x", "p", 0)]
    assert {(r.dataset, r.context, r.pert): r.cause for r in S.unresolved(split, rows).collect()} == {
        ("a", "x", "n"): "perturbation", ("a", "n", "p"): "context", ("n", "x", "p"): "dataset"
    }
    assert {tuple(r) for r in S.query_rows(split, rows).collect()} == {("a", "x", "p", -1), ("a", "x", "n", -1)}
    assert S.leaks(rows, split, rows.filter("row = 1")).count() == 2
    assert S.duplicate_rows(rows.unionByName(rows)).count() == 2 and S.duplicate_rows(rows).count() == 0
    assert [r.dataset for r in S.contributing(rows, split).collect()] == ["a"]


ROWS = [
    ("alpha", "a1", "GA", "g", 2.0, 0.01, True, 0.5), ("alpha", "a1", "GA", "h", 0.5, 0.01, True, -0.5), ("alpha", "a2", "GA", "g", 1.0, 0.01, True, 0.25),
    ("beta", "b1", "GA", "g", 4.0, 0.2, True, 1.0), ("beta", "b1", "GB", "g", 0.0, 1.0, False, 0.0), ("beta", "b1", "GB", "h", 8.0, 0.04, True, 2.0),
]
SCHEMA = "dataset string, context string, pert string, gene string, fold_change double, fdr double, tested boolean, delta double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_contributions(rows):
    parts = {(r.context, r.pert, r.gene): r for r in E.contributions(rows, clip=2.0).collect()}
    a = parts["a1", "GA", "g"]
    assert (a.up_cnt, a.down_cnt, a.lfc_sum, a.lfc_cnt, a.dp_sumsq) == (1, 0, 1.0, 1, 0.25)
    assert (parts["a2", "GA", "g"].up_cnt, parts["a2", "GA", "g"].down_cnt) == (0, 0)  # a fold change of 1 has no sign
    assert parts["b1", "GA", "g"].up_cnt == 0  # not significant
    b = parts["b1", "GB", "g"]
    assert (b.tested_cnt, b.lfc_cnt, b.dp_cnt) == (0, 0, 1)
    assert parts["b1", "GB", "h"].lfc_sum == 2.0  # clipped


def test_leave_one_out_equals_recomputing(spark, rows):
    parts = E.contributions(rows, clip=2.0)
    queries = rows.select("dataset", "context", "pert").distinct()
    got = {(r.dataset, r.context, r.pert, r.gene): r for r in E.leave_one_out(queries, parts).collect()}
    for q in queries.collect():
        rest = parts.filter(~((F.col("dataset") == q.dataset) & (F.col("context") == q.context) & (F.col("pert") == q.pert)))
        want = {r.gene: r for r in E.totals(rest.filter(F.col("pert") == q.pert), "pert", "gene").collect()}
        for gene in "gh":
            r = got.get((*q, gene))
            if r is None:
                assert gene not in want
                continue
            for s in E.STATS:
                assert r[s] == pytest.approx(want[gene][s] if gene in want else 0)
    context = {(r.dataset, r.context, r.pert, r.gene): r.dp_cnt for r in E.context_leave_one_out(queries, parts).collect()}
    assert context["beta", "b1", "GA", "h"] == 1 and context["beta", "b1", "GA", "g"] == 1 and context["alpha", "a1", "GA", "g"] == 0


def test_broken_records_are_zeroed(spark, rows):
    parts = E.contributions(rows)
    extra = parts.filter("context = 'a1'").withColumn("tested_cnt", F.lit(-5).cast("long")).withColumn("context", F.lit("zz"))
    got = E.leave_one_out(rows.select("dataset", "context", "pert"), parts.unionByName(extra)).filter("gene = 'h' AND context = 'a2'").first()
    assert got.dp_cnt == 0 and got.dp_sum == 0


def test_blocks_and_scales(spark, rows):
    stats = E.totals(E.contributions(rows, clip=2.0), "pert", "gene")
    scale = E.scales(stats)
    s = scale.first()
    values = [r[7] for r in ROWS]
    mean = sum(values) / len(values)
    assert s.dp == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)))
    got = {(r.pert, r.gene): r for r in E.blocks(stats, scale).collect()}
    g = got["GA", "g"]
    m = (0.5 + 0.25 + 1.0) / 3
    sd = math.sqrt(sum((v - m) ** 2 for v in (0.5, 0.25, 1.0)) / 3)
    assert g.evidence_dp == pytest.approx([m / s.dp, sd / s.dp, 1, math.log(4)], rel=1e-5)
    assert g.evidence_de == pytest.approx([1 / 3, 0, 1, math.log(4)], rel=1e-5)
    assert got["GB", "g"].evidence_lfc == [0, 0, 0, 0]
    prov = {(r.pert, r.gene): r.prov for r in E.provenance(E.totals(E.contributions(rows), "dataset", "pert", "gene")).collect()}
    assert prov["GB", "g"] == pytest.approx([0, 0, 0, 1, math.log(2), 0], rel=1e-5)


def test_records_round_trip(rows):
    records = E.donor_records(rows, clip=2.0)
    assert E.invalid_records(records).count() == 0
    back = E.totals(E.unpack_records(records), "dataset", "context", "gene")
    assert E.disagreeing_totals(records, back).count() == 0
    assert E.disagreeing_totals(records, back.withColumn("up_cnt", F.col("up_cnt") + 1)).count() == back.count()
    assert E.invalid_records(records.withColumn("flags", F.lit(6).cast("tinyint"))).count() == records.count()
    assert E.overflows(back).count() == 0


def test_clip(spark, rows):
    assert E.clip_at(rows, 100.0).first().clip == 3.0
    assert E.clip_at(rows.filter("fold_change = 1.0")).first().clip == 1.0


def test_grid_reference_sizes():
    assert G.bins_of(0.7726817727088928, 1.1).bins == 17 and G.bins_of(0.5923969745635986, 1.01).bins == 121
    width = math.exp(0.1)
    assert [G.bins_of(t, width).bins for t in (0.33, 0.37, 0.41)] == [7, 9, 9]


@pytest.mark.parametrize("kind", ["outlier", "heavy", "ties", "even"])
def test_the_last_selection_of_a_percentile_stays_bounded(spark, kind, monkeypatch):
    """Whatever the values: no more distinct values are sorted than asked, and the percentile is numpy's."""
    rng = np.random.default_rng(5)
    values = {
        "outlier": np.append(rng.random(8000), 1e300), "heavy": np.exp(rng.normal(0, 12, 8000)), "ties": np.round(rng.normal(0, 1, 8000), 1), "even": np.arange(8000) * -1.0,
    }[kind]
    df = spark.createDataFrame([(float(x), "a") for x in values] + [(1.0, "b"), (2.0, "b"), (float("nan"), "b"), (None, "c")], "x double, k string").repartition(3)
    seen, plain = [], G._bracketed
    monkeypatch.setattr(G, "_bracketed", lambda *a: seen.append(out := plain(*a)) or out)
    for share in (0.0, 0.0001, 0.37, 0.95, 0.999, 1.0):
        got = {r.k: r.p for r in G.exact_percentile(df, "x", share, "k", accuracy=40, selected=160).collect()}
        assert got == {"a": pytest.approx(np.percentile(values, 100 * share)), "b": pytest.approx(1 + share)}
        assert seen[-1].filter("k = 'a' AND w IS NOT NULL").count() <= 160
    assert len(seen) > 6 or kind == "ties"


def test_percentile_and_fit(spark):
    rows = [("d", v) for v in (0.1, -0.2, 0.3, -0.4, 0.5, float("nan"), float("inf"))] + [("d", None)]
    df = spark.createDataFrame(rows, "dataset string, delta double")
    for p, want in ((50, 0.3), (25, 0.2), (100, 0.5)):
        assert G.delta_percentiles(df, p).first().p == pytest.approx(want)
    fitted = G.fit(G.delta_percentiles(df, 100.0), math.exp(0.1)).first()
    assert fitted.bins % 2 == 1 and G.fit(G.delta_percentiles(df), math.exp(0.1), override=0.33).first().bins == 7


def test_quantize_and_two_hot(spark):
    values = [0.0, 0.25, -0.5, -1.0, 1.0, 3.0, -7.0, float("nan"), 0.75, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    top, bins = F.lit(1.0), F.lit(5)
    got = [r[0] for r in df.orderBy("i").select(G.quantize(F.col("v"), top, bins)).collect()]
    assert got == [2, 3, 1, 0, 4, 4, 0, -100, 4, 2]
    centres = spark.range(5).select(G.centre(F.col("id"), top, bins)).collect()
    assert [r[0] for r in centres] == pytest.approx([-0.8, -0.4, 0, 0.4, 0.8])
    hot = {r.i: [(x.bin, round(x.weight, 6)) for x in r.t] for r in df.select("i", G.two_hot(F.col("v"), top, bins).alias("t")).collect()}
    assert hot[1] == [(2, 0.375), (3, 0.625)] and hot[2] == [(0, 0.25), (1, 0.75)] and hot[8] == [(3, 0.125), (4, 0.875)] and hot[7] == []
    assert hot[5] == [(3, 0.0), (4, 1.0)]


def test_readout(spark):
    df = spark.createDataFrame([([0.0, 4.0], [0.0, 1.0, 9.0])], "de array<double>, dp array<double>")
    p, delta = df.select(*G.readout(F.col("de"), F.col("dp"), F.lit(1.0), F.lit(3))).first()
    assert p == pytest.approx(1 / (1 + math.exp(-1))) and delta == pytest.approx(2 / 3)


def test_control_features(spark):
    df = spark.createDataFrame([("a", "g", 0.0), ("a", "h", 1.0), ("b", "g", float("nan")), ("b", "h", 1.0)], "context string, gene string, value double")
    got = {(r.context, r.gene): r.features for r in G.control_features(df, "context").collect()}
    assert got["a", "g"] == [0, 0, 1] and got["a", "h"] == pytest.approx([1, math.log(101), 0]) and got["b", "h"] == [0, 0, 0]


def test_batches(spark):
    rows = [(0, "0", "a1"), (1, "0", "a1"), (2, "0", "a1"), (3, "0", "a2"), (4, "1", "a2"), (5, "1", "b1")]
    df = spark.createDataFrame(rows, "ord long, dataset string, context string")
    assert [r.batch for r in sampling.batch_runs(df, 2).orderBy("ord").collect()] == [0, 0, 1, 2, 3, 4]


def test_apportion(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "idx int, weight double")
    assert [r.n for r in sampling.apportion(df, 1000).orderBy("idx").collect()] == [500, 300, 200]
    assert sampling.largest_remainder([1, 1, 1], 10) == [4, 3, 3]
    equal = spark.createDataFrame([(i, 1.0) for i in range(3)], "idx int, weight double")
    assert [r.n for r in sampling.apportion(equal, 10).orderBy("idx").collect()] == [4, 3, 3]


def test_blended_sampler():
    members = {0: list(range(60)), 1: list(range(100, 130)), 2: [999]}
    make = lambda rank: sampling.BlendedSampler(members, {0: 0.5, 1: 0.5, 2: 0.0}, replicas=2, rank=rank, seed=3)
    first, second = list(make(0)), list(make(1))
    both = first + second
    assert len(first) == len(second) == len(make(0)) == 45 and sum(i < 100 for i in both) == 45 and 999 not in both
    a = make(0)
    assert sorted(a.stream(0, 0, 60).tolist()) == members[0]
    assert a.stream(0, 50, 20).tolist() == a.stream(0, 50, 10).tolist() + a.stream(0, 60, 10).tolist()
    assert list(make(0)) == first and a.stream(0, 5, 0).size == 0
    with pytest.raises(ValueError):
        sampling.BlendedSampler(members, {0: 1.0, 7: 1.0})
    with pytest.raises(ValueError):
        sampling.BlendedSampler(members, {0: -1.0, 1: 3.0})
