"""Knowledge sources and text on upstream-like tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from screenloom.functions import records as R
from screenloom.functions import text as T
from screenloom.operators import knowledge as K


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def test_alias_only_on_a_miss_with_a_target(spark):
    source = spark.createDataFrame([("GA",), ("GB",), ("GC",), ("GD",)], "key string")
    aliases = spark.createDataFrame([("OLDX", "GD"), ("GC", "GA"), ("LOST", "GZ")], "key string, target string")
    keys = spark.createDataFrame([("OLDX",), ("GC",), ("LOST",), ("NEW",)], "key string")
    resolved = K.resolve_keys(keys, source, aliases)
    assert {r.key: (r.found, r.how) for r in resolved.collect()} == {"OLDX": ("GD", "alias"), "GC": ("GC", "direct"), "LOST": (None, "missing"), "NEW": (None, "missing")}
    assert tuple(K.coverage(resolved).first()) == (4, 1, 1, 2, ["LOST", "NEW"])


def test_cosine(spark):
    a = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("y", [0.0, 0.0]), ("only", [1.0, 1.0])], "key string, vector array<float>")
    b = spark.createDataFrame([("a", [1.0, 1.0]), ("z", [0.0, 0.0]), ("y", [1.0, 0.0])], "key string, vector array<float>")
    got = {r.key: (r.equal, round(r.cosine, 4)) for r in K.compare_sources(a, b).collect()}
    assert got == {"a": (False, 0.7071), "z": (True, 1.0), "y": (False, 0.0)}
    assert K.comparison_summary(a, b).first().asDict() | {} == pytest.approx({"n_common": 3, "n_equal": 1, "cosine_min": 0.0, "cosine_mean": (1 + math.sqrt(0.5)) / 3, "n_new": 4, "n_reference": 3})


def test_go_counts(spark):
    rows = [("1", "Process", "GO:1", "first", 0), ("1", "Process", "GO:3", "three", 1), ("1", "Process", "GO:1", "later", 2), ("1", "Function", "GO:2", "two", 3)]
    df = spark.createDataFrame(rows, "gene string, category string, go_id string, term string, ord int")
    got = {r.category: [tuple(t) for t in r.terms] for r in K.go_counts(df).collect()}
    assert got == {"Process": [("GO:1", "first", 2), ("GO:3", "three", 1)], "Function": [("GO:2", "two", 1)]}


def test_groups_count_for_both_sides(spark):
    pairs = spark.createDataFrame([(1, "r", 3), (4, "r", 1), (9, "r", 8)], "gene int, relation string, other int")
    wanted = spark.createDataFrame([(1,), (3,), (4,)], "gene int")
    symbols = spark.createDataFrame([(1, "AAA"), (3, "CCC")], "gene int, symbol string")
    got = {r.gene: r.members for r in K.group_relations(pairs, wanted, symbols).collect()}
    assert got == {1: ["4", "CCC"], 3: ["AAA"], 4: ["AAA"]}


def test_greedy_claims(spark):
    stream = [(0, "AAA", True), (0, "BBB", True), (1, "CCC", True), (1, "EEE", False), (2, "EEE", False), (3, "DDD", True)]
    symbols = [("AAA", 0), ("BBB", 1), ("CCC", 2), ("DDD", 3), ("EEE", 4), ("FFF", 5)]
    got = K.greedy_claims(spark.createDataFrame(stream, "row int, name string, primary boolean"), spark.createDataFrame(symbols, "symbol string, pos int"))
    found = {r.symbol: (r.row, r.by) for r in got.collect()}
    assert found == {"AAA": (0, "primary"), "CCC": (1, "primary"), "DDD": (3, "primary")}  # EEE's first row is taken, BBB lost its own


def test_gene_cascade(spark):
    index = [("ensembl", "ENSG1", 1), ("ensembl", "ENSG2", 2), ("ensembl", "ENSG2", 3), ("symbol", "abc", 3), ("symbol", "two", 4), ("symbol", "TWO", 5), ("synonym", "old", 6)]
    queries = [("k1", "ensg1", None), ("k2", "ENSG2", "ABC"), ("k3", "ENSG2", "zzz"), ("k4", None, "OLD"), ("k5", None, "two"), ("k6", "ENSG9", "nope")]
    got = K.resolve_genes(spark.createDataFrame(queries, "key string, ensembl string, symbol string"), spark.createDataFrame(index, "kind string, name string, gene int"))
    assert {r.key: (r.gene, r.how) for r in got.collect()} == {
        "k1": (1, "ensembl"), "k2": (3, "ensembl"), "k3": (None, "ambiguous"), "k4": (6, "synonym"), "k5": (None, "ambiguous"), "k6": (None, "missing")
    }


def test_compound_cascade(spark):
    ids = [(1, ["K1", "P1"], "aspirin"), (2, ["K2", "P1"], "other"), (3, ["K3"], "third")]
    ext = [("a", "K2", [], "x"), ("b", None, ["P1"], "aspirin"), ("c", None, ["P1"], "none"), ("d", None, [], "third"), ("e", "K9", [], "zzz")]
    identities = spark.createDataFrame(ids, "drug int, keys array<string>, name_key string")
    got = K.match_compounds(spark.createDataFrame(ext, "ext_id string, inchikey string, smiles_keys array<string>, name_key string"), identities)
    assert {(r.ext_id, r.drug, r.how) for r in got.collect()} == {("a", 2, "inchikey"), ("b", 1, "smiles"), ("d", 3, "name")}


def test_gene_cascade_of_many_candidates(spark):
    """Random names, keys of several rows included: what the sets of candidates say; an id of 2,000 genes costs a query no more than one row."""
    rng = random.Random(5)
    kinds = [("ensembl", "E"), ("symbol", "s"), ("synonym", "s")]
    index = [(k, f"{p}{rng.randint(0, 8)}", rng.randint(0, 6)) for k, p in kinds for _ in range(9)]
    queries = [(rng.randint(0, 60), rng.choice([None, f"e{rng.randint(0, 8)}"]), rng.choice([None, f"S{rng.randint(0, 8)}"])) for _ in range(90)]
    want = {}
    for key in {q[0] for q in queries}:
        asked = [(k, (e if k == "ensembl" else s).lower()) for q, e, s in queries if q == key for k, _ in kinds if (e if k == "ensembl" else s)]
        found = {k: {g for x, n, g in index if (x, n.lower()) in asked and x == k} for k, _ in kinds}
        how = next((k for k, _ in kinds if found[k]), "missing")
        genes = found.get(how, set())
        if how == "ensembl" and len(genes) > 1:
            genes &= found["symbol"]
        want[key] = (*genes, how) if len(genes) == 1 else (None, "missing" if how == "missing" else "ambiguous")
    frames = spark.createDataFrame(queries, "key int, ensembl string, symbol string"), spark.createDataFrame(index, "kind string, name string, gene int")
    got = K.resolve_genes(*frames).collect()
    assert sorted(r.key for r in got) == sorted(q[0] for q in queries)
    assert {r.key: (r.gene, r.how) for r in got} == want
    many = spark.range(2000).select(F.lit("ensembl").alias("kind"), F.lit("E1").alias("name"), F.col("id").alias("gene"))
    asked = spark.range(2000).select(F.col("id").alias("key"), F.lit("e1").alias("ensembl"), F.lit(None).cast("string").alias("symbol"))
    told = K.resolve_genes(asked, many)
    assert told.filter("how = 'ambiguous' AND gene IS NULL").count() == 2000
    assert most_rows(told) < 100_000


def most_rows(df):
    """The most rows that one operator of a plan puts out as it runs."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    plan, most = [run.executedPlan()], 0
    while plan:
        p = plan.pop()
        kind, rows = p.getClass().getSimpleName(), p.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        inner = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else []
        plan += inner + [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_compound_cascade_equals_all_against_all(spark, monkeypatch):
    """Random keys and names, nulls, rows that repeat an id or hit a drug by several keys; blocks of two rows."""
    monkeypatch.setattr(K, "MATCH_BLOCK", 2)
    rng = random.Random(6)
    word = lambda c, n: rng.choice([None, *[f"{c}{i}" for i in range(n)]])
    ids = [(i % 40, [k for k in (word("k", 12), word("k", 12)) if k], word("n", 5)) for i in range(50)]
    ext = [(i % 70, word("k", 14), [k for k in (word("k", 14), word("k", 14)) if k and rng.random() < 0.6], word("n", 6)) for i in range(80)]
    hits = set()
    for e, inchi, smiles, name in ext:
        for drug, keys, drug_name in ids:
            tried = [(0, "inchikey", inchi in keys), (1, "smiles", bool(set(smiles) & set(keys))), (2, "name", name is not None and name == drug_name)]
            hits |= {(e, name, step, how, drug, drug_name) for step, how, hit in tried if hit}
    best = {e: min(h[2] for h in hits if h[0] == e) for e, *_ in hits}
    kept = [h for h in hits if h[2] == best[h[0]]]
    want = sorted((h[0], h[4], h[3]) for h in kept if sum(k[0] == h[0] for k in kept) == 1 or h[5] is not None and h[5] == h[1])
    frames = spark.createDataFrame(ext, "ext_id int, inchikey string, smiles_keys array<string>, name_key string"), spark.createDataFrame(ids, "drug int, keys array<string>, name_key string")
    assert sorted(map(tuple, K.match_compounds(*frames).collect())) == want and len(want) > 20


def test_compounds_are_not_listed_before_they_are_told_apart(spark):
    """3,000 rows and 3,000 drugs share a key and no name: nothing stays, and no nine million hits are listed on the way."""
    ext = spark.range(3000).select(F.col("id").alias("ext_id"), F.lit("k").alias("inchikey"), F.array().cast("array<string>").alias("smiles_keys"), F.lit("x").alias("name_key"))
    ids = spark.range(3000).select(F.col("id").alias("drug"), F.array(F.lit("k")).alias("keys"), F.lit("y").alias("name_key"))
    got = K.match_compounds(ext, ids)
    assert got.count() == 0 and most_rows(got) < 100_000


def test_nearest_dose_equals_all_against_all(spark):
    """Random doses, ties on either side, doses equal but for rounding, none positive, keys without doses."""
    rng = random.Random(4)
    grid = [0.0, -1.0, 0.1, 0.3, 0.1 + 0.2, 1.0, 10.0, 100.0, 33.0, 1e-9, 1 / 3, 1 / 3 + 1e-13]
    queries = [(rng.choice("abcd"), rng.choice([*grid, rng.random() * 50])) for _ in range(60)] + [("a", None), ("none", 1.0)]
    measured = [(rng.choice("abcx"), rng.choice([*grid, rng.random() * 50]), float(i)) for i in range(120)] + [("a", None, 1.0)]
    want = []
    for key, q in {x for x in queries if x[1] is not None and x[1] > 0}:
        own = [(d, v, abs(math.log10(d / q))) for k, d, v in measured if k == key and d is not None and d > 0]
        if own:
            near = [(d, v) for d, v, far in own if far <= min(x[2] for x in own) + 1e-10]
            low = min(d for d, _ in near)
            want += [(key, q, d, v) for d, v in near if abs(d - low) <= 1e-8 * abs(low)]
    got = K.nearest_dose(spark.createDataFrame(queries, "drug string, dose double"), spark.createDataFrame(measured, "drug string, dose double, value double"))
    assert sorted((r.drug, r.query_dose, r.dose, r.value) for r in got.collect()) == sorted(want)


def test_nearest_dose_ties_to_the_lower(spark):
    measured = spark.createDataFrame([("x", 0.1, 1.0), ("x", 10.0, 2.0), ("x", 0.1, 3.0), ("y", 5.0, 4.0)], "drug string, dose double, value double")
    queries = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 1.0)], "drug string, dose double")
    assert sorted((r.drug, r.dose, r.value) for r in K.nearest_dose(queries, measured).collect()) == [("x", 0.1, 1.0), ("x", 0.1, 3.0), ("y", 5.0, 4.0)]


def test_nearest_signature(spark):
    rows = [("x", "c", 1.0, "uM", 24.0, 0.2), ("x", "c", 1000.0, "nM", 24.0, 0.4), ("x", "c", 1.0, "um", 48.0, 0.9), ("x", "c", 1.0, "um", 24.0, -666.0), ("x", "d", 10.0, "um", 24.0, 0.7)]
    df = spark.createDataFrame(rows, "drug string, cell string, pert_dose double, dose_unit string, hours double, value double")
    got = K.nearest_signature(spark.createDataFrame([("x", 1.0)], "drug string, dose double"), df)
    assert {r.cell: r.value for r in got.collect()} == {"c": pytest.approx(0.3), "d": 0.7}


def test_signatures_are_dealt_by_their_number(spark, monkeypatch):
    """100 signatures at ten a task fill ten tasks, whatever the session's number of shuffle partitions is."""
    monkeypatch.setattr(K, "TASK_ROWS", 10)
    rows = [(str(i % 20), "c", 1.0, "uM", 24.0, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "drug string, cell string, pert_dose double, dose_unit string, hours double, value double")
    got = K.nearest_signature(spark.createDataFrame([(str(i), 1.0) for i in range(20)], "drug string, dose double"), df)
    assert got.rdd.getNumPartitions() == 10
    assert {r.drug: r.value for r in got.collect()} == {str(i): i + 40.0 for i in range(20)}


def test_redo_preference(spark):
    rows = [("x", 1, "c", "MTS005", 1.0), ("x", 1, "c", "MTS010", -3.0), ("x", 1, "d", "MTS005", 0.5), ("x", 1, "e", "MTS010", float("nan")), ("x", 1, "e", "MTS005", 2.0)]
    df = spark.createDataFrame(rows, "drug string, dose int, cell string, screen string, value double")
    got = K.median_profiles(K.prefer_redo(df), "drug", "dose", "cell")
    assert {r.cell: r.value for r in got.collect()} == {"c": -3.0, "d": 0.5, "e": 2.0}


def test_export_and_matrix(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("b", [None, float("nan")])], "key string, vector array<double>")
    assert [(r.key, r.vector) for r in K.export_profiles(df).collect()] == [("a", [1.0, 0.0])]
    with pytest.raises(Exception, match="infinite value"):
        K.export_profiles(spark.createDataFrame([("a", [math.inf])], "key string, vector array<double>")).collect()
    wide = spark.createDataFrame([("m2", "0.5", "x", "9", "1"), ("m1", "-2", "x", None, "2")], ["ModelID", "AAA (1)", "BAD", "TP53 (7157)", "TP53 (7158)"])
    assert {r.symbol: r["values"] for r in K.gene_effect_matrix(wide.replace("x", None), "ModelID").collect()} == {"AAA": [-2.0, 0.5], "TP53": [0.0, 9.0]}


def test_descriptions(spark):
    prior = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, text string")
    new = spark.createDataFrame([("b", "x"), ("c", "3")], "key string, text string")
    got = {p: {r.key: (r.text, r.state) for r in K.merge_descriptions(prior, new, p).collect()} for p in ("keep-prior", "replace")}
    assert got["keep-prior"] == {"a": ("1", "kept"), "b": ("2", "kept"), "c": ("3", "new")}
    assert got["replace"]["b"] == ("x", "changed")
    with pytest.raises(Exception, match="conflict: b"):
        K.merge_descriptions(prior, new).collect()
    assert [r.key for r in K.unembedded(prior, new).collect()] == ["c"]


def test_diseases(spark):
    links = spark.createDataFrame([(1, "phenotype", "c1", 0, 10, 1, 1), (1, "phenotype", "c2", 1, 11, 4, 1), (1, "phenotype", "c3", 2, 12, 4, 3), (1, "gene", "c1", 3, 13, 4, 9)], "gene int, type string, cui string, ord int, mim int, confidence int, n_sources int")
    names = spark.createDataFrame([("c1", "one", 0), ("c1", " ", 1), ("c2", "two", 2), ("c2", "TWO", 3)], "cui string, name string, ord int")
    got = K.disease_lists(links, names).first().diseases
    assert [(d.mim, d.name) for d in got] == [(12, None), (11, "TWO"), (10, "one")]


@pytest.mark.parametrize(("raw", "want"), [(" a\t b \n", "a b"), ("-", ""), (None, ""), (" x y", "x y")])
def test_collapse(spark, raw, want):
    assert one(spark, T.collapse(F.col("v")), raw) == want


def test_clean_list(spark):
    assert one(spark, T.clean_list(F.col("v")), ["b", "A ", "-", None, "a", "C  c"], "array<string>") == ["A", "b", "C c"]
    assert one(spark, T.pipe_list(F.col("v")), "x|-| y|X") == ["x", "y"]


def test_keys(spark):
    df = spark.createDataFrame([("drug_1_0.5uM",), ("d_1e-3µM",), ("d_2μM",), ("d_0uM",), ("plain",)], "v string")
    got = [tuple(r) for r in df.select(*T.dose_key(F.col("v"))).collect()]
    assert got == [("drug_1", 0.5), ("d", 0.001), ("d", 2.0), (None, None), (None, None)]
    assert one(spark, T.is_control(F.col("v"), "DMSO"), "DMSO_1uM") and not one(spark, T.is_control(F.col("v"), "DMSO"), "x")
    assert one(spark, T.first_with_prefix(F.col("v"), "Ensembl:"), "HGNC:1|Ensembl:ENSG5|Ensembl:ENSG6") == "ENSG5"
    df = spark.createDataFrame([("ENSG01",), ("SYM_ENSG02",), ("SYM",)], "v string")
    assert [tuple(r) for r in df.select(*T.resolution_keys(F.col("v"))).collect()] == [("ENSG01", None), ("ENSG02", "SYM"), (None, "SYM")]


def test_ladder_and_ages(spark):
    df = spark.createDataFrame([("-",), ("Question",), ("nondisease",), ("somatic",), ("modifier",), ("x",)], "v string")
    assert [r[0] for r in df.select(T.comment_confidence(F.col("v"))).collect()] == [4, 1, 2, 3, 3, 1]
    df = spark.createDataFrame([("12Y6M",), ("1Y",), ("Adult",), ("Age unspecified",), ("3D",)], "v string")
    assert [r[0] for r in df.select(T.age_text(F.col("v"))).collect()] == ["12 years, 6 months", "1 year", "Adult", "", "3 days"]
    with pytest.raises(Exception, match="unknown age"):
        one(spark, T.age_text(F.col("v")), "old")


def test_numbers(spark):
    df = spark.createDataFrame([(1e8,), (1e-7,), (2.5,), (None,)], "v double")
    assert [r[0] for r in df.select(T.number_text(F.col("v"))).collect()] == ["100000000", "1e-07", "2.5", None]


def test_gene_card(spark):
    terms = F.expr("array(named_struct('go_id', 'GO:1', 'term', 't', 'evidence_count', 2))")
    diseases = F.expr("array(named_struct('name', 'd', 'confidence', 4, 'mim', 7))")
    none = F.expr("cast(array() as array<struct<relation:string,members:array<string>>>)")
    got = one(spark, T.gene_text(F.lit("AAA"), {"Process": terms}, diseases, none))
    assert got.startswith("Gene: AAA\n\n=== GO BIOLOGICAL PROCESS ===\n") and "- GO:1: t (evidence: 2)" in got
    assert "- d (confidence: 4, MIM: 7)" in got and got.endswith("relationship type.\nNone")


def test_drug_card(spark):
    got = one(spark, T.drug_text(F.lit("Drug A"), F.lit(10.0), F.lit("drug a"), F.array(*[F.lit(x) for x in ("s1", "S1", "s2")]), {"smiles": F.lit("CC"), "connectivity_smiles": F.lit("CC"), "molecular_weight": F.lit("46.1")}, F.lit("")))
    assert got == "Compound Name: Drug A ;\nSynonyms: s1, s2 ;\nMolecular Weight: 46.1 g/mol ;\nSMILES: CC ;\nDose: 10 micromolar"


def test_windows(spark):
    got = one(spark, T.token_windows(F.col("v"), 4), list(range(9)), "array<int>")
    assert got == [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7], [6, 7, 8]]
    assert one(spark, T.token_windows(F.col("v"), 4), [1, 2], "array<int>") == [[1, 2]]


def test_misc(spark):
    assert one(spark, T.redact(F.col("v")), "u?api_key=abc&q=1&token=zz") == "u?api_key=***&q=1&token=***"
    assert one(spark, R.json_list(F.col("v"), "struct<a:int>"), '[{"a": 1}]')[0].a == 1 and one(spark, R.json_list(F.col("v"), "int"), "oops") == []
    merged = one(spark, R.merged_maps(F.expr("array(map('a', 1, 'b', 2), map('a', 3))")))
    assert merged == {"a": 3, "b": 2}
    assert one(spark, R.canonical_map_hash(F.expr("map('b', 1, 'a', 2)"))) == one(spark, R.canonical_map_hash(F.expr("map('a', 2, 'b', 1)")))


CELL_LINE = {
    "accession-list": [{"type": "primary", "value": "CVCL_0001"}], "name-list": [{"type": "identifier", "value": "HeLa"}, {"type": "synonym", "value": "hela "}, {"type": "synonym", "value": "HELA"}],
    "species-list": [{"label": "Homo sapiens", "accession": "9606"}], "disease-list": [{"label": "Carcinoma", "accession": "C1"}], "age": "30Y6M", "sex": "Female", "category": "Cancer cell line",
    "derived-from-site-list": [{"site": {"site-type": "In situ", "value": "Cervix", "xref-list": [{"database": "UBERON", "accession": "U1"}]}}],
    "sequence-variation-list": [{"variation-type": "Mutation", "mutation-description": "p.X1Y", "zygosity-type": "Heterozygous", "variation-note": "-", "xref-list": [{"label": "TP53"}]}] * 2,
    "xref-list": [{"database": "DepMap", "accession": "ACH-1"}],
}


def test_cell_lines(spark):
    raw = spark.createDataFrame([("hela", json.dumps(CELL_LINE))], "key string, json string")
    entries = R.cell_line_entries(R.parse_cell_lines(raw))
    e = entries.first()
    assert (e.accession, e.name, e.synonyms, e.species, e.depmap, len(e.variations)) == ("CVCL_0001", "HeLa", ["hela"], "Homo sapiens", ["ACH-1"], 1)
    text = R.cell_line_text(entries).first().text
    assert "Age: 30 years, 6 months ;\nDisease: Carcinoma ;\nDerived From Site: Cervix ;\nSequence Variation: TP53: Mutation, p.X1Y (Heterozygous)" in text
    mouse = CELL_LINE | {"species-list": [{"label": "Mus", "accession": "10090"}]}
    with pytest.raises(Exception, match="species of"):
        R.cell_line_entries(R.parse_cell_lines(spark.createDataFrame([("m", json.dumps(mouse))], "key string, json string"))).collect()
