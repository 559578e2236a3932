import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.operators import labels as L
from screenloom.plans import builders as B


def table(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return str(path)


def model():
    def embed(texts):  # a function of its own, so that workers get it by value
        return [[float(len(t)), float(t.count("A"))] for t in texts]

    return embed


def test_models_see_each_text_once(spark, tmp_path):
    drugs = table(spark, [("d1", "CCO"), ("d2", " CCO "), ("d3", "-"), ("d4", None)], "key string, smiles string", tmp_path / "d")
    assert {r.key: r.vector for r in B.structure_vectors(spark, drugs, model()).collect()} == {"d1": [3, 0], "d2": [3, 0]}
    text = "ACDA" * 5 + "AC"
    proteins = table(spark, [("long", text), ("short", "mak"), ("odd", "AC1")], "key string, sequence string", tmp_path / "p")
    got = {r.key: r.vector for r in B.sequence_vectors(spark, proteins, model(), size=8).collect()}
    windows = [text[i : i + 8] for i in range(0, 17, 4)]
    assert got.keys() == {"long", "short"} and got["short"] == [3, 1]
    assert got["long"] == pytest.approx(np.mean(model()(windows), axis=0))


def test_gene_texts_and_their_vectors(spark, tmp_path):
    (tmp_path / "info.tsv").write_text("#tax_id\tSymbol\ttype_of_gene\tdescription\n9606\tAAA\tprotein-coding\tfull A\n9606\tBBB\tprotein-coding\t-\n9606\tPPP\tpseudo\tx\n10090\tMMM\tprotein-coding\tx\n")
    (tmp_path / "sum.csv").write_text("Symbol,summary\nAAA,a  long summary\nBBB,\n")
    inputs = {"gene_texts": (str(tmp_path / "info.tsv"), str(tmp_path / "sum.csv"))}
    registry = B.local_registry(inputs, {"gene_vectors": model()})
    paths = registry.build(spark, ["gene_vectors"], str(tmp_path / "out"))
    assert {r.key: r.text for r in spark.read.parquet(paths["gene_texts"]).collect()} == {"AAA": "a long summary", "BBB": ""}
    assert {r.key for r in spark.read.parquet(paths["gene_vectors"]).collect()} == {"AAA"}
    assert {r.key: r.text for r in B.gene_texts(spark, inputs["gene_texts"][0]).collect()} == {"AAA": "full A", "BBB": ""}


def test_sources_are_checked_before_they_are_written(spark, tmp_path):
    wells = table(spark, [("a", "f1", 1.0), ("a", "f1", 3.0), ("a", "f2", None), ("b", "f2", float("nan")), ("c", "f2", 5.0)], "key string, feature string, value double", tmp_path / "w")
    got = {r.key: r.vector for r in B.morphology_profiles(spark, wells).collect()}
    assert got == {"a": [2.0, 0.0], "c": [0.0, 5.0]}
    bad = spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0]), (" ", [1.0]), ("n", [float("nan")]), ("x", None)], "key string, vector array<float>")
    assert {n: df.count() for n, df in B.source_problems(bad).items()} == {"blank key": 1, "repeated key": 1, "value that is none": 2, "several lengths": 1}
    twice = table(spark, [("1", "n", 0, [1.0]), ("2", "n", 1, [1.0, 2.0]), ("3", "m", 2, [1.0, 2.0])], "protein string, name string, pos long, vector array<float>", tmp_path / "v")
    (tmp_path / "names.tsv").write_text("#string_protein_id\tpreferred_name\n1\tn\n2\tn\n3\tm\n")
    with pytest.raises(ValueError, match="several lengths"):
        B.local_registry({"network_space": (twice, str(tmp_path / "names.tsv"))}).build(spark, ["network_space"], str(tmp_path / "o"))
    with pytest.raises(KeyError, match="unknown sources"):
        B.local_registry({"nothing": ()})
    with pytest.raises(ValueError, match="no model"):
        B.local_registry({"structure_vectors": ("x",)})


def test_sources_are_built_once(spark, tmp_path, monkeypatch):
    """The checks of a source and its copy read what was built; none builds it again."""
    built = spark.sparkContext.accumulator(0)

    def key(i):
        built.add(1)
        return f"k{i}"

    table = spark.range(6).select(F.udf(key)("id").alias("key"), F.array(F.lit(1.0)).cast("array<float>").alias("vector"))
    monkeypatch.setattr(B, "morphology_profiles", lambda spark, path: table)
    paths = B.local_registry({"morphology_profiles": ("x",)}).build(spark, ["morphology_profiles"], str(tmp_path / "out"))
    assert spark.read.parquet(paths["morphology_profiles"]).count() == 6 and built.value == 6


def test_gene_effect_columns(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id,A B (12),X (3),X (4),plain\nm2,1.5,,9,0\nm1,2.5,4,9,0\n")
    got = {r.key: r.vector for r in B.gene_effects(spark, str(tmp_path / "w.csv")).collect()}
    assert got == {"A B": [2.5, 1.5], "X": [4.0, 0.0]}


def test_cell_metadata(spark):
    cells = spark.createDataFrame([(1, "K", "[('x', 0.5, 'uM')]"), (2, "L", "plain")], "cell_id long, context string, pert string")
    got = {r.cell_id: (r.context, r.pert) for r in L.normalize_cells(cells, "f", {"K": "k", "L": "l"}, drug_dose=True).collect()}
    assert got == {1: ("k", "x_0.5uM"), 2: ("l", "plain")}
    numbers = spark.createDataFrame([(1, 5, 7)], "cell_id long, context int, pert int")
    assert L.normalize_cells(numbers, "f").first()[1:] == ("5", "7")
    for rows, match in (([(1, "Z", "a")], "f: context not in the map: Z"), ([(1, None, "a")], "f: context not in the map: null"), ([(1, "K", None)], "f: no perturbation"), ([(1, "K", "[('x'")], "malformed dose")):
        with pytest.raises(Exception, match=match.replace("(", "\\(")):
            L.normalize_cells(spark.createDataFrame(rows, "cell_id long, context string, pert string"), "f", {"K": "k"}, drug_dose=True).collect()
