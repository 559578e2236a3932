"""Commands end to end on small tables, settings, registry, and every registered query against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

from screenloom.plans import config, oracles, queries, runs, tools
from screenloom.sources import readers, sinks
from screenloom.streaming.labels import current_labels, follow_labels

DATA = "/root/testdata/sf0.001"


def test_compose_and_strict():
    base = {"input": "x", "filter": {"enabled": True, "output": "y"}}
    cfg = config.strict(config.Process, config.compose(base, [{"filter": {"min_cells": 3}}], ["filter.min_cells=5", "input=z"]))
    assert cfg.input == "z" and cfg.filter.min_cells == 5 and base["filter"] == {"enabled": True, "output": "y"}
    for bad in (["nope=1"], ["filter.nope=1"], ["filter"]):
        with pytest.raises(ValueError):
            config.compose(base, (), bad)
    for values in ({"input": 3}, {"input": "x", "oops": 1}, {}, {"input": "x"}, {"input": "x", "filter": {"enabled": True}}):
        with pytest.raises(ValueError):
            config.strict(config.Process, values)


def test_registry():
    build = lambda s, t: None
    r = tools.Registry([tools.Tool("a", build), tools.Tool("c", build, ("b",)), tools.Tool("b", build, ("a",)), tools.Tool("d", build)])
    assert r.order(["c"]) == ["a", "b", "c"] and r.order(["d", "c"], with_needs=False) == ["c", "d"]
    with pytest.raises(KeyError):
        r.order(["zz"])
    with pytest.raises(ValueError, match="need each other"):
        tools.Registry([tools.Tool("a", build, ("b",)), tools.Tool("b", build, ("a",))]).order(["a"])


def test_build_and_verify(spark, tmp_path):
    vectors = [("GA", [1.0, 0.0]), ("GB", [0.0, 1.0])]
    first = tools.Tool("first", lambda s, t: s.createDataFrame(vectors, "key string, vector array<float>"))
    second = tools.Tool("second", lambda s, t: t["first"].filter("key = 'GA'"), ("first",))
    registry = tools.Registry([second, first])
    paths = registry.build(spark, ["second"], str(tmp_path / "s"))
    assert list(paths) == ["first", "second"] and readers.read_vectors(spark, paths["second"], 2).count() == 1
    with pytest.raises(FileExistsError):
        registry.build(spark, ["first"], str(tmp_path / "s"))
    with pytest.raises(ValueError, match="width 3"):
        readers.read_vectors(spark, paths["first"], 3)
    sources = {n: spark.read.parquet(p) for n, p in paths.items()}
    keys = spark.createDataFrame([("GA",), ("OLD",)], "key string")
    aliases = spark.createDataFrame([("second", "OLD", "GB"), ("first", "OLD", "GB")], "source string, key string, target string")
    found = tools.verify(sources, dict.fromkeys(sources, keys), aliases, {"first": sources["first"]})
    assert found["first.coverage"].first().alias == 1 and found["second.coverage"].first().missing == 1
    assert found["first.reference"].first().n_equal == 2


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    rows = [("c", "non-targeting", {"g1": 10, "g2": 4})] * 3 + [("c", "g1", {"g1": 1, "g2": 6})] * 3 + [("c", "g2", {"g1": 9, "g2": 5})] * 2
    path = str(tmp_path_factory.mktemp("m") / "m")
    spark.createDataFrame([(i, c, p) for i, (c, p, _) in enumerate(rows)], "cell_id long, context string, pert string").write.parquet(f"{path}/cells")
    counts = [(i, g, float(v)) for i, (_, _, x) in enumerate(rows) for g, v in x.items()]
    spark.createDataFrame(counts, "cell_id long, gene string, value float").write.parquet(f"{path}/counts")
    return path


def test_process(spark, matrix, tmp_path):
    values = {"input": matrix, "filter": {"enabled": True, "output": f"{tmp_path}/f", "min_cells": 2}, "normalize": {"enabled": True, "output": f"{tmp_path}/n"}, "effects": {"enabled": True, "output": f"{tmp_path}/e"}}
    cfg = config.strict(config.Process, values)
    assert set(runs.run_process(spark, cfg)) == {"filter", "normalize", "effects"}
    tables, meta = sinks.read_artifact(spark, f"{tmp_path}/f", ("cells", "dropped"), runs.VERSION)
    assert tables["cells"].count() == 6 and [r.pert for r in tables["dropped"].collect()] == ["g2"] and meta["min_cells"] == 2
    assert {r.target for r in spark.read.parquet(f"{tmp_path}/e").collect()} == {"g1"}
    with pytest.raises(FileExistsError):
        runs.run_process(spark, cfg)


def test_prep_statistics_and_eval(spark, matrix, tmp_path):
    labels = [("C", "g1", "g1", 0.01, 0.1), ("C", "g1", "g2", 0.2, 1.5), ("C", "g1", "gx", 0.2, 1.5), ("C", "g2", "g2", 0.04, 2.0), ("C", "g2", "g2", 0.03, 4.0)]
    spark.createDataFrame(labels, "cell string, target string, feature string, q double, fc double").coalesce(1).write.option("header", True).csv(f"{tmp_path}/labels.csv")
    table = {"columns": {"context": "cell", "pert": "target", "gene": "feature", "fdr": "q", "fold_change": "fc"}, "lower": True}
    cfg = config.strict(config.Prep, {"name": "d", "matrix": matrix, "output": f"{tmp_path}/d", "labels": f"{tmp_path}/labels.csv", "table": table})
    runs.run_prep(spark, cfg)
    tables = sinks.artifact_tables(spark, f"{tmp_path}/d")
    cond = tables["cond_gene"]
    got = {(r.pert, r.gene): (r.fold_change, r.tested, r.delta_p) for r in cond.collect()}
    assert got[("g2", "g2")] == (4.0, True, 1.0) and got[("g2", "g1")] == (0.0, False, -1.0) and len(got) == 4
    stats = runs.fit_statistics(spark, [f"{tmp_path}/d"], '{"d.c": ["g1"]}', config.Statistics(), f"{tmp_path}/cache")
    assert sinks.artifact_tables(spark, stats)["global"].count() == 2
    assert runs.fit_statistics(spark, [f"{tmp_path}/d"], '{"d.c": ["g1"]}', config.Statistics(), f"{tmp_path}/cache") == stats
    forbidden = spark.createDataFrame([("d", "c", "g1")], "dataset string, context string, pert string")
    with pytest.raises(ValueError, match="leak"):
        runs.fit_statistics(spark, [f"{tmp_path}/d"], '{"d.c": ["g1"]}', config.Statistics(), f"{tmp_path}/cache", forbidden)
    with pytest.raises(ValueError, match="unresolved"):
        runs.fit_statistics(spark, [f"{tmp_path}/d"], '{"d.c": ["zz"]}', config.Statistics(), f"{tmp_path}/cache")

    def model(frame):
        return frame.assign(row=0, p_de=0.9, lfc_pred=1.0, delta_pred=0.5)[["dataset", "context", "pert", "row", "gene", "p_de", "lfc_pred", "delta_pred"]]

    schema = "dataset string, context string, pert string, row int, gene string, p_de double, lfc_pred double, delta_pred double"
    pred = runs.predict(cond.select("dataset", "context", "pert", "gene"), model, schema)
    total = runs.run_eval(pred, cond, tables["ctrl_means"], f"{tmp_path}/eval").first()
    assert total.direction_match == 0.5 and os.path.isdir(f"{tmp_path}/eval/granular")
    axis = tables["axis"]
    runs.run_infer(pred, axis, f"{tmp_path}/infer")
    assert [len(r.p_de) for r in sinks.artifact_tables(spark, f"{tmp_path}/infer")["predictions"].collect()] == [2, 2]


def test_controls_only(spark, matrix, tmp_path):
    cfg = config.strict(config.Prep, {"name": "d", "matrix": matrix, "output": f"{tmp_path}/d", "controls_only": True})
    runs.run_prep(spark, cfg)
    assert {r.gene: r.value for r in sinks.artifact_tables(spark, f"{tmp_path}/d")["ctrl_means"].collect()} == {"g1": 10, "g2": 4}


def test_embedding_runs_once_per_text(spark):
    values = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "yy")], "key string, text string")
    got = {r.key: r.vector for r in runs.embed_distinct(values, lambda t: [[float(len(x))] for x in t]).collect()}
    assert got == {"a": [1.0], "b": [1.0], "d": [2.0]}


def test_readers(spark, tmp_path):
    (tmp_path / "genes.txt").write_text("A\n\n B \nC\n")
    assert [(r.gene) for r in readers.read_gene_list(spark, str(tmp_path / "genes.txt")).orderBy("pos").collect()] == ["A", "B", "C"]
    (tmp_path / "twice.txt").write_text("A\nA\n")
    with pytest.raises(ValueError, match="listed twice"):
        readers.read_gene_list(spark, str(tmp_path / "twice.txt"))
    (tmp_path / "info.tsv").write_text("#tax_id\tSymbol\ttype_of_gene\n9606\tAAA\tprotein-coding\n10090\tBBB\tprotein-coding\n9606\tPPP\tpseudo\n")
    rows = readers.protein_coding(readers.read_taxon(spark, str(tmp_path / "info.tsv")))
    assert [r.Symbol for r in rows.collect()] == ["AAA"]
    hashes = readers.file_hashes(spark, str(tmp_path / "*.txt"))
    assert hashes.count() == 2 and len(readers.tree_hash(hashes).first().sha256) == 64
    ctx = tmp_path / "K562"
    ctx.mkdir()
    spark.createDataFrame([("p", "g", 0.1, 2.0)], "pert string, gene string, fdr double, fc double").coalesce(1).write.parquet(str(ctx / "t"))
    roles = {"pert": "pert", "gene": "gene", "fdr": "fdr", "fold_change": "fc"}
    assert readers.read_labels(spark, str(ctx / "t"), roles, "parent").first().context == "t"
    with pytest.raises(ValueError, match="context column"):
        readers.read_labels(spark, str(ctx / "t"), roles, "column")


def test_labels_as_a_stream(spark, tmp_path):
    schema = "context string, pert string, gene string, fold_change double, ord long"
    src = str(tmp_path / "in")
    for rows in ([("c", "p", "g", 1.0, 1), ("c", "p", "h", 5.0, 1)], [("c", "p", "g", 2.0, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        follow_labels(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.gene: r.fold_change for r in current_labels(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"g": 2.0, "h": 5.0}


def canonical(rows, columns):
    out = []
    for r in rows:
        values = []
        for c in columns:
            v = r[c]
            values.append(None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
        out.append(tuple(values))
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.execute(oracles.ORACLE_SQL[name])
    columns = sorted(d[0] for d in rel.description)
    want = [dict(zip([d[0] for d in rel.description], r, strict=True)) for r in rel.fetchall()]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert canonical([r.asDict() for r in df.collect()], columns) == canonical(want, columns)
