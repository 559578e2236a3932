import json
import random

import pytest

from screenloom.functions import variants
from screenloom.functions.variants import cell_line_parts
from screenloom.operators import evidence as E
from screenloom.plans import evidence_store as S


def clean(v):
    if v is None or isinstance(v, (dict, list)):
        return ""
    v = str(v).strip()
    return "" if v == "-" else v


def reference(*holders):
    for h in holders:
        h = h if isinstance(h, dict) else {}
        told = clean(h.get("database")), clean(h.get("accession"))
        if any(told):
            return told
    return "", ""


def first_of(h):
    xs = h.get("xref-list") if isinstance(h, dict) else None
    return xs[0] if isinstance(xs, list) and xs else None


def nested(v):
    return (clean(v.get("label")) or clean(v.get("value"))) if isinstance(v, dict) else clean(v)


def dicts(v):
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def distinct(rows):
    seen = {}
    for r in rows:
        if any(r):
            seen.setdefault(tuple(x.lower() for x in r), r)
    return sorted(seen.values(), key=lambda r: tuple((x.lower(), x) for x in r))


def expected(record):
    kinds = record.get("cell-type-list")
    item = kinds[0] if isinstance(kinds, list) and kinds else record.get("cell-type")
    cell = (clean(item.get("label")) or clean(item.get("value")), *reference(first_of(item), item.get("xref"))) if isinstance(item, dict) else ("", "", "")
    value = lambda v: clean(v.get("value")) if isinstance(v, dict) else clean(v)
    parents = [(value(p.get("name")), value(p.get("accession"))) for p in dicts(record.get("parent-list")) if clean(p.get("type")).lower() == "derived-from"]
    parents += [(clean(p.get("label")), clean(p.get("accession"))) for p in dicts(record.get("derived-from"))]
    made = [
        (nested(i.get("method")), clean(i.get("label")) or nested(i.get("target")) or nested(i.get("xref")), *reference(i.get("xref"), first_of(i.get("target")), i))
        for i in dicts(record.get("genetic-integration-list"))
    ]
    made += [("", clean(c.get("value")), "", "") for c in dicts(record.get("comment-list")) if clean(c.get("category")).lower() == "genetic integration"]
    return cell, distinct(parents), distinct(made)


def test_parts_of_both_encodings(spark):
    """Random records that mix the encodings, with nulls, dashes, numbers and wrong kinds in any place."""
    rng = random.Random(7)
    words = ["Stem", "stem", " T cell ", "-", "", None, 5, "Kidney", "HGNC", "Derived-From", "derived-from", "Genetic integration", "other"]
    word = lambda: rng.choice(words)
    xref = lambda: rng.choice([{"database": word(), "accession": word()}, {"label": word()}, None, "x", {}])
    thing = lambda: rng.choice([word(), {"label": word(), "value": word()}, {"value": word(), "xref-list": rng.choice([[xref()], [], None])}, [1]])
    item = lambda: rng.choice([
        {"label": word(), "value": word(), "xref": xref(), "xref-list": rng.choice([[xref(), xref()], [], "no"])}, {"type": word(), "name": thing(), "accession": thing()},
        {"method": thing(), "label": word(), "target": thing(), "xref": xref(), "database": word(), "accession": word()}, {"category": word(), "value": word()}, None, "text", 3,
    ])
    lists = ["cell-type-list", "parent-list", "derived-from", "genetic-integration-list", "comment-list"]
    records = [{n: rng.choice([[item() for _ in range(rng.randint(0, 4))], None, {}]) for n in lists if rng.random() < 0.8} | ({"cell-type": item()} if rng.random() < 0.6 else {}) for _ in range(300)]
    rows = [(str(i), json.dumps(r)) for i, r in enumerate(records)] + [("bad", "{no"), ("none", None), ("list", "[1]")]
    got = {r.key: r for r in cell_line_parts(spark.createDataFrame(rows, "key string, json string")).collect()}
    for i, record in enumerate(records):
        r = got[str(i)]
        assert (tuple(r.cell_type), [tuple(p) for p in r.parents], [tuple(x) for x in r.integrations]) == expected(record), record
    for k in ("bad", "none", "list"):
        assert (tuple(got[k].cell_type), got[k].parents, got[k].integrations, got[k].integration_text) == (("", "", ""), [], [], "")


def test_integration_text(spark):
    record = {"genetic-integration-list": [{"method": {"label": "Transfection"}, "target": {"value": "SV40"}}, {"method": "CRISPR"}], "comment-list": [{"category": "GENETIC INTEGRATION", "value": "GFP"}]}
    got = cell_line_parts(spark.createDataFrame([("a", json.dumps(record))], "key string, json string")).first()
    assert got.integration_text == "CRISPR, GFP, SV40 via Transfection"


def test_records_are_dealt_by_their_number(spark, monkeypatch):
    """40 small records of one file fill four tasks of ten."""
    monkeypatch.setattr(variants, "TASK_RECORDS", 10)
    records = spark.createDataFrame([(i, json.dumps({"cell-type": {"label": f"t{i}"}})) for i in range(40)], "key int, json string").coalesce(1)
    got = cell_line_parts(records)
    assert got.rdd.getNumPartitions() == 4
    assert {r.key: r.cell_type.name for r in got.select("key", "cell_type").collect()} == {i: f"t{i}" for i in range(40)}


def rows_of(spark, dataset, seed):
    rng = random.Random(seed)
    rows = [(dataset, f"c{c}", f"p{p}", f"g{g}", rng.choice([0.0, 0.5, 2.0, 8.0]), rng.random() / 5, rng.random() < 0.8, rng.randint(-8, 8) / 4) for c in range(2) for p in range(4) for g in range(5)]
    return spark.createDataFrame(rows, "dataset string, context string, pert string, gene string, fold_change double, fdr double, tested boolean, delta double")


def test_a_refresh_reads_changed_datasets_only(spark, tmp_path):
    path, read = str(tmp_path / "store"), []

    def source(name, seed):
        def rows():
            read.append(name)
            return rows_of(spark, name, seed)

        return S.Source(f"{name}:{seed}", rows)

    def check(seeds):
        whole = E.contributions(spark.createDataFrame([r for n, s in seeds.items() for r in rows_of(spark, n, s).collect()], rows_of(spark, "x", 0).schema), clip=1.5)
        for got, keys in ((S.donor_totals, ("pert", "gene")), (S.dataset_totals, ("dataset", "pert", "gene")), (S.context_totals, ("dataset", "context", "gene"))):
            want = {tuple(r[k] for k in keys): [r[s] for s in E.STATS] for r in E.totals(whole, *keys).collect()}
            found = {tuple(r[k] for k in keys): [r[s] for s in E.STATS] for r in got(spark, path).collect()}
            assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)

    with pytest.raises(FileNotFoundError):
        S.donor_totals(spark, path)
    first = {"a": 1, "b": 2, "c": 3}
    assert S.refresh(spark, path, {n: source(n, s) for n, s in first.items()}, clip=1.5)["built"] == ["a", "b", "c"]
    check(first)
    read.clear()
    second = {"a": 1, "b": 9, "d": 4}  # one replaced, one added, one dropped
    told = S.refresh(spark, path, {n: source(n, s) for n, s in second.items()}, clip=1.5)
    assert told == {"built": ["b", "d"], "kept": ["a"], "dropped": ["c"]} and read == ["b", "d"]
    check(second)
    read.clear()
    assert S.refresh(spark, path, {n: source(n, s) for n, s in second.items()}, clip=1.5)["built"] == [] and read == []
    assert sorted(p.split("/")[-2] for p in S.unused(spark, path)) == ["b", "c"]
    assert S.refresh(spark, path, {"a": source("a", 1)}, clip=2.0)["built"] == ["a"]  # sums depend on the clip
