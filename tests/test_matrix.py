import json
import pickle
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.plans import config, runs
from screenloom.sources import matrix as M
from screenloom.sources.shared import shared_folder


def stored(path, parts, layout="rows", n_cols=6):
    """A folder by numpy alone: ``parts`` are dense arrays."""
    told, first = [], 0
    for k, x in enumerate(parts):
        name = f"p{k}"
        if layout == "dense":
            x.astype("<f4").tofile(path / f"{name}.data")
        else:
            row, col = np.nonzero(x)
            np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype("<i8").tofile(path / f"{name}.indptr")
            col.astype("<i4").tofile(path / f"{name}.indices")
            x[row, col].astype("<f4").tofile(path / f"{name}.data")
        told.append({"name": name, "first_row": first, "rows": len(x), "nnz": int((x != 0).sum())})
        first += len(x)
    (path / "manifest.json").write_text(json.dumps({"layout": layout, "n_rows": first, "n_cols": n_cols, "parts": told[::-1]}))


def entries(df):
    return {(r.row, c, v) for r in df.collect() for c, v in zip(r.cols, r.vals, strict=True)}


@pytest.mark.parametrize("layout", ["rows", "dense"])
def test_read_in_ranges_with_filters(spark, tmp_path, layout, monkeypatch):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3, (n, 6)) * (rng.random((n, 6)) < 0.4) for n in (5, 1, 40, 2)]
    parts[3][:] = 0
    stored(tmp_path, parts, layout)
    whole = np.concatenate(parts)
    want = {(int(r), int(c), float(whole[r, c])) for r, c in zip(*np.nonzero(whole), strict=True)}
    for n in (1, 10, 10**6):
        df = M.read_matrix(spark, str(tmp_path), n)
        assert df.count() == 48 and entries(df) == want
    df = M.read_matrix(spark, f"file://{tmp_path}", 30)
    for text, keep in [
        ("row >= 5 AND row < 9", lambda r: 5 <= r < 9), ("row IN (0, 7, 8, 9, 47, 99)", lambda r: r in (0, 7, 8, 9, 47)), ("row = 6", lambda r: r == 6), ("row > 46", lambda r: r > 46), ("row = -1", lambda r: False),
        ("row <= 3 AND row IN (2, 3, 4)", lambda r: r in (2, 3)), ("row % 2 = 1", lambda r: r % 2 == 1), ("row BETWEEN 4 AND 6 AND size(cols) > 0", lambda r: 4 <= r <= 6 and whole[r].any()),
    ]:
        got = df.filter(text)
        assert {r.row for r in got.select("row").collect()} == {r for r in range(48) if keep(r)}, text
        assert entries(got) == {e for e in want if keep(e[0])}, text
    assert "row >= 5" not in df.filter("row >= 5")._jdf.queryExecution().optimizedPlan().toString() or "PushedFilters" in df.filter("row >= 5")._jdf.queryExecution().toString()


def test_plans_touch_what_filters_leave(tmp_path):
    parts = [np.ones((n, 6)) for n in (100, 1, 1, 1, 50)]
    stored(tmp_path, parts)
    reader = M.MatrixReader(str(tmp_path), 60)
    sizes = [[(p["name"], b - a) for p, a, b in x.ranges] for x in reader.partitions()]
    assert sizes[:10] == [[("p0", 10)]] * 10 and sizes[10] == [("p1", 1), ("p2", 1), ("p3", 1)] and sum(n for x in sizes for _, n in x) == 153
    reader.pushFilters
    left = list(reader.pushFilters([M.GreaterThanOrEqual(("row",), 101), M.In(("row",), (3, 102, 103)), M.LessThan(("cols",), 3)]))
    assert len(left) == 1
    assert [[(p["name"], a, b) for p, a, b in x.ranges] for x in reader.partitions()] == [[("p2", 0, 1), ("p3", 0, 1)]] or [[("p2", 0, 1), ("p3", 0, 1)]]
    assert M.spans(np.array([1, 2, 3, 7, 9, 10])) == [(1, 4), (7, 8), (9, 11)] and M.spans(np.array([], dtype=int)) == []


def test_partitions_take_more_values_before_they_become_too_many(tmp_path, monkeypatch):
    """A fixed number of values a partition must not make tasks without end, nor a task carry the list of all parts."""
    parts = [{"name": f"p{k}", "first_row": 40 * k, "rows": 40, "nnz": 150} for k in range(30_000)]
    got = M.planned(parts, 0, 1_200_000, 200)
    assert M.MOST_PARTITIONS <= len(got) <= 2 * M.MOST_PARTITIONS
    covered = [(p["first_row"] + a, p["first_row"] + b) for x in got for p, a, b in x]
    assert covered[0][0] == 0 and covered[-1][1] == 1_200_000 and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))
    assert len(M.planned(parts, 80, 160, 200)) == 2  # few rows are wanted: partitions stay small
    monkeypatch.setattr(M, "ENTRIES", 1000)  # never beyond the usual size
    assert len(M.planned(parts, 0, 1_200_000, 200)) == 5000
    (tmp_path / "manifest.json").write_text(json.dumps({"layout": "rows", "n_rows": 1_200_000, "n_cols": 6, "parts": parts}))
    reader = M.MatrixReader(str(tmp_path), 200)
    assert len(pickle.dumps(reader)) < 1000 and pickle.loads(pickle.dumps(reader)).manifest["n_cols"] == 6 and len(reader.manifest["parts"]) == 30_000


def test_parts_are_known_by_the_row_alone(spark, tmp_path):
    """Each part has its rows exactly, however many a task writes, and rows are neither sampled nor written again for it."""
    rows = spark.range(0, 1003).select((1002 - F.col("id")).alias("row"), F.array((F.col("id") % 5).cast("int")).alias("cols"), F.array(F.lit(1.0).cast("float")).alias("vals")).repartition(7)
    before = set(Path(shared_folder(spark).removeprefix("file:")).iterdir())
    told = M.write_matrix(rows, str(tmp_path / "m"), 5, part_rows=100)
    assert [(p["first_row"], p["rows"], p["nnz"]) for p in told["parts"]] == [(100 * k, min(100, 1003 - 100 * k), min(100, 1003 - 100 * k)) for k in range(11)]
    assert set(Path(shared_folder(spark).removeprefix("file:")).iterdir()) == before
    assert entries(M.read_matrix(spark, str(tmp_path / "m"))) == {(1002 - i, i % 5, 1.0) for i in range(1003)}


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"layout": "columns", "n_rows": 1, "n_cols": 1, "parts": []}))
    with pytest.raises(ValueError, match="column-major"):
        M.read_matrix(spark, str(tmp_path))
    short = tmp_path / "short"
    short.mkdir()
    stored(short, [np.ones((3, 6))])
    (short / "p0.data").write_bytes(b"abcd")
    with pytest.raises(Exception, match="ends before entry"):
        M.read_matrix(spark, str(short)).collect()
    bad = tmp_path / "bad"
    bad.mkdir()
    stored(bad, [np.ones((3, 6))], n_cols=2)
    with pytest.raises(Exception, match="out of order"):
        M.read_matrix(spark, str(bad)).collect()


@pytest.mark.parametrize("layout", ["rows", "dense"])
def test_written_screens_read_back(spark, tmp_path, layout):
    rng = random.Random(2)
    cells = [(i * 3, "c", rng.choice(["a", "b"])) for i in range(25)]
    counts = [(i, f"g{g}", float(rng.randint(1, 9))) for i, _, _ in cells[1:] for g in rng.sample(range(7), rng.randint(0, 5))]
    c = spark.createDataFrame(cells, "cell_id long, context string, pert string").repartition(3)
    k = spark.createDataFrame(counts, "cell_id long, gene string, value double").repartition(4)
    genes = spark.createDataFrame([(f"g{g}", 6 - g) for g in range(7)], "gene string, col int")
    path = str(tmp_path / "m")
    told = M.write_screen(c, k, genes, path, layout, part_rows=4)
    assert told["n_rows"] == 25 and len(told["parts"]) > 3
    got_cells, got_counts, got_genes = M.read_screen(spark, path)
    assert {(r.cell_id * 3, r.context, r.pert) for r in got_cells.collect()} == set(cells)
    assert sorted((r.cell_id * 3, r.gene, r.value) for r in got_counts.collect()) == sorted(counts)
    assert {(r.gene, r.pos) for r in got_genes.collect()} == {(f"g{g}", 6 - g) for g in range(7)}
    with pytest.raises(Exception, match="without gaps"):
        M.write_matrix(M.read_matrix(spark, path).filter("row <> 7"), str(tmp_path / "gap"), 7)


def test_process_takes_a_matrix_folder(spark, tmp_path):
    rows = [("c", "non-targeting", {"g1": 10, "g2": 4})] * 3 + [("c", "g1", {"g1": 1, "g2": 6})] * 3 + [("c", "g2", {"g1": 9, "g2": 5})] * 2
    cells = spark.createDataFrame([(i, c, p) for i, (c, p, _) in enumerate(rows)], "cell_id long, context string, pert string")
    counts = spark.createDataFrame([(i, g, float(v)) for i, (_, _, x) in enumerate(rows) for g, v in x.items()], "cell_id long, gene string, value float")
    genes = spark.createDataFrame([("g1", 0), ("g2", 1)], "gene string, col int")
    M.write_screen(cells, counts, genes, str(tmp_path / "m"))
    cells.write.parquet(f"{tmp_path}/t/cells")
    counts.write.parquet(f"{tmp_path}/t/counts")
    got = []
    for source in ("m", "t"):
        values = {"input": f"{tmp_path}/{source}", "effects": {"enabled": True, "output": f"{tmp_path}/e{source}"}}
        runs.run_process(spark, config.strict(config.Process, values))
        got.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/e{source}").collect())))
    assert got[0] == got[1] and got[0]
