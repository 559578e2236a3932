"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "pseudobulk_delta" in queries
    assert all(callable(q) for q in queries.values())


def test_the_rest_does_not_import_the_text_operators():
    root = os.path.join(os.path.dirname(entry.__file__), "screenloom")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "screenloom.llm" not in f.read(), name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["context", "pert", "gene", "mean", "control_mean", "delta"] and df.count() > 0
