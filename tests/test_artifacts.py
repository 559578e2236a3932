import threading

import pytest
from pyspark.sql import functions as F

from screenloom.sources import sinks


def frames(spark, n):
    return {"a": spark.range(n).withColumn("x", F.col("id") * 2), "b": spark.range(n).select(F.lit(n).alias("n"), F.create_map(F.lit("k"), F.col("id")).alias("m"))}


def test_readers_see_one_generation_through_an_overwrite(spark, tmp_path):
    path = str(tmp_path / "art")
    sinks.write_artifact(frames(spark, 5), {"version": 1}, path, inputs={"split": "s"})
    held = sinks.artifact_tables(spark, path)
    with pytest.raises(FileExistsError):
        sinks.write_artifact(frames(spark, 7), {"version": 1}, path)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            tables = sinks.artifact_tables(spark, path)
            seen.append((tables["a"].count(), tables["b"].agg(F.max("n")).first()[0]))

    reader = threading.Thread(target=read)
    reader.start()
    for n in (7, 9):
        sinks.write_artifact(frames(spark, n), {"version": 1}, path, overwrite=True)
    stop.set()
    reader.join()
    assert seen and set(seen) <= {(5, 5), (7, 7), (9, 9)}  # never a mix of two generations
    assert held["a"].count() == 5
    assert sinks.read_artifact(spark, path, ("a",), 1)[0]["a"].count() == 9
    with pytest.raises(ValueError, match="version 1 instead of 2"):
        sinks.read_artifact(spark, path, (), 2)


def test_a_failed_write_is_never_seen(spark, tmp_path):
    path = str(tmp_path / "art")
    broken = {"a": spark.range(3), "b": spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))}
    with pytest.raises(Exception, match="no"):
        sinks.write_artifact(broken, {}, path)
    assert sinks.latest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        sinks.artifact_tables(spark, path)
    first = sinks.write_artifact(frames(spark, 2), {"version": 1}, path)
    with pytest.raises(Exception, match="no"):
        sinks.write_artifact(broken, {}, path, overwrite=True)
    assert sinks.latest(spark, path) == first
    second = sinks.write_artifact(frames(spark, 4), {"version": 1}, path, overwrite=True)
    (tmp_path / "art/manifest/99999999.json").write_text('{"number": 99')  # another writer, not done yet
    assert sinks.latest(spark, path) == second
    (tmp_path / "art/manifest/99999999.json").unlink()
    assert len(sinks.expire(spark, path)) == 3 and sinks.artifact_tables(spark, path)["a"].count() == 4


def test_records_hold_rows_and_an_order_free_digest(spark, tmp_path):
    path = str(tmp_path / "art")
    told = sinks.write_artifact(frames(spark, 50) | {"none": spark.range(0)}, {"version": 1}, path, inputs={"file": "abc"})
    again = sinks.write_artifact({n: df.repartition(7).orderBy(F.rand(1)) for n, df in frames(spark, 50).items()}, {"version": 1}, path, overwrite=True)
    assert told["inputs"] == {"file": "abc"} and told["tables"]["a"]["rows"] == 50 and told["tables"]["none"] == {"rows": 0, "digest": "0", "schema": "struct<id:bigint>"}
    assert {n: again["tables"][n] for n in ("a", "b")} == {n: told["tables"][n] for n in ("a", "b")}
    assert sinks.changed_tables(spark, path) == [] and sinks.changed_tables(spark, path, told) == []
    spark.range(1).withColumn("x", F.lit(0).cast("long")).write.mode("append").parquet(f"{path}/{again['folder']}/a")
    assert sinks.changed_tables(spark, path) == ["a"]
