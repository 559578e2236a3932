"""Sinks: tables that refuse to overwrite, prediction lists, artifacts of several tables with their records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition: tuple[str, ...] = ()) -> None:
    """Parquet through the committer, so readers see all or nothing; an existing target is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition).parquet(path)


def write_metrics(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def prediction_lists(pred: DataFrame, axis: DataFrame) -> DataFrame:
    """(dataset, context, pert, row, p_de, lfc_pred, delta_p_pred): one row per condition, values in axis order."""
    placed = pred.join(axis.select("gene", "pos"), "gene")
    entry = F.struct("pos", *[F.col(c).cast("float").alias(c) for c in ("p_de", "lfc_pred", "delta_pred")])
    rows = placed.groupBy("dataset", "context", "pert", "row").agg(F.array_sort(F.collect_list(entry)).alias("v"))

    def values(c: str) -> Column:
        return F.transform("v", lambda x: x[c])

    lists = {"p_de": "p_de", "lfc_pred": "lfc_pred", "delta_p_pred": "delta_pred"}
    return rows.select("dataset", "context", "pert", "row", *[values(c).alias(n) for n, c in lists.items()])


# --- artifacts: several tables that are published as one ----------------------------------------------
#
# An artifact is a folder of generations and manifests. ``gen/N-id`` holds the tables of one write, ``manifest/N.json`` says that
# it is whole, with each table's rows and digest, its inputs and settings. The manifest comes last and is created once: readers that hold
# an older generation keep it, a write that breaks off is never seen, and of two writers that race for one number the second fails.


def _files(spark: SparkSession, path: str) -> tuple[object, Callable[[str], object]]:
    """The file system that Spark resolves for a path, and its paths."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system Spark resolves for it."""
    fs, to_path = _files(spark, path)
    return fs.exists(to_path(path))


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, ascending; none if it isn't there."""
    fs, to_path = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(to_path(path))) if fs.exists(to_path(path)) else []


def digest(df: DataFrame) -> Column:
    """An order-free digest of all rows: the sum of their hashes; nested maps count by their JSON."""
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.coalesce(F.sum(F.xxhash64(*plain).cast("decimal(38,0)")), F.lit(0)).cast("string")


def write_observed(df: DataFrame, path: str) -> dict[str, object]:
    """Write a new table; its rows and digest, gathered by the tasks that write it, with no second pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), digest(df).alias("digest")).write.parquet(path)
    told = seen.get
    return {"rows": told.get("rows", 0), "digest": told.get("digest", "0"), "schema": df.schema.simpleString()}


def latest(spark: SparkSession, path: str) -> dict | None:
    """The newest whole manifest of an artifact."""
    fs, to_path = _files(spark, path)
    for name in reversed([n for n in listed(spark, f"{path}/manifest") if n.endswith(".json")]):
        stream = fs.open(to_path(f"{path}/manifest/{name}"))
        try:
            return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        except ValueError:  # its writer is not done
            continue
        finally:
            stream.close()
    return None


def write_artifact(tables: Mapping[str, DataFrame], meta: Mapping[str, object], path: str, overwrite: bool = False, inputs: Mapping[str, object] | None = None) -> dict:
    """Publish several tables as one generation; the manifest, which names ``inputs`` and each table's rows and digest.

    With ``overwrite`` an artifact that is there gets a further generation; old ones stay until ``expire``.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    last = latest(spark, path)
    if last is not None and not overwrite:
        raise FileExistsError(f"set overwrite to replace {path}")
    taken = [int(n.split("-")[0].split(".")[0]) for folder in ("gen", "manifest") for n in listed(spark, f"{path}/{folder}")]
    number = max(taken, default=0) + 1
    folder = f"gen/{number:08d}-{uuid.uuid4().hex[:8]}"
    written = {name: write_observed(df, f"{path}/{folder}/{name}") for name, df in tables.items()}
    manifest = {"number": number, "folder": folder, "meta": dict(meta), "inputs": dict(inputs or {}), "tables": written}
    fs, to_path = _files(spark, path)
    out = fs.create(to_path(f"{path}/manifest/{number:08d}.json"), False)  # fails if another writer took the number
    out.write(bytearray(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()))
    out.close()
    return manifest


def artifact_tables(spark: SparkSession, path: str, manifest: Mapping | None = None) -> dict[str, DataFrame]:
    """All tables of a generation, by default of the newest."""
    manifest = manifest or latest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no whole artifact in {path}")
    return {n: spark.read.parquet(f"{path}/{manifest['folder']}/{n}") for n in manifest["tables"]}


def read_artifact(spark: SparkSession, path: str, names: tuple[str, ...], version: int) -> tuple[dict[str, DataFrame], dict]:
    """Tables of the newest generation and its meta; another version is an error."""
    manifest = latest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no whole artifact in {path}")
    if manifest["meta"].get("version") != version:
        raise ValueError(f"version {manifest['meta'].get('version')} instead of {version}: {path}")
    tables = artifact_tables(spark, path, manifest)
    return {n: tables[n] for n in names}, manifest["meta"]


def changed_tables(spark: SparkSession, path: str, manifest: Mapping | None = None) -> list[str]:
    """Names of tables whose rows are no longer those that the manifest was written for."""
    manifest = manifest or latest(spark, path)
    out = []
    for name, df in artifact_tables(spark, path, manifest).items():
        told = df.agg(F.count(F.lit(1)).alias("rows"), digest(df).alias("digest")).first()
        if (told["rows"], told["digest"]) != (manifest["tables"][name]["rows"], manifest["tables"][name]["digest"]):
            out.append(name)
    return out


def expire(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all generations but the ``keep`` newest published ones, and what failed writes before the newest left; their folders."""
    fs, to_path = _files(spark, path)
    numbers = sorted(int(n.split(".")[0]) for n in listed(spark, f"{path}/manifest"))
    kept = set(numbers[-keep:]) if keep else set()
    gone = [n for n in listed(spark, f"{path}/gen") if int(n.split("-")[0]) not in kept and numbers and int(n.split("-")[0]) < numbers[-1]]
    for n in numbers:
        if n not in kept:
            fs.delete(to_path(f"{path}/manifest/{n:08d}.json"), False)
    for name in gone:
        fs.delete(to_path(f"{path}/gen/{name}"), True)
    return gone
