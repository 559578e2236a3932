"""Evidence by increments: each dataset's sums are stored under a content key, and totals merge them.

Statistics are sums, so a corpus of datasets is the union of their parts. A part is an artifact in ``parts/NAME/KEY``; its key is the hash
of the dataset's own digest, the train rows it gives and the settings that its sums depend on (the clip among them). A refresh
computes the parts whose keys are new, reads no rows of the others, and publishes the list of parts that hold now; datasets that are no longer named
drop out of it. Readers of a list keep their parts through a refresh; ``unused`` names what no list holds any more.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators import evidence as E
from screenloom.sources import sinks

KEYS = {"donors": ("pert", "gene"), "contexts": ("context", "gene")}
VERSION = 1


@dataclass(frozen=True)
class Source:
    """A dataset's train rows: ``digest`` tells its content and its split, ``rows`` reads them (cond_gene's columns) when that is new."""

    digest: str
    rows: Callable[[], DataFrame]


def part_key(source: Source, fdr: float, sign: float, clip: float) -> str:
    record = {"version": VERSION, "digest": source.digest, "fdr": fdr, "sign": sign, "clip": clip}
    return hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()


def refresh(spark: SparkSession, path: str, sources: Mapping[str, Source], fdr: float = 0.05, sign: float = 1.0, clip: float = 1.0) -> dict[str, list[str]]:
    """Bring the store to these datasets; names of the parts that were built, kept and dropped."""
    last = sinks.latest(spark, f"{path}/list")
    held = dict(last["meta"]["parts"]) if last else {}
    parts = {name: part_key(source, fdr, sign, clip) for name, source in sources.items()}
    built = []
    for name, source in sources.items():
        at = f"{path}/parts/{name}/{parts[name]}"
        if sinks.latest(spark, at) is not None:
            continue
        own = E.contributions(source.rows(), fdr, sign, clip)
        tables = {table: E.totals(own, *keys) for table, keys in KEYS.items()}
        sinks.write_artifact(tables, {"version": VERSION, "dataset": name}, at, inputs={"digest": source.digest, "fdr": fdr, "sign": sign, "clip": clip})
        built.append(name)
    sinks.write_artifact({"names": spark.createDataFrame(sorted(parts.items()), "dataset string, key string")}, {"version": VERSION, "parts": parts}, f"{path}/list", overwrite=True)
    return {"built": built, "kept": [n for n in parts if n not in built], "dropped": sorted(set(held) - set(parts))}


def parts_of(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(dataset, keys, statistics) of all parts that hold now."""
    last = sinks.latest(spark, f"{path}/list")
    if last is None:
        raise FileNotFoundError(f"no evidence in {path}")
    frames = [sinks.artifact_tables(spark, f"{path}/parts/{name}/{key}")[table].withColumn("dataset", F.lit(name)) for name, key in sorted(last["meta"]["parts"].items())]
    if not frames:
        raise ValueError(f"no datasets in {path}")
    return reduce(DataFrame.unionByName, frames)


def donor_totals(spark: SparkSession, path: str) -> DataFrame:
    """(pert, gene) statistics over all datasets: stored sums merged, no rows read."""
    return E.totals(parts_of(spark, path, "donors"), "pert", "gene")


def dataset_totals(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, pert, gene) statistics, as stored."""
    return parts_of(spark, path, "donors").select("dataset", "pert", "gene", *E.STATS)


def context_totals(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, context, gene) statistics, as stored."""
    return parts_of(spark, path, "contexts").select("dataset", "context", "gene", *E.STATS)


def unused(spark: SparkSession, path: str) -> list[str]:
    """Folders of parts that the newest list doesn't name."""
    held = sinks.latest(spark, f"{path}/list")["meta"]["parts"]
    return [f"{path}/parts/{n}/{k}" for n in sinks.listed(spark, f"{path}/parts") for k in sinks.listed(spark, f"{path}/parts/{n}") if held.get(n) != k]
