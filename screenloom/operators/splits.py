"""Splits as long tables: resolution with causes, disjointness, queries, leakage."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["dataset", "context", "pert"]


def read_split(spark: SparkSession, text: str, split: str) -> DataFrame:
    """JSON ``{"dataset.context": [pert, ...]}`` to (split, dataset, context, pert, ord); repeated keys or entries are errors."""

    def strict(pairs: Sequence[tuple[str, object]]) -> Mapping[str, object]:
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise ValueError(f"repeated keys: {sorted({k for k in keys if keys.count(k) > 1})}")
        return dict(pairs)

    found = json.loads(text, object_pairs_hook=strict)
    rows = []
    for key, perts in found.items():
        dataset, dot, context = key.partition(".")
        if not dot or not dataset or not context:
            raise ValueError(f"no dataset.context: {key!r}")
        if not isinstance(perts, list) or not all(isinstance(p, str) for p in perts) or len(set(perts)) != len(perts):
            raise ValueError(f"not a list of distinct names: {key!r}")
        rows += [(split, dataset, context, p) for p in perts]
    rows = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "split string, dataset string, context string, pert string, ord long")


def resolve_split(split: DataFrame, rows: DataFrame) -> DataFrame:
    """The split's entries with their row, in order of dataset and row when collected with orderBy."""
    return split.select(*KEY).join(rows.select(*KEY, "row"), KEY).select(*KEY, "row")


def unresolved(split: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries without a row, with the first cause: unknown dataset, context or perturbation."""
    datasets = rows.select("dataset").distinct().withColumn("has_dataset", F.lit(True))
    contexts = rows.select("dataset", "context").distinct().withColumn("has_context", F.lit(True))
    lost = split.select(*KEY).join(rows.select(*KEY).distinct(), KEY, "left_anti")
    told = lost.join(datasets, "dataset", "left").join(contexts, ["dataset", "context"], "left")
    cause = F.when(F.col("has_dataset").isNull(), "dataset").when(F.col("has_context").isNull(), "context").otherwise("perturbation")
    return told.select(*KEY, cause.alias("cause"))


def overlaps(splits: DataFrame) -> DataFrame:
    """(dataset, context, pert, splits) that stand in more than one split: must be empty."""
    return splits.groupBy(*KEY).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def query_rows(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Queries whose dataset and context exist; the perturbation may be unknown, so their row is -1."""
    known = rows.select("dataset", "context").distinct()
    return queries.select(*KEY).join(known, ["dataset", "context"], "left_semi").select(*KEY, F.lit(-1).cast("long").alias("row"))


def leaks(donors: DataFrame, train: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Donors that are no train pair, or are an evaluation pair: must be empty."""
    stray = donors.select(*KEY).join(train.select(*KEY), KEY, "left_anti").withColumn("cause", F.lit("not in train"))
    barred = donors.select(*KEY).join(forbidden.select(*KEY), KEY, "left_semi").withColumn("cause", F.lit("evaluation pair"))
    return stray.unionByName(barred).distinct()


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """Keys with several rows: must be empty."""
    return rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")


def contributing(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Datasets with at least one train row; order by name when collected."""
    return rows.join(train.select(*KEY), KEY, "left_semi").select("dataset").distinct()
