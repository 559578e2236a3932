"""The commands: process counts, prepare a dataset, fit statistics, predict, evaluate. Validation comes before the first action."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators import counts as C
from screenloom.operators import evidence as E
from screenloom.operators import grid as G
from screenloom.operators import labels as L
from screenloom.operators import metrics as M
from screenloom.operators import splits as S
from screenloom.operators.ranksum import differential_expression
from screenloom.plans.config import Prep, Process, Statistics
from screenloom.sources import readers, sinks
from screenloom.sources.matrix import read_screen

VERSION = 1


def refuse_existing(spark: SparkSession, paths: Sequence[str], overwrite: bool) -> None:
    if not overwrite and (there := [p for p in paths if sinks.exists(spark, p)]):
        raise FileExistsError(f"set overwrite to replace {there}")


def must_be_empty(violations: Mapping[str, DataFrame]) -> None:
    """Raise with an example of the first check that finds rows."""
    for name, df in violations.items():
        if (row := df.first()) is not None:
            raise ValueError(f"{name}: {row.asDict()}")


def run_process(spark: SparkSession, cfg: Process) -> dict[str, str]:
    """Filter, normalise and test counts, each stage optional; effects are always those of counts, never of normalised values."""
    stages = {n: s for n, s in (("filter", cfg.filter), ("normalize", cfg.normalize), ("effects", cfg.effects)) if s.enabled}
    refuse_existing(spark, [s.output for s in stages.values()], cfg.overwrite)
    cells, counts, _ = read_screen(spark, cfg.input)
    must_be_empty({"counts that are not whole": C.non_integral(counts), "cells without counts": C.empty_cells(cells, counts), "cells without a context": cells.filter("context IS NULL OR pert IS NULL")})
    if "filter" in stages:
        f = cfg.filter
        marks = C.knockdown_marks(cells, counts, f.residual, f.cell_residual, f.min_cells, f.control)
        kept = marks.filter("keep").select("cell_id")
        tables = {"cells": cells.join(kept, "cell_id", "left_semi"), "counts": counts.join(kept, "cell_id", "left_semi"), "stats": C.knockdown_stats(marks, f.control), "dropped": C.knockdown_dropped(marks)}
        sinks.write_artifact(tables, {"version": VERSION} | asdict(f), f.output, cfg.overwrite)
        kept_tables = sinks.artifact_tables(spark, f.output)
        cells, counts = kept_tables["cells"], kept_tables["counts"]
    if "normalize" in stages:
        done = C.normalize_log1p(counts, cfg.normalize.target)
        sinks.write_table(done, cfg.normalize.output, cfg.overwrite)
        must_be_empty({"sums off target": C.denormalized(spark.read.parquet(cfg.normalize.output), cfg.normalize.target)})
    if "effects" in stages:
        found = differential_expression(cells, counts, cfg.effects.target, cfg.effects.control)
        sinks.write_table(found, cfg.effects.output, cfg.overwrite, partition=("context",))
    return {n: s.output for n, s in stages.items()}


def run_prep(spark: SparkSession, cfg: Prep) -> str:
    """Labels and matrix to a dataset: conditions, cond_gene, ctrl_means, axis, meta."""
    refuse_existing(spark, [cfg.output], cfg.overwrite)
    cells, counts, matrix_genes = read_screen(spark, cfg.matrix)
    meta = {"version": VERSION, "dataset": cfg.name, "control": cfg.control, "controls_only": cfg.controls_only}
    if cfg.controls_only:
        means = C.control_means(cells, counts, cfg.control)
        if means.isEmpty():
            raise ValueError(f"no cells of {cfg.control!r}")
        sinks.write_artifact({"ctrl_means": means.withColumn("dataset", F.lit(cfg.name))}, meta, cfg.output, cfg.overwrite)
        return cfg.output
    raw = readers.read_labels(spark, cfg.labels, cfg.table.columns, cfg.table.context_from)
    labels = L.normalize_labels(raw, cfg.table.lower, cfg.table.context_map, cfg.table.drug_dose)
    must_be_empty({"pair in several files": L.pairs_in_several_files(labels)})
    last = L.last_wins(labels, "file", "ord")
    if cfg.genes is not None:
        axis = readers.read_gene_list(spark, cfg.genes)
    else:
        genes = matrix_genes if matrix_genes is not None else counts.select("gene", F.lit(0).alias("file_ord"), F.col("gene").alias("pos")).distinct()
        axis = L.gene_axis(genes, last)
    if axis.isEmpty():
        raise ValueError("no label gene is in the matrix")
    cond = L.label_arrays(last, axis, cfg.table.space)
    effects = C.pseudobulk_delta(cells, counts, cfg.control)
    contexts = cells.filter(F.col("pert") == cfg.control).select("context").distinct()
    must_be_empty({"label context without controls": cond.select("context").distinct().join(contexts, "context", "left_anti")})
    groups = C.group_sizes(cells).select("context", "pert", F.lit(True).alias("has_cells"))
    joined = cond.join(effects.select("context", "pert", "gene", "delta"), ["context", "pert", "gene"], "left").join(groups, ["context", "pert"], "left")
    full = joined.select(F.lit(cfg.name).alias("dataset"), *cond.columns, F.when(F.col("has_cells"), F.coalesce("delta", F.lit(0.0))).cast("float").alias("delta_p"))
    means = C.control_means(cells, counts, cfg.control).join(axis.select("gene"), "gene", "left_semi")
    keys = last.join(axis, "gene", "left_semi").select("context", "pert").distinct()
    tables = {"conditions": keys.select(F.lit(cfg.name).alias("dataset"), "context", "pert"), "cond_gene": full, "ctrl_means": means.withColumn("dataset", F.lit(cfg.name)), "axis": axis}
    sinks.write_artifact(tables, meta, cfg.output, cfg.overwrite)
    return cfg.output


def statistics_key(datasets: Sequence[Mapping], split_text: str, cfg: Statistics) -> str:
    """Content key of fitted statistics: dataset metas, split and settings."""
    record = {"version": VERSION, "datasets": [dict(d) for d in datasets], "split": hashlib.sha256(split_text.encode()).hexdigest(), "cfg": asdict(cfg)}
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fit_statistics(spark: SparkSession, datasets: Sequence[str], split_text: str, cfg: Statistics, cache: str, forbidden: DataFrame | None = None) -> str:
    """Evidence and grid of the train rows, built once per content key; donors are held against forbidden pairs either way."""
    prepared = [sinks.read_artifact(spark, d, ("cond_gene",), VERSION) for d in datasets]  # one generation of each, throughout
    metas = [meta for _, meta in prepared]
    path = f"{cache}/{statistics_key(metas, split_text, cfg)}"
    split = S.read_split(spark, split_text, "train")
    cond = functools.reduce(DataFrame.unionByName, [tables["cond_gene"] for tables, _ in prepared]).withColumnRenamed("delta_p", "delta")
    rows = cond.select("dataset", "context", "pert").distinct().withColumn("row", F.lit(0))
    must_be_empty({"unresolved split entry": S.unresolved(split, rows)})
    train = cond.join(split.select(*S.KEY), S.KEY, "left_semi").filter("delta IS NOT NULL")
    donors = train.select(*S.KEY).distinct()
    if forbidden is not None:
        must_be_empty({"leak": S.leaks(donors, split, forbidden)})
    if sinks.latest(spark, path) is not None:
        return path
    clip = E.clip_at(train, cfg.clip_percentile).first().clip
    parts = E.contributions(train, cfg.fdr, cfg.sign, clip)
    stats = E.totals(parts, "pert", "gene")
    must_be_empty({"count beyond the limit": E.overflows(stats)})
    grid = G.fit(G.delta_percentiles(train, cfg.max_percentile), cfg.ratio, cfg.override)
    tables = {
        "global": stats,
        "by_dataset": E.totals(parts, "dataset", "pert", "gene"),
        "contexts": E.totals(parts, "dataset", "context", "gene"),
        "records": E.donor_records(train, cfg.fdr, cfg.sign, clip),
        "scales": E.scales(stats),
        "grid": grid,
    }
    sinks.write_artifact(tables, {"version": VERSION, "clip": clip}, path, overwrite=True, inputs={"datasets": list(datasets)})
    return path


def predict(features: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A model over feature rows in Arrow batches; it sees the rows of a context together where they fit one batch."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield model(frame)

    return features.repartition("dataset", "context").sortWithinPartitions("dataset", "context", "pert").mapInPandas(batches, schema)


def embed_distinct(values: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, text) to (key, vector): each distinct text is embedded once and mapped back."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text": frame["text"], "vector": embed(frame["text"].tolist())})

    texts = values.select("text").dropna().distinct()
    return values.select("key", "text").join(texts.mapInPandas(batches, "text string, vector array<float>"), "text").select("key", "vector")


def scoring_rows(predictions: DataFrame, cond_gene: DataFrame, ctrl_means: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Predictions (dataset, context, pert, row, gene, p_de, lfc_pred, delta_pred) with the truth of their condition."""
    truth = cond_gene.select("dataset", "context", "pert", "gene", "tested", (F.col("tested") & (F.col("fdr") < fdr)).alias("de_true"), F.col("lfc").alias("lfc_true"), F.col("delta_p").cast("double").alias("delta_true"))
    controls = ctrl_means.select("dataset", "context", "gene", F.col("value").alias("c"))
    joined = predictions.join(truth, ["dataset", "context", "pert", "gene"]).join(controls, ["dataset", "context", "gene"], "left")
    return joined.withColumn("ctrl_mean", F.coalesce("c", F.lit(0.0))).drop("c")


def run_eval(predictions: DataFrame, cond_gene: DataFrame, ctrl_means: DataFrame, output: str, fdr: float = 0.05, overwrite: bool = False) -> DataFrame:
    """Write the context table and the pair table; return the aggregate."""
    spark = predictions.sparkSession
    refuse_existing(spark, [f"{output}/metrics", f"{output}/granular"], overwrite)
    rows = scoring_rows(predictions, cond_gene, ctrl_means, fdr)
    must_be_empty({"inconsistent controls": M.inconsistent_controls(rows)})
    ready = M.prepared(rows)
    contexts = M.context_metrics(ready)
    sinks.write_metrics(M.metrics_table(contexts), f"{output}/metrics", overwrite)
    sinks.write_metrics(M.pair_metrics(ready), f"{output}/granular", overwrite)
    return M.aggregate_metrics(contexts)


def run_infer(predictions: DataFrame, axis: DataFrame, output: str, overwrite: bool = False) -> str:
    """Write one row per condition with lists in axis order, and the axis beside them."""
    sinks.write_artifact({"predictions": sinks.prediction_lists(predictions, axis), "axis": axis}, {"version": VERSION}, output, overwrite)
    return output
