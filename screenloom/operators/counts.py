"""Count matrices in long form: checks, normalisation, knockdown filter, pseudobulk effects.

Tables: cells(cell_id, context, pert), counts(cell_id, gene, value) with stored entries only.
Controls dominate a context, so whatever needs them aggregates them first, by (context, gene).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = "non-targeting"
NEAR_ZERO = 1e-8


def non_integral(counts: DataFrame) -> DataFrame:
    """Stored entries that are no whole number; empty for a valid count matrix."""
    return counts.filter(F.isnan(F.col("value").cast("double")) | (F.col("value") != F.floor("value")))


def empty_cells(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Cells without a stored entry."""
    return cells.join(counts.select("cell_id").distinct(), "cell_id", "left_anti").select("cell_id")


def stored_counts(counts: DataFrame) -> DataFrame:
    """One row: stored entries and those that are not zero."""
    return counts.agg(F.count("*").alias("stored"), F.count_if(F.col("value") != 0).alias("nonzero"))


def cell_totals(counts: DataFrame) -> DataFrame:
    """(cell_id, total float): summed in double."""
    return counts.groupBy("cell_id").agg(F.sum(F.col("value").cast("double")).cast("float").alias("total"))


def normalize_log1p(counts: DataFrame, target: float = 10_000.0) -> DataFrame:
    """Entries divided by total / target in single precision (a scale of 0 counts as 1), then log1p."""
    scale = (F.col("total") / F.lit(float(target))).cast("float")
    scaled = (F.col("value").cast("float") / F.when(scale == 0, F.lit(1.0).cast("float")).otherwise(scale)).cast("float")
    return counts.join(cell_totals(counts), "cell_id").select("cell_id", "gene", F.log1p(scaled).cast("float").alias("value"))


def denormalized(normalized: DataFrame, target: float = 10_000.0, rtol: float = 1e-4) -> DataFrame:
    """Cells whose expm1 sum misses the target by more than ``rtol``, or with an entry that is not finite."""
    value = F.col("value").cast("double")
    told = normalized.groupBy("cell_id").agg(
        F.sum(F.expm1(value)).alias("restored"), F.bool_or(F.isnan(value) | (F.abs(value) == float("inf"))).alias("odd")
    )
    return told.filter(F.col("odd") | (F.abs(F.col("restored") - target) / target > rtol)).select("cell_id", "restored")


def group_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("context", "pert").agg(F.count("*").alias("n_cells"))


def pseudobulk(cells: DataFrame, counts: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """(context, pert, gene, mean): sums over stored entries divided by all cells of the group.

    Without an entry a gene has no row: its mean is 0. ``axis(gene)`` restricts the genes.
    """
    if axis is not None:
        counts = counts.join(axis.select("gene"), "gene", "left_semi")
    sums = counts.join(cells.select("cell_id", "context", "pert"), "cell_id").groupBy("context", "pert", "gene").agg(
        F.sum(F.col("value").cast("double")).alias("total")
    )
    return sums.join(group_sizes(cells), ["context", "pert"]).select(
        "context", "pert", "gene", (F.col("total") / F.col("n_cells")).alias("mean")
    )


def control_means(cells: DataFrame, counts: DataFrame, control: str = CONTROL) -> DataFrame:
    """(context, gene, value): pseudobulk of each context's controls alone; other cells are not read on."""
    return pseudobulk(cells.filter(F.col("pert") == control), counts).select("context", "gene", F.col("mean").alias("value"))


def pseudobulk_delta(cells: DataFrame, counts: DataFrame, control: str = CONTROL) -> DataFrame:
    """(context, pert, gene, mean, control_mean, delta) for every gene seen in the context; absent means count 0.

    Contexts without controls have no matched effect: control_mean and delta are null.
    """
    means = pseudobulk(cells, counts)
    genes = means.select("context", "gene").distinct()
    groups = group_sizes(cells)
    contexts = groups.filter(F.col("pert") == control).select("context", F.lit(True).alias("has_control"))
    wanted = groups.filter(F.col("pert") != control).select("context", "pert").join(genes, "context")
    controls = means.filter(F.col("pert") == control).select("context", "gene", F.col("mean").alias("c"))
    joined = (
        wanted.join(means.filter(F.col("pert") != control), ["context", "pert", "gene"], "left")
        .join(controls, ["context", "gene"], "left")
        .join(contexts, "context", "left")
    )
    base = F.when(F.col("has_control"), F.coalesce("c", F.lit(0.0)))
    mean = F.coalesce("mean", F.lit(0.0))
    return joined.select("context", "pert", "gene", mean.alias("mean"), base.alias("control_mean"), (mean - base).alias("delta"))


def latest_groups(means: DataFrame) -> DataFrame:
    """(file_ord, context, pert, gene, mean): a later file replaces a group as a whole, it does not pool with it."""
    last = means.groupBy("context", "pert").agg(F.max("file_ord").alias("file_ord"))
    return means.join(last, ["context", "pert", "file_ord"]).drop("file_ord")


def knockdown_marks(
    cells: DataFrame,
    counts: DataFrame,
    residual: float = 0.30,
    cell_residual: float = 0.50,
    min_cells: int = 30,
    control: str = CONTROL,
    genes: DataFrame | None = None,
) -> DataFrame:
    """(cell_id, context, pert, keep): controls, and the cells that pass all three stages.

    1. the perturbation's mean of its own target over the control mean lies below ``residual``;
    2. so does the cell's value, below ``cell_residual``; 3. ``min_cells`` cells of the perturbation survive.
    A control mean near 0, or a target that is no gene of ``genes``, drops the perturbation.
    """
    known = genes if genes is not None else counts.select("gene").distinct()
    targets = cells.select("context", F.col("pert").alias("gene")).distinct().join(known.select("gene"), "gene", "left_semi")
    own = counts.select("cell_id", F.col("gene").alias("pert"), F.col("value").cast("double").alias("own"))
    valued = cells.select("cell_id", "context", "pert").join(own, ["cell_id", "pert"], "left").fillna(0.0, ["own"])
    controls = cells.filter(F.col("pert") == control)
    n_controls = controls.groupBy("context").agg(F.count("*").alias("n"))
    sums = (
        counts.join(controls.select("cell_id", "context"), "cell_id")
        .groupBy("context", "gene")
        .agg(F.sum(F.col("value").cast("double")).alias("total"))
    )
    base = (
        targets.join(n_controls, "context")
        .join(sums, ["context", "gene"], "left")
        .select("context", F.col("gene").alias("pert"), (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("base"))
        .filter(F.col("base") > NEAR_ZERO)
    )
    groups = valued.groupBy("context", "pert").agg(F.avg("own").alias("mean"))
    passed = groups.join(base, ["context", "pert"]).filter(F.col("mean") / F.col("base") < residual).drop("mean")
    cell_ok = valued.join(passed, ["context", "pert"]).filter(F.col("own") / F.col("base") < cell_residual)
    enough = cell_ok.groupBy("context", "pert").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cells)
    kept = cell_ok.join(enough, ["context", "pert"]).select("cell_id", F.lit(True).alias("survives"))
    return cells.join(kept, "cell_id", "left").select(
        "cell_id", "context", "pert", ((F.col("pert") == control) | F.coalesce("survives", F.lit(False))).alias("keep")
    )


def knockdown_stats(marks: DataFrame, control: str = CONTROL) -> DataFrame:
    """Per context: cells and perturbations in, out and dropped; controls count as cells only."""
    is_control = F.col("pert") == control

    def distinct(cond: Column) -> Column:
        return F.count_distinct(F.when(cond, F.col("pert")))

    told = marks.groupBy("context").agg(
        F.count("*").alias("cells_in"),
        F.count_if("keep").alias("cells_out"),
        F.count_if(is_control).alias("control_cells"),
        distinct(~is_control).alias("perts_in"),
        distinct(~is_control & F.col("keep")).alias("perts_out"),
    )
    return told.withColumn("perts_dropped", F.col("perts_in") - F.col("perts_out"))


def knockdown_dropped(marks: DataFrame) -> DataFrame:
    """(context, pert) that lost all cells."""
    return marks.groupBy("context", "pert").agg(F.bool_or("keep").alias("any")).filter(~F.col("any")).select("context", "pert")
