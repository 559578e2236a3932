"""Label tables: context and perturbation rewrites, fold-change spaces, last-wins, gene axis, strict checks.

Tables: labels(context, pert, gene, fdr, fold_change, file, ord); ``ord`` is the place in the file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLES = ("context", "pert", "gene", "fdr", "fold_change")


def map_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """User columns to roles; only those are read on. The source columns must be distinct and present."""
    if len(set(columns.values())) != len(columns):
        raise ValueError(f"columns used for several roles: {sorted(columns.values())}")
    if missing := sorted(set(columns.values()) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df.select([F.col(source).alias(role) for role, source in columns.items()])


def parse_drug_dose(value: Column) -> Column:
    """``[('name', 0.5, 'uM')]`` to ``name_0.5uM``; other texts unchanged, a malformed literal is an error."""
    pattern = r"""^\[\(\s*(['"])(.*)\1\s*,\s*([-+0-9.eE]+)\s*,\s*(['"])(.*)\4\s*\)\]$"""
    parsed = F.concat(F.regexp_extract(value, pattern, 2), F.lit("_"), F.regexp_extract(value, pattern, 3), F.regexp_extract(value, pattern, 5))
    return F.when(~F.startswith(value, F.lit("[(")), value).when(F.rlike(value, F.lit(pattern)), parsed).otherwise(
        F.raise_error(F.concat(F.lit("malformed dose: "), value)).cast("string")
    )


def normalize_labels(
    labels: DataFrame, lower: bool = False, context_map: Mapping[str, str] | None = None, drug_dose: bool = False
) -> DataFrame:
    """Contexts lower-cased, then mapped (an unmapped one is an error); perturbations parsed as dose literals."""
    context = F.lower("context") if lower else F.col("context")
    if context_map is not None:
        pairs = F.create_map(*[F.lit(x) for kv in context_map.items() for x in kv])
        found = F.try_element_at(pairs, context)
        context = F.when(found.isNull() & context.isNotNull(), F.raise_error(F.concat(F.lit("unmapped context: "), context)).cast("string")).otherwise(found)
    pert = parse_drug_dose(F.col("pert")) if drug_dose else F.col("pert")
    return labels.withColumns({"context": context, "pert": pert})


def normalize_cells(cells: DataFrame, source: str, context_map: Mapping[str, str] | None = None, drug_dose: bool = False) -> DataFrame:
    """Cell metadata in the labels' encoding: contexts and perturbations as text, contexts mapped, perturbations parsed as dose literals.

    A context outside the map, none at all, or a malformed dose is an error that names ``source``.
    """

    def error(what: str, value: Column) -> Column:
        return F.raise_error(F.concat(F.lit(f"{source}: {what} "), F.coalesce(value, F.lit("null")))).cast("string")

    context, pert = F.col("context").cast("string"), F.col("pert").cast("string")
    if context_map is not None:
        pairs = F.create_map(*[F.lit(x) for kv in context_map.items() for x in kv])
        context = F.coalesce(F.try_element_at(pairs, F.coalesce(context, F.lit(""))), error("context not in the map:", context))
    if drug_dose:
        pert = F.when(pert.isNull(), error("no perturbation:", pert)).otherwise(parse_drug_dose(pert))
    return cells.withColumns({"context": context, "pert": pert})


def fold_changes(value: Column, space: str) -> tuple[Column, Column]:
    """(linear fold change, log2 fold change) in double; log2 of 0 is -infinity, of a negative value NaN."""
    value = value.cast("double")
    if space == "linear":
        log2 = F.when(value > 0, F.log2(value)).when(value == 0, float("-inf")).when(value.isNotNull(), float("nan"))
        return value, log2
    if space == "log2":
        return F.pow(F.lit(2.0), value), value
    if space == "ln":
        return F.exp(value), value / F.log(F.lit(2.0))
    raise ValueError(f"unknown space: {space}")


def last_wins(labels: DataFrame, *order: str) -> DataFrame:
    """One row per (context, pert, gene): the last in ``order``. Rows with a null key are dropped."""
    keys = ["context", "pert", "gene"]
    values = [c for c in labels.columns if c not in keys]
    chosen = labels.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return chosen.select(*keys, "v.*")


def pairs_in_several_files(labels: DataFrame) -> DataFrame:
    """(context, pert, files) of pairs that more than one file lists: an error in strict ingestion."""
    return labels.groupBy("context", "pert").agg(F.count_distinct("file").alias("files")).filter("files > 1")


def gene_axis(matrix_genes: DataFrame, label_genes: DataFrame) -> DataFrame:
    """(gene, pos): matrix genes in first-seen order (file_ord, pos), restricted to those with labels."""
    first = matrix_genes.groupBy("gene").agg(F.min(F.struct("file_ord", "pos")).alias("seen"))
    kept = first.join(label_genes.select("gene").dropna().distinct(), "gene", "left_semi")
    return kept.select("gene", (F.row_number().over(W.orderBy("seen")) - 1).alias("pos"))


def first_seen_union(genes: DataFrame) -> DataFrame:
    """(gene, pos): union of the datasets' axes (ds_ord, pos), numbered in order of first occurrence."""
    first = genes.groupBy("gene").agg(F.min(F.struct("ds_ord", "pos")).alias("seen"))
    return first.select("gene", (F.row_number().over(W.orderBy("seen")) - 1).alias("pos"))


def label_arrays(labels: DataFrame, axis: DataFrame, space: str = "linear") -> DataFrame:
    """(context, pert, gene, fold_change, fdr, tested, lfc) over the whole axis for every labelled pair.

    Untested cells: fold change 0, fdr 1, no log fold change. A pair counts if one of its genes is on the axis.
    """
    on_axis = labels.join(axis.select("gene"), "gene", "left_semi")
    linear, log2 = fold_changes(F.col("fold_change"), space)
    found = on_axis.select("context", "pert", "gene", linear.cast("float").alias("fc"), F.col("fdr").cast("float").alias("q"), log2.alias("lfc"))
    genes = axis.agg(F.collect_list("gene").alias("genes"))  # one row of axis length, which is fixed by the assay
    wanted = on_axis.select("context", "pert").distinct().withColumn("genes", genes.scalar())
    cells = wanted.select("context", "pert", F.explode("genes").alias("gene")).join(found, ["context", "pert", "gene"], "left")
    return cells.select(
        "context", "pert", "gene",
        F.coalesce("fc", F.lit(0.0).cast("float")).alias("fold_change"),
        F.coalesce("q", F.lit(1.0).cast("float")).alias("fdr"),
        F.col("q").isNotNull().alias("tested"),
        "lfc",
    )


def ensembl_ids(pairs: DataFrame) -> DataFrame:
    """(pert, ensembl): trimmed ENSG ids; two for one perturbation are an error."""
    clean = F.regexp_replace("ensembl", r"^\s+|\s+$", "")
    kept = pairs.select("pert", clean.alias("ensembl")).filter(F.col("ensembl").startswith("ENSG")).distinct()
    one = kept.groupBy("pert").agg(F.collect_set("ensembl").alias("ids"))
    clash = F.raise_error(F.concat(F.lit("several ids for "), F.col("pert"))).cast("string")
    return one.select("pert", F.when(F.size("ids") == 1, F.element_at("ids", 1)).otherwise(clash).alias("ensembl"))


def de_truth(labels: DataFrame, threshold: float = 0.05) -> DataFrame:
    """With ``de``: tested and below the false discovery threshold; ``target`` marks the perturbation's own gene."""
    return labels.withColumns(
        {"de": F.col("tested") & (F.col("fdr") < threshold), "target": F.col("gene") == F.col("pert")}
    )


def lfc_target(fold_change: Column, de: Column) -> Column:
    """log2 of the fold change where it is a true effect, finite and above 0; else NaN."""
    value = fold_change.cast("double")
    fine = de & (value > 0) & (value < float("inf"))
    return F.when(fine, F.log2(F.greatest(value, F.lit(1e-8)))).otherwise(float("nan"))
