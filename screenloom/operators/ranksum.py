"""Differential expression of each perturbation against its context's controls.

The statistic is defined here (the effect tables fix only its columns): counts are scaled to ``target``
per cell, means are compared as log2 of (mean + 1) ratios, the test is the two-sided Mann-Whitney U with
tie correction and normal approximation, p values are adjusted by Benjamini-Hochberg within the
perturbation. Zero entries are not stored; they enter as one block of ties at the bottom.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.operators.counts import CONTROL, cell_totals


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; the built-in functions have none. Each distinct statistic is computed once."""
    values, which = np.unique(np.abs(z.to_numpy(dtype=float)), return_inverse=True)
    return pd.Series(np.array([math.erfc(v / math.sqrt(2)) for v in values.tolist()])[which])


def ranksum(cells: DataFrame, counts: DataFrame, target: float = 10_000.0, control: str = CONTROL) -> DataFrame:
    """(context, target, feature, target_mean, ref_mean, target_ncells, ref_ncells, log2_fold_change, u, z) per perturbation and gene.

    Values are compared after rounding to 9 decimals, so that equal ratios tie.
    """
    scaled = counts.join(cell_totals(counts), "cell_id").filter("value > 0").select(
        "cell_id", "gene", F.round(F.col("value") * target / F.col("total"), 9).alias("v")
    )
    rows = scaled.join(cells.select("cell_id", "context", "pert"), "cell_id")
    # values of one context and gene: how many controls and how many cells of each perturbation hold each value
    per_value = rows.groupBy("context", "gene", "pert", "v").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("context", "pert").agg(F.count("*").alias("size"))
    refs = sizes.filter(F.col("pert") == control).select("context", F.col("size").alias("n2"))
    tested = sizes.filter(F.col("pert") != control).select("context", "pert", F.col("size").alias("n1")).join(refs, "context")
    is_ref = F.col("pert") == control
    # per context and gene: the controls' counts at and below every value; no control value is copied to a perturbation
    c = F.when(is_ref, F.col("n")).otherwise(0)
    by_gene = W.partitionBy("context", "gene")
    placed = per_value.withColumns(
        {
            "c_le": F.sum(c).over(by_gene.orderBy("v").rangeBetween(W.unboundedPreceding, W.currentRow)),
            "c_eq": F.sum(c).over(W.partitionBy("context", "gene", "v")),
        }
    )

    def tied(m: Column) -> Column:
        return (m * m * m - m).cast("double")

    t = F.col("n")
    own = placed.filter(~is_ref).groupBy("context", "pert", "gene").agg(
        F.sum("n").alias("t_pos"),
        F.sum(t * (F.col("c_le") - F.col("c_eq") / 2.0)).alias("wins"),  # over the controls that hold the gene, ties by half
        F.sum(tied(t + F.col("c_eq")) - tied(F.col("c_eq"))).alias("more_ties"),
        F.sum(t * F.col("v")).alias("sum1"),
    )
    refs_by_gene = per_value.filter(is_ref).groupBy("context", "gene").agg(
        F.sum("n").alias("c_pos"), F.sum(tied(F.col("n"))).alias("c_ties"), F.sum(F.col("n") * F.col("v")).alias("sum2")
    )
    genes = per_value.select("context", "gene").distinct()
    pairs = tested.join(genes, "context")
    joined = pairs.join(own, ["context", "pert", "gene"], "left").join(refs_by_gene, ["context", "gene"], "left")
    joined = joined.fillna(0, ["t_pos", "wins", "more_ties", "sum1", "c_pos", "c_ties", "sum2"]).filter("t_pos + c_pos > 0")
    zeros1, zeros2 = F.col("n1") - F.col("t_pos"), F.col("n2") - F.col("c_pos")
    n, zeros = F.col("n1") + F.col("n2"), zeros1 + zeros2
    u = F.col("wins") + F.col("t_pos") * zeros2 + zeros1 * zeros2 / 2.0
    ties = F.col("c_ties") + F.col("more_ties") + tied(zeros)
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.try_divide(ties, (n * (n - 1)).cast("double"))))
    return joined.select(
        "context",
        F.col("pert").alias("target"),
        F.col("gene").alias("feature"),
        (F.col("sum1") / F.col("n1")).alias("target_mean"),
        (F.col("sum2") / F.col("n2")).alias("ref_mean"),
        F.col("n1").alias("target_ncells"),
        F.col("n2").alias("ref_ncells"),
        F.log2((F.col("sum1") / F.col("n1") + 1) / (F.col("sum2") / F.col("n2") + 1)).alias("log2_fold_change"),
        u.alias("u"),
        F.try_divide(u - F.col("n1") * F.col("n2") / 2.0, spread).alias("z"),
    )


def adjusted(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """``tests`` with p_adj: Benjamini-Hochberg within (context, target)."""
    group = W.partitionBy("context", "target")
    ranked = tests.withColumns(
        {"bh_n": F.count(p).over(group), "bh_rank": F.row_number().over(group.orderBy(F.col(p).asc_nulls_last(), "feature"))}
    )
    raw = F.col(p) * F.col("bh_n") / F.col("bh_rank")
    onward = group.orderBy("bh_rank").rowsBetween(0, W.unboundedFollowing)
    return ranked.withColumn("p_adj", F.least(F.lit(1.0), F.min(raw).over(onward))).drop("bh_n", "bh_rank")


def differential_expression(cells: DataFrame, counts: DataFrame, target: float = 10_000.0, control: str = CONTROL) -> DataFrame:
    """The effect table: one row per perturbation and gene, with p_value, Ueffect (U over n1 n2) and p_adj."""
    tests = ranksum(cells, counts, target, control)
    tests = tests.withColumn("p_value", two_sided(F.coalesce("z", F.lit(0.0))))
    tests = tests.withColumn("Ueffect", F.col("u") / (F.col("target_ncells") * F.col("ref_ncells")))
    return adjusted(tests).drop("u", "z")
