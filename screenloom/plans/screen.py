"""A screen out of the benchmark's tables: orders are cells, brands are genes, quantities are counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = "non-targeting"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pert() -> F.Column:
    n = F.col("o_custkey") % 26
    return F.when(n == 0, CONTROL).otherwise(F.concat(F.lit("Brand#"), n.cast("string")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(cell_id, dataset, context, pert): orders with an item."""
    items = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell_id"))
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("context"), _pert().alias("pert")
    )
    return orders.join(items, "cell_id", "left_semi")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts(cell_id, gene, value): summed quantities per order and brand."""
    items, parts = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    joined = items.select("l_orderkey", "l_partkey", "l_quantity").join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels(dataset, context, pert, gene, fdr, fold_change, and six columns of order), repeated keys included."""
    items, parts, orders = (load(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    joined = items.join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(
        orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        F.col("o_orderstatus").alias("dataset"),
        F.col("o_orderpriority").alias("context"),
        _pert().alias("pert"),
        F.col("p_brand").alias("gene"),
        F.col("l_discount").alias("fdr"),
        (F.col("l_quantity") / 25.0).alias("fold_change"),
        *ORDER,
    ).filter(F.col("pert") != CONTROL)


#: Columns that order the rows of labels uniquely.
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cond_gene(dataset, context, pert, gene, fold_change, fdr, tested, delta): last labels of each dataset, with price-based effects."""
    keys = ["dataset", "context", "pert", "gene"]
    last = labels(spark, sf_dir).groupBy(*keys).agg(F.max_by(F.struct("fdr", "fold_change", "l_extendedprice"), F.struct(*ORDER)).alias("v"))
    return last.select(
        *keys, F.col("v.fold_change").alias("fold_change"), F.col("v.fdr").alias("fdr"), F.lit(True).alias("tested"), (F.col("v.l_extendedprice") / 50000.0 - 1).alias("delta")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred(...) of the metrics over conditions: pseudo-predictions from other columns of the same rows."""
    keys = ["dataset", "context", "pert", "gene"]
    last = labels(spark, sf_dir).groupBy(*keys).agg(F.max_by(F.struct("fdr", "fold_change", "l_extendedprice", "l_partkey", "l_suppkey"), F.struct(*ORDER)).alias("v"))
    lfc = F.log2("v.fold_change")
    return last.select(
        *keys,
        F.lit(0).alias("row"),
        ((F.col("v.l_partkey") % 101) / 100.0).alias("p_de"),
        F.when(F.col("v.l_suppkey") % 7 != 0, lfc + ((F.col("v.l_suppkey") % 11) - 5) / 3.7).alias("lfc_pred"),
        ((F.col("v.l_partkey") % 13) / 13.0 - 0.5).alias("delta_pred"),
        (F.col("v.fdr") < 0.05).alias("de_true"),
        F.lit(True).alias("tested"),
        lfc.alias("lfc_true"),
        (F.col("v.l_extendedprice") / 50000.0 - 1).alias("delta_true"),
        F.lit(0.5).alias("ctrl_mean"),
    )
