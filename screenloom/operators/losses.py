"""Training losses as aggregates over long prediction rows: (row, gene, ...); each returns one value per call, null-free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def de_loss(rows: DataFrame, cap: float) -> DataFrame:
    """Cross-entropy of (logits, target, valid) over valid cells; each row weighs a class by n_valid / (classes * its count), at most ``cap``."""
    cells = rows.filter("valid")
    n = F.count(F.lit(1)).over(W.partitionBy("row"))
    same = F.count(F.lit(1)).over(W.partitionBy("row", "target"))
    weight = F.least(F.lit(cap), n / (F.size("logits") * same))
    loss = (log_sum_exp(F.col("logits")) - F.get("logits", F.col("target"))) * weight
    return cells.select(loss.alias("l")).agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("de_loss"))


def huber(pred: Column, target: Column, delta: float) -> Column:
    gap = F.abs(pred - target)
    return F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))


def lfc_loss(rows: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Mean Huber of (pred, lfc, mask) over cells other than the row's own gene, plus ``alpha`` times that over own genes (``own``)."""
    h = huber(F.col("pred"), F.col("lfc"), delta)
    others, own = (F.coalesce(F.avg(F.when(F.col("mask") & c, h)), F.lit(0.0)) for c in (~F.col("own"), F.col("own")))
    return rows.agg((others + alpha * own).alias("lfc_loss"))


def direction_loss(rows: DataFrame, tau: float) -> DataFrame:
    """Mean of relu(-sign(lfc) * pred / tau) over masked cells whose truth isn't 0; 0 without any."""
    wrong = F.greatest(F.lit(0.0), -F.signum("lfc") * F.col("pred") / tau)
    return rows.agg(F.coalesce(F.avg(F.when(F.col("mask") & (F.col("lfc") != 0), wrong)), F.lit(0.0)).alias("lfc_dir_loss"))


def delta_loss(rows: DataFrame, cap: float) -> DataFrame:
    """Soft cross-entropy of (logits, target array<struct(bin, weight)>, valid); classes weigh n_valid / (bins * soft count), at most ``cap``."""
    lse = log_sum_exp(F.col("logits"))
    parts = rows.filter("valid").select("row", "gene", F.size("logits").alias("k"), F.explode("target").alias("t"), lse.alias("lse"), "logits")
    parts = parts.select("row", "gene", "k", F.col("t.bin").alias("bin"), F.col("t.weight").alias("w"), (F.col("t.weight") * (F.col("lse") - F.get("logits", F.col("t.bin")))).alias("ce"))
    n = parts.groupBy("row").agg(F.count_distinct("gene").alias("n"))
    soft = parts.groupBy("row", "bin").agg(F.sum("w").alias("count"))
    joined = parts.join(soft, ["row", "bin"]).join(n, "row")
    mixed = F.col("w") * F.least(F.lit(cap), F.col("n") / (F.col("k") * F.greatest(F.col("count"), F.lit(1e-6))))
    cells = joined.groupBy("row", "gene").agg((F.sum("ce") * F.sum(mixed)).alias("l"))
    return cells.agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("dp_loss"))


def weighted_total(terms: DataFrame, names: tuple[str, ...] = ("de_loss", "lfc_loss", "lfc_dir_loss", "dp_loss")) -> DataFrame:
    """(rows, terms) of each dataset's group to the batch's terms, weighted by its share of rows, and their sum."""
    share = F.col("rows") / F.sum("rows").over(W.partitionBy())
    shared = terms.select(*[(F.col(n) * share).alias(n) for n in names]).agg(*[F.sum(n).alias(n) for n in names])
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return shared.withColumn("loss", total)
