"""Hierarchical evaluation metrics over long predictions.

Rows: pred(dataset, context, pert, row, gene, p_de, lfc_pred, delta_pred, de_true, tested, lfc_true,
delta_true, ctrl_mean). A row is one scored condition; a pair may have several. Undefined values are
null inside; NaN predictions and truths are read as missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = ["dataset", "context", "pert", "row"]
PAIR = ["dataset", "context", "pert"]
CONTEXT = ["dataset", "context"]
PAIR_METRICS = ["binary_auprc", "sig_jaccard", "direction_match", "spearman_lfc", "discrimination_score_l1"]
CONTEXT_METRICS = [*PAIR_METRICS[:3], "spearman_nsig", *PAIR_METRICS[3:]]
THRESHOLD = 0.5


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def prepared(pred: DataFrame) -> DataFrame:
    """p is 0 where it or the effect prediction is missing; a true effect needs a truth."""
    p = F.when(_missing("p_de") | _missing("lfc_pred"), 0.0).otherwise(F.col("p_de").cast("double"))
    return pred.withColumns(
        {
            "p": p,
            "de": F.col("de_true") & F.col("tested") & ~_missing("lfc_true"),
            "lp": F.when(~_missing("lfc_pred"), F.col("lfc_pred").cast("double")),
            "lt": F.when(~_missing("lfc_true"), F.col("lfc_true").cast("double")),
        }
    )


def average_precision(ready: DataFrame, *keys: str) -> DataFrame:
    """Step-wise average precision over tested genes, tied scores collapsed; 0 with only one class."""
    keys = keys or tuple(ROW)
    scores = ready.filter("tested").groupBy(*keys, "p").agg(F.count("*").alias("n"), F.count_if("de").alias("hits"))
    down = W.partitionBy(*keys).orderBy(F.col("p").desc()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*keys)
    placed = scores.withColumns(
        {"seen": F.sum("n").over(down), "found": F.sum("hits").over(down), "all_n": F.sum("n").over(every), "all_hits": F.sum("hits").over(every)}
    )
    part = F.try_divide(F.col("hits"), F.col("all_hits")) * F.col("found") / F.col("seen")
    one_class = F.max((F.col("all_hits") == 0) | (F.col("all_hits") == F.col("all_n")))
    found = placed.groupBy(*keys).agg(F.when(one_class, 0.0).otherwise(F.sum(part)).alias("binary_auprc"))
    everyone = ready.select(*keys).distinct()
    return everyone.join(found, list(keys), "left").fillna(0.0, ["binary_auprc"])


def jaccard_and_direction(ready: DataFrame) -> DataFrame:
    """Per row: overlap of called and true effects without the own gene (1 if there are none), and share of true effects with the right sign."""
    other = F.col("gene") != F.col("pert")
    called = (F.col("p") >= THRESHOLD) & F.col("tested") & other
    true = F.col("de") & other
    agrees = F.col("de") & F.col("lp").isNotNull() & (F.signum("lt") == F.signum("lp"))
    told = ready.groupBy(*ROW).agg(
        F.count_if(called | true).alias("either"), F.count_if(called & true).alias("both"), F.count_if(agrees).alias("hits"), F.count_if("de").alias("n_de")
    )
    return told.select(
        *ROW,
        F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(1.0).alias("sig_jaccard"),
        F.when(F.col("n_de") > 0, F.col("hits") / F.col("n_de")).otherwise(0.0).alias("direction_match"),
    )


def average_rank(value: str, *keys: str) -> Column:
    """Average rank within ``keys``; missing values share the rank after all others."""
    order = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    ties = W.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def spearman(pairs: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, rho): null for fewer than two values or constant ranks."""
    ranked = pairs.select(*keys, average_rank(x, *keys).alias("rx"), average_rank(y, *keys).alias("ry"))
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    constant = (F.min("rx") == F.max("rx")) | (F.min("ry") == F.max("ry"))
    return ranked.groupBy(*keys).agg(F.when(~constant, rho).alias("rho"))


def spearman_lfc(ready: DataFrame) -> DataFrame:
    """Per row: rank correlation of true and predicted effects over the true ones."""
    return spearman(ready.filter("de"), "lt", "lp", *ROW).withColumnRenamed("rho", "spearman_lfc")


def spearman_nsig(ready: DataFrame) -> DataFrame:
    """Per context: rank correlation of mean true and called effect counts over perturbations with any; 1 if there are none."""
    rows = ready.groupBy(*ROW).agg(
        F.count_if("de").alias("real"), F.count_if((F.col("p") >= THRESHOLD) & F.col("tested")).alias("called")
    )
    means = rows.groupBy(*PAIR).agg(F.avg("real").alias("real"), F.avg("called").alias("called"))
    rho = spearman(means.filter("real > 0"), "real", "called", *CONTEXT)
    contexts = means.groupBy(*CONTEXT).agg(F.max("real").alias("most"))
    joined = contexts.join(rho, CONTEXT, "left")
    return joined.select(*CONTEXT, F.when(F.col("most") > 0, F.col("rho")).otherwise(1.0).alias("spearman_nsig"))


def bulk_effects(ready: DataFrame) -> DataFrame:
    """(dataset, context, pert, gene, real, pred): mean effects over rows whose truth is complete, floored at control - control >= -control."""
    whole = ready.groupBy(*ROW).agg(F.max(_missing("delta_true") | _missing("ctrl_mean")).alias("holes")).filter(~F.col("holes"))
    usable = ready.join(whole.select(*ROW), ROW, "left_semi")
    ctrl = F.max("ctrl_mean").cast("double")
    return usable.groupBy(*PAIR, "gene").agg(
        (F.greatest(ctrl + F.avg("delta_true"), F.lit(0.0)) - ctrl).alias("real"),
        (F.greatest(ctrl + F.avg("delta_pred"), F.lit(0.0)) - ctrl).alias("pred"),
    )


BLOCK, PIVOTS = 128, 8  # perturbations of a context in one block, and truths that others are measured against


def _matrix(rows: pd.DataFrame, value: str, axis: np.ndarray) -> np.ndarray:
    """One row a perturbation over the gene ids of ``axis``; NaN where it has no value."""
    out = np.full((len(rows), len(axis)), np.nan)
    for k, (ids, values) in enumerate(zip(rows["ids"], rows[value], strict=True)):
        out[k, np.searchsorted(axis, ids)] = values
    return out


def nearer_truths(pred: np.ndarray, real: np.ndarray, own: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (-1, 0, 1) of each prediction's distance to each truth less its own, without its own gene, and how many pairs were met.

    Distances to a few pivots bound a distance from both sides (triangle inequality); the own gene's share comes off exactly. Only pairs that
    the bounds leave open, by a margin for rounding, are summed up. Needs values everywhere; ``own`` is the own gene's place or -1.
    """
    pivots = real[np.linspace(0, len(real) - 1, min(PIVOTS, len(real))).astype(int)]
    to_pred = np.stack([np.abs(pred - p).sum(axis=1) for p in pivots], axis=1)
    to_real = np.stack([np.abs(real - p).sum(axis=1) for p in pivots], axis=1)
    signs, met = np.zeros((len(pred), len(real)), dtype=np.int8), 0
    for i in range(len(pred)):
        apart = np.abs(pred[i, own[i]] - real[:, own[i]]) if own[i] >= 0 else 0.0
        low = np.abs(to_pred[i] - to_real).max(axis=1) - apart
        high = (to_pred[i] + to_real).min(axis=1) - apart
        margin = 1e-6 * (1 + np.abs(limit[i]) + high)
        signs[i] = np.where(high < limit[i] - margin, -1, np.where(low > limit[i] + margin, 1, 0))
        open_ = np.flatnonzero(signs[i] == 0)
        met += len(open_)
        far = np.abs(real[open_] - pred[i])
        if own[i] >= 0:
            far[:, own[i]] = 0
        signs[i, open_] = np.sign(np.round(far.sum(axis=1), 9) - limit[i])
    return signs, np.array(met)


def _closer(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block of perturbations against another: how many truths lie nearer to each prediction than its own, of how many, and how many pairs were met."""
    asked, others = (rows[rows["side"] == s].sort_values("pert") for s in ("a", "b"))
    axis = np.unique(np.concatenate(list(rows["ids"])))
    pred, real = _matrix(asked, "pred", axis), _matrix(others, "real", axis)
    place = np.searchsorted(axis, asked["own"].to_numpy())
    own = np.where((place < len(axis)) & (axis[np.minimum(place, len(axis) - 1)] == asked["own"].to_numpy()), place, -1)
    limit, names = np.nan_to_num(asked["d"].to_numpy(dtype=float)), others["pert"].to_numpy(dtype=object)  # one without a distance has no score
    whole = not np.isnan(pred).any() and not np.isnan(real).any() and len(axis) > 1
    if whole:
        signs, met = nearer_truths(pred, real, own, limit)
    out = []
    for i, p in enumerate(asked["pert"]):
        if whole:
            sign, has = signs[i], np.ones(len(real), dtype=bool)
        else:  # a gene that one side lacks counts for neither
            far = np.abs(real - pred[i])
            if own[i] >= 0:
                far[:, own[i]] = np.nan
            has, sign = ~np.isnan(far).all(axis=1), np.sign(np.round(np.nansum(far, axis=1), 9) - limit[i])
        nearer = has & (names != p) & ((sign < 0) | ((sign == 0) & (names < p)))
        out.append((p, int(nearer.sum()), int(has.sum()), (int(met) if i == 0 else 0) if whole else len(real)))
    keys = {k: rows[k].iloc[0] for k in CONTEXT}
    return pd.DataFrame(out, columns=["pert", "rank", "n", "met"]).assign(**keys)[[*PAIR, "rank", "n", "met"]]


def truth_ranks(effects: DataFrame, block: int = BLOCK) -> DataFrame:
    """(dataset, context, pert, rank, n, met, d): truths nearer than the own one, of how many, and how many pairs had to be summed up.

    A perturbation becomes one row of three arrays (gene ids, predictions, truths; ids are 64-bit hashes of names) before
    anything is copied. Perturbations are dealt to blocks of some ``block`` and every block meets every other as two matrices. Ties go by name.
    """
    others = F.when(F.col("gene") != F.col("pert"), F.abs(F.col("pred") - F.col("real")))
    entry = F.struct(F.xxhash64("gene").alias("id"), "pred", "real")
    vectors = effects.groupBy(*PAIR).agg(F.array_sort(F.collect_list(entry)).alias("v"), F.round(F.sum(others), 9).alias("d"))
    arrays = [F.col(f"v.{n}").alias(a) for a, n in (("ids", "id"), ("pred", "pred"), ("real", "real"))]
    vectors = vectors.select(*PAIR, F.xxhash64("pert").alias("own"), "d", *arrays)
    sizes = effects.select(*PAIR).distinct().groupBy(*CONTEXT).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = vectors.join(sizes, CONTEXT).withColumn("i", F.pmod(F.xxhash64("pert"), F.col("blocks")).cast("int"))
    every, none = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.lit(None).cast("array<double>")
    left = dealt.select(*PAIR, "own", "d", "ids", "pred", none.alias("real"), F.col("i").alias("x"), every.alias("y"), F.lit("a").alias("side"))
    right = dealt.select(*PAIR, "own", "d", "ids", none.alias("pred"), "real", every.alias("x"), F.col("i").alias("y"), F.lit("b").alias("side"))
    schema = T.StructType([*(effects.schema[k] for k in PAIR), *(T.StructField(c, T.LongType()) for c in ("rank", "n", "met"))])
    counted = left.unionByName(right).groupBy(*CONTEXT, "x", "y").applyInPandas(_closer, schema)
    told = counted.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("rank", "n", "met")])
    return told.join(vectors.select(*PAIR, "d"), PAIR)


def discrimination_l1(effects: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per pair: 1 - rank / P of the own truth among all true effects of the context by L1 distance, without the gene of that name.

    A context without perturbations gives no row.
    """
    return truth_ranks(effects, block).filter("d IS NOT NULL").select(*PAIR, (1 - F.col("rank") / F.col("n")).alias("discrimination_score_l1"))


def row_metrics(ready: DataFrame) -> DataFrame:
    return average_precision(ready).join(jaccard_and_direction(ready), ROW).join(spearman_lfc(ready), ROW, "left")


def pair_metrics(ready: DataFrame) -> DataFrame:
    """Means over a pair's rows, undefined values skipped; with n_rows."""
    rows = row_metrics(ready)
    means = rows.groupBy(*PAIR).agg(F.count("*").alias("n_rows"), *[F.avg(m).alias(m) for m in PAIR_METRICS[:4]])
    return means.join(discrimination_l1(bulk_effects(ready)), PAIR, "left")


def context_metrics(ready: DataFrame) -> DataFrame:
    """Means over a context's pairs, and the context's own correlation of counts."""
    pairs = pair_metrics(ready)
    means = pairs.groupBy(*CONTEXT).agg(F.sum("n_rows").alias("n_rows"), *[F.avg(m).alias(m) for m in PAIR_METRICS])
    return means.join(spearman_nsig(ready), CONTEXT).select(*CONTEXT, "n_rows", *CONTEXT_METRICS)


def aggregate_metrics(contexts: DataFrame) -> DataFrame:
    """One row: mean over datasets of the mean over their contexts."""
    datasets = contexts.groupBy("dataset").agg(*[F.avg(m).alias(m) for m in CONTEXT_METRICS])
    return datasets.agg(*[F.avg(m).alias(m) for m in CONTEXT_METRICS])


def metrics_table(contexts: DataFrame) -> DataFrame:
    """Context rows and a row ``all``: rows summed, metrics averaged over contexts alone."""
    named = contexts.select(F.concat_ws(".", "dataset", "context").alias("context"), "n_rows", *CONTEXT_METRICS)
    every = named.agg(F.sum("n_rows").alias("n_rows"), *[F.avg(m).alias(m) for m in CONTEXT_METRICS])
    return named.unionByName(every.select(F.lit("all").alias("context"), "n_rows", *CONTEXT_METRICS))


def inconsistent_controls(pred: DataFrame) -> DataFrame:
    """Contexts whose control mean is partly missing, infinite or differs between rows: must be empty."""
    v = F.col("ctrl_mean").cast("double")
    missing = v.isNull() | F.isnan(v)
    per_gene = pred.groupBy(*CONTEXT, "gene").agg(
        F.count_if(missing).alias("missing"), F.count("*").alias("n"), F.count_distinct(F.when(~missing, v)).alias("values"), F.max(F.coalesce(F.abs(v) == float("inf"), F.lit(False))).alias("infinite")
    )
    told = per_gene.groupBy(*CONTEXT).agg(F.sum("missing").alias("missing"), F.sum("n").alias("n"), F.max("values").alias("values"), F.max("infinite").alias("infinite"))
    return told.filter(((F.col("missing") > 0) & (F.col("missing") < F.col("n"))) | (F.col("values") > 1) | F.col("infinite")).select(*CONTEXT)
