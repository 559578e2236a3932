"""Train-split evidence: sufficient statistics, leave-one-out serving, context blocks.

Rows: cond_gene(dataset, context, pert, gene, fold_change, fdr, tested, delta). Statistics are sums, so
everything but a query's own record is total minus own, without a second pass over the donors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.operators.grid import exact_percentile

STATS = ["dp_sum", "dp_sumsq", "dp_cnt", "tested_cnt", "up_cnt", "down_cnt", "lfc_sum", "lfc_sumsq", "lfc_cnt"]
COUNTS = [s for s in STATS if s.endswith("_cnt")]
#: Largest values of the stored counts.
LIMITS = {"dp_cnt": 2**16 - 1, "tested_cnt": 2**16 - 1, "up_cnt": 2**16 - 1, "down_cnt": 2**16 - 1, "lfc_cnt": 2**16 - 1}
TESTED, UP, DOWN, LFC_OK = 1, 2, 4, 8
OWN_KEY = ["dataset", "context", "pert", "gene"]


def contributions(rows: DataFrame, fdr: float = 0.05, sign: float = 1.0, clip: float = 1.0) -> DataFrame:
    """Each row's contribution to the nine statistics; a fold change equal to ``sign`` is neither up nor down."""
    fc, dp = F.col("fold_change").cast("double"), F.col("delta").cast("double")
    sig = F.col("tested") & (F.col("fdr").cast("double") < fdr)
    ok = F.col("tested") & (fc > 0) & (fc < float("inf"))
    lfc = F.when(ok, F.greatest(F.lit(-clip), F.least(F.lit(clip), F.log2(fc)))).otherwise(0.0)
    return rows.withColumn("l", lfc).select(
        *OWN_KEY,
        dp.alias("dp_sum"),
        (dp * dp).alias("dp_sumsq"),
        F.lit(1).cast("long").alias("dp_cnt"),
        F.col("tested").cast("long").alias("tested_cnt"),
        (sig & (fc > sign)).cast("long").alias("up_cnt"),
        (sig & (fc < sign)).cast("long").alias("down_cnt"),
        F.col("l").alias("lfc_sum"),
        (F.col("l") * F.col("l")).alias("lfc_sumsq"),
        F.coalesce(ok, F.lit(False)).cast("long").alias("lfc_cnt"),
    )


def totals(parts: DataFrame, *keys: str) -> DataFrame:
    """Statistics summed by ``keys``: (pert, gene) for donors, with dataset or (dataset, context, gene) for the others."""
    return parts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in STATS])


def overflows(stats: DataFrame) -> DataFrame:
    """Rows with a count beyond what the artifact stores: must be empty."""
    beyond = [F.col(c) > limit for c, limit in LIMITS.items()]
    return stats.filter(beyond[0] | beyond[1] | beyond[2] | beyond[3] | beyond[4])


def clip_at(rows: DataFrame, percentile: float = 95.0) -> DataFrame:
    """One row ``clip``: exact percentile of abs(log2 fold change) over tested cells; 1 if it is 0 or there are none."""
    fc = F.col("fold_change").cast("double")
    value = F.abs(F.log2(F.when(F.col("tested") & (fc > 0) & (fc < float("inf")), fc)))
    found = exact_percentile(rows.select(value.alias("size")), "size", percentile / 100).agg(F.max("p").alias("p"))
    return found.select(F.when(F.col("p") > 0, F.col("p")).otherwise(1.0).alias("clip"))


def _pop_std(total: Column, square: Column, n: Column) -> Column:
    mean = F.try_divide(total, n)
    std = F.sqrt(F.greatest(F.try_divide(square, n) - mean * mean, F.lit(0.0)))
    return F.when((n > 0) & (std > 0), std).otherwise(1.0)


def scales(stats: DataFrame) -> DataFrame:
    """One row (dp, lfc): population standard deviations over all cells; 1 where degenerate."""
    summed = stats.agg(*[F.sum(s).alias(s) for s in STATS])
    return summed.select(
        _pop_std(F.col("dp_sum"), F.col("dp_sumsq"), F.col("dp_cnt")).alias("dp"),
        _pop_std(F.col("lfc_sum"), F.col("lfc_sumsq"), F.col("lfc_cnt")).alias("lfc"),
    )


def _minus(total: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    renamed = own.select(*keys, *[F.col(s).alias(f"own_{s}") for s in STATS])
    joined = total.join(renamed, keys, "left")
    return joined.select(*total.columns[: len(total.columns) - len(STATS)], *[(F.col(s) - F.coalesce(f"own_{s}", F.lit(0))).alias(s) for s in STATS])


def leave_one_out(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """(query dataset, context, pert; gene; statistics without the query's own record).

    A negative count means that records and totals disagree: the gene is zeroed, not served with a wrong sign.
    """
    asked = queries.select("dataset", "context", "pert").distinct()
    wanted = asked.join(totals(parts, "pert", "gene"), "pert").select(*OWN_KEY, *STATS)
    left = _minus(wanted, totals(parts, *OWN_KEY), OWN_KEY)
    broken = F.least(*[F.col(c) for c in COUNTS]) < 0
    return left.select(*OWN_KEY, *[F.when(broken, 0).otherwise(F.col(s)).alias(s) for s in STATS])


def context_leave_one_out(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """The same for the query's context totals; a negative count there is an error."""
    asked = queries.select("dataset", "context", "pert").distinct()
    wanted = asked.join(totals(parts, "dataset", "context", "gene"), ["dataset", "context"]).select(*OWN_KEY, *STATS)
    left = _minus(wanted, totals(parts, *OWN_KEY), OWN_KEY)
    error = F.raise_error(F.lit("context totals hold less than their own record")).cast("long")
    return left.withColumn("dp_cnt", F.when(F.least(*[F.col(c) for c in COUNTS]) < 0, error).otherwise(F.col("dp_cnt")))


def _mean_std(total: str, square: str, n: str) -> tuple[Column, Column]:
    safe = F.greatest(F.col(n), F.lit(1))
    mean = F.when(F.col(n) > 0, F.col(total) / safe).otherwise(0.0)
    std = F.when(F.col(n) >= 2, F.sqrt(F.greatest(F.col(square) / safe - mean * mean, F.lit(0.0)))).otherwise(0.0)
    return mean, std


def blocks(stats: DataFrame, scale: DataFrame) -> DataFrame:
    """Served features per gene: three blocks of four; ``scale`` is the row of :func:`scales`."""
    joined = stats.withColumns({"s_dp": scale.select("dp").scalar(), "s_lfc": scale.select("lfc").scalar()})
    mean, std = _mean_std("dp_sum", "dp_sumsq", "dp_cnt")
    mean_l, std_l = _mean_std("lfc_sum", "lfc_sumsq", "lfc_cnt")
    tested = F.greatest(F.col("tested_cnt"), F.lit(1))

    def four(*values: Column) -> Column:
        return F.array(*[v.cast("float") for v in values])

    def seen(c: str) -> tuple[Column, Column]:
        return (F.col(c) > 0).cast("int"), F.log1p(F.col(c))

    keys = [c for c in stats.columns if c not in STATS]
    return joined.select(
        *keys,
        four(mean / F.col("s_dp"), std / F.col("s_dp"), *seen("dp_cnt")).alias("evidence_dp"),
        four(F.col("up_cnt") / tested, F.col("down_cnt") / tested, *seen("tested_cnt")).alias("evidence_de"),
        four(mean_l / F.col("s_lfc"), std_l / F.col("s_lfc"), *seen("lfc_cnt")).alias("evidence_lfc"),
    )


def provenance(by_dataset: DataFrame) -> DataFrame:
    """(pert, gene, prov): per dataset in name order [count > 0, log1p count, log1p tested]; datasets without a row give zeros."""
    names = by_dataset.agg(F.array_sort(F.collect_set("dataset")).alias("n"))
    maps = by_dataset.groupBy("pert", "gene").agg(
        F.map_from_entries(F.collect_list(F.struct("dataset", F.struct("dp_cnt", "tested_cnt")))).alias("m")
    )
    none = F.struct(F.lit(0).cast("long").alias("dp_cnt"), F.lit(0).cast("long").alias("tested_cnt"))

    def three(name: Column) -> Column:
        v = F.coalesce(F.try_element_at("m", name), none)
        return F.array((v["dp_cnt"] > 0).cast("float"), F.log1p(v["dp_cnt"]).cast("float"), F.log1p(v["tested_cnt"]).cast("float"))

    return maps.withColumn("names", names.scalar()).select("pert", "gene", F.flatten(F.transform("names", three)).alias("prov"))


def donor_records(rows: DataFrame, fdr: float = 0.05, sign: float = 1.0, clip: float = 1.0) -> DataFrame:
    """Compact record per row: delta and lfc in single precision, flags tested 1, up 2, down 4, lfc 8."""
    parts = contributions(rows, fdr, sign, clip)
    flags = F.col("tested_cnt") * TESTED + F.col("up_cnt") * UP + F.col("down_cnt") * DOWN + F.col("lfc_cnt") * LFC_OK
    return parts.select(*OWN_KEY, F.col("dp_sum").cast("float").alias("delta"), F.col("lfc_sum").cast("float").alias("lfc"), flags.cast("tinyint").alias("flags"))


def unpack_records(records: DataFrame) -> DataFrame:
    """Records back to contributions."""
    flag = {n: (F.col("flags").bitwiseAND(b) != 0).cast("long") for n, b in (("tested", TESTED), ("up", UP), ("down", DOWN), ("lfc", LFC_OK))}
    dp, lfc = F.col("delta").cast("double"), F.col("lfc").cast("double")
    values = [dp, dp * dp, F.lit(1).cast("long"), flag["tested"], flag["up"], flag["down"], lfc, lfc * lfc, flag["lfc"]]
    return records.select(*OWN_KEY, *[v.alias(s) for v, s in zip(values, STATS, strict=True)])


def invalid_records(records: DataFrame) -> DataFrame:
    """Unknown bits, up with down, or values that are not finite: must be empty."""
    flags = F.col("flags").cast("int")
    odd = F.isnan("delta") | F.isnan("lfc") | (F.abs("delta") == float("inf")) | (F.abs("lfc") == float("inf"))
    return records.filter((flags.bitwiseAND(~15) != 0) | (flags.bitwiseAND(UP | DOWN) == UP | DOWN) | odd)


def disagreeing_totals(records: DataFrame, stored: DataFrame, rtol: float = 1e-13) -> DataFrame:
    """Context totals rebuilt from records against stored ones: counts exactly, sums to ``rtol``; must be empty."""
    keys = ["dataset", "context", "gene"]
    rebuilt = totals(unpack_records(records), *keys).select(*keys, *[F.col(s).alias(f"r_{s}") for s in STATS])
    joined = stored.join(rebuilt, keys, "full")
    wrong = [~F.col(s).eqNullSafe(F.col(f"r_{s}")) for s in COUNTS]
    sums = [s for s in STATS if s not in COUNTS]
    wrong += [F.abs(F.col(s) - F.col(f"r_{s}")) > rtol * F.greatest(F.abs(s), F.abs(f"r_{s}")) for s in sums]
    bad = wrong[0]
    for w in wrong[1:]:
        bad = bad | w
    return joined.filter(bad).select(*keys)
