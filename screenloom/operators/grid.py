"""Delta grid: percentile fit, bins, quantisation, two-hot targets, bin centres."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.sources.shared import materialised

MISSING = -100


@dataclass(frozen=True)
class Grid:
    """Odd number of equal bins over [-top, top]."""

    top: float
    bins: int


#: Ranks of a sketch are right to one part in ACCURACY; the last selection sorts SELECTED distinct values of a group at most.
ACCURACY, SELECTED = 10_000, 1 << 20


def _bracketed(values: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """(keys, w, m): rows of each distinct value inside its group's bracket, and of all values below it under a null w; values above are left out."""
    told = values.join(brackets, list(by))
    inside = told.filter(F.col("v") <= F.col("high")).groupBy(*by, F.when(F.col("v") >= F.col("low"), F.col("v")).alias("w"))
    return inside.agg(F.count("*").alias("m"))


def percentile_brackets(values: DataFrame, share: float, by: Sequence[str], accuracy: int = ACCURACY, inside: DataFrame | None = None) -> DataFrame:
    """(keys, low, high, n, first, last, part): two values around the ranks wanted, from one mergeable quantile sketch a group.

    ``first`` and ``last`` are the 0-based ranks that ``share`` falls between, in the whole group. With ``inside``, brackets of an earlier
    round with ``below``, only values in these are sketched.
    """
    v = F.col("v")
    spread = 2.0 / accuracy
    if inside is None:
        shares = [max(0.0, share - spread), min(1.0, share + spread)]
        told = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", shares, accuracy).alias("q"))
        position = share * (F.col("n") - 1)
        told = told.withColumns({"first": F.floor(position), "last": F.ceil(position), "part": position - F.floor(position)})
        # at the ends of the range, and where an error of one rank would matter, the least and the greatest value stand
        few = F.col("n") <= 4 * accuracy
        low = F.when(few | (F.lit(share - spread) <= 0), F.col("least")).otherwise(F.col("q")[0])
        high = F.when(few | (F.lit(share + spread) >= 1), F.col("most")).otherwise(F.col("q")[1])
        return told.select(*by, low.alias("low"), high.alias("high"), "n", "first", "last", "part")
    kept = values.join(inside, list(by)).filter((v >= F.col("low")) & (v <= F.col("high")))
    grid = [i / 256 for i in range(257)]
    told = kept.groupBy(*by).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", grid, accuracy).alias("q")).join(inside, list(by))
    at = [(F.col(r) - F.col("below")) / F.col("c") for r in ("first", "last")]
    under, over = F.floor((at[0] - spread) * 256).cast("int"), F.ceil((at[1] + spread) * 256).cast("int") + 1
    few = F.col("c") <= 4 * accuracy
    low = F.when(few | (under <= 0), F.col("least")).otherwise(F.get("q", F.greatest(under, F.lit(0))))
    high = F.when(few | (over >= 256), F.col("most")).otherwise(F.get("q", F.least(over, F.lit(256))))
    return told.select(*by, low.alias("low"), high.alias("high"), "n", "first", "last", "part")


def exact_percentile(rows: DataFrame, value: str, share: float, *keys: str, accuracy: int = ACCURACY, selected: int = SELECTED) -> DataFrame:
    """(keys, p): exact, linearly interpolated percentile of finite values; groups without values have no row.

    Values are written once. A quantile sketch brackets the ranks wanted in some 4 n / ``accuracy`` rows whatever the values are; one pass counts
    what lies below and keeps what lies inside, ties counted together. While a group has more than ``selected`` distinct values
    there, the inside is sketched again. Only then values are put in order.
    """
    v = F.col("v")
    named = rows.select(*keys, F.col(value).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    by = list(keys) or ["g"]
    named = materialised(named if keys else named.withColumn("g", F.lit(0)))
    brackets = materialised(percentile_brackets(named, share, by, accuracy))
    while True:
        counted = materialised(_bracketed(named, brackets.select(*by, "low", "high"), by))
        told = counted.groupBy(*by).agg(F.count("w").alias("distinct"), F.coalesce(F.max(F.when(F.col("w").isNull(), F.col("m"))), F.lit(0)).alias("below"))
        if told.filter(F.col("distinct") > max(selected, 4 * accuracy)).isEmpty():
            break
        brackets = materialised(percentile_brackets(named, share, by, accuracy, brackets.join(told, by)))
    upto = F.sum("m").over(W.partitionBy(*by).orderBy(F.col("w").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).filter("w IS NOT NULL").join(brackets.select(*by, "first", "last", "part"), by)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("upto") - F.col("m") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("w")))

    found = ranked.groupBy(*by).agg(at("first").alias("a"), at("last").alias("b"), F.max("part").alias("part"))
    return found.select(*keys, ((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")).alias("p"))


def delta_percentiles(rows: DataFrame, percentile: float = 99.9) -> DataFrame:
    """(dataset, p): exact, linearly interpolated percentile of finite abs(delta); datasets without values have no row."""
    sized = rows.select("dataset", F.abs(F.col("delta").cast("double")).alias("size"))
    return exact_percentile(sized, "size", percentile / 100, "dataset")


def fit(percentiles: DataFrame, ratio: float = 1.1, override: float | None = None) -> DataFrame:
    """One row (top, bins): the largest percentile over datasets; bins of width ln(ratio), made odd."""
    top = F.lit(override) if override is not None else F.max("p")
    n = F.ceil(2 * F.col("top") / math.log(ratio)).cast("int")
    return percentiles.agg(top.alias("top")).select("top", F.when(n % 2 == 0, n + 1).otherwise(n).alias("bins"))


def bins_of(top: float, ratio: float) -> Grid:
    n = math.ceil(2 * top / math.log(ratio))
    return Grid(top, n + 1 - n % 2)


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def quantize(delta: Column, top: Column, bins: Column) -> Column:
    """Bin number, clipped to the grid; MISSING where the value is not finite."""
    v = delta.cast("double")
    at = F.floor(((F.when(_finite(v), v) / top + 1) / 2) * bins).cast("int")
    return F.when(_finite(v), F.greatest(F.lit(0), F.least(at, bins - 1))).otherwise(MISSING)


def centre(bin_: Column, top: Column, bins: Column) -> Column:
    """Middle of a bin."""
    return ((bin_ + 0.5) / bins * 2 - 1) * top


def two_hot(delta: Column, top: Column, bins: Column) -> Column:
    """array<struct(bin, weight)>: the two bins whose centres enclose the value, linear weights; empty if not finite."""
    v = delta.cast("double")
    at = F.greatest(F.lit(0.0), F.least(((v / top + 1) / 2) * bins - 0.5, (bins - 1).cast("double")))
    low = F.least(F.floor(at), bins - 2).cast("int")
    high_weight = at - low
    pair = F.array(
        F.struct(low.alias("bin"), (1 - high_weight).alias("weight")),
        F.struct((low + 1).alias("bin"), high_weight.alias("weight")),
    )
    kind = "array<struct<bin:int,weight:double>>"
    return F.when(_finite(v), pair.cast(kind)).otherwise(F.array().cast(kind))


def tempered(logits: Column, temperature: float) -> Column:
    """A logit list divided by its temperature."""
    return F.transform(logits, lambda x: x / temperature)


def readout(de_logits: Column, delta_logits: Column, top: Column, bins: Column, t_de: float = 4.0, t_delta: float = 4.5) -> tuple[Column, Column]:
    """(probability that the gene responds, delta at the strongest bin); the first of the two logits is "no effect"."""
    tempered_de, tempered_delta = tempered(de_logits, t_de), tempered(delta_logits, t_delta)
    p = 1 / (1 + F.exp(F.get(tempered_de, 0) - F.get(tempered_de, 1)))
    best = F.array_position(tempered_delta, F.array_max(tempered_delta)) - 1
    return p, centre(best, top, bins)


def control_features(means: DataFrame, *keys: str) -> DataFrame:
    """[z, log1p(100 z), z = 0] per gene; a context with any missing mean gives zeros throughout."""
    z = F.col("value").cast("double")
    odd = F.max(F.coalesce(F.isnan(z), F.lit(True)) | z.isNull()).over(W.partitionBy(*keys))
    three = F.array(z, F.log1p(100 * z), (z == 0).cast("double"))
    return means.select(*keys, "gene", F.when(odd, F.array(*[F.lit(0.0)] * 3)).otherwise(three).alias("features"))
