"""Batches and blended sampling.

``blended_epochs`` is the sampler over tables; ``BlendedSampler`` deals one process's index lists by a fixed generator protocol, for loaders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.operators.ordered import RANGE_ROWS, places, runs
from screenloom.sources.shared import materialised


def apportion(weights: DataFrame, total: int) -> DataFrame:
    """(idx, weight) to (idx, n): largest remainders, ties by index; the shares sum to ``total``."""
    every = W.partitionBy()
    shared = weights.withColumn("x", F.lit(total) * F.col("weight") / F.sum("weight").over(every)).withColumn("low", F.floor("x"))
    rest = F.lit(total) - F.sum("low").over(every)
    # fractions are compared to 1e-9, so that equal weights tie
    rank = F.row_number().over(W.orderBy(F.round(F.col("x") - F.col("low"), 9).desc(), "idx"))
    ranked = shared.select("idx", "low", rank.alias("k"), rest.alias("rest"))
    return ranked.select("idx", (F.col("low") + (F.col("k") <= F.col("rest")).cast("long")).alias("n"))


def batch_runs(rows: DataFrame, size: int, *partition: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(ord, dataset, context) with ``batch``: maximal runs of one context in the order of ``ord``, cut into chunks of ``size``.

    ``partition`` names columns that split the order (a shard, a split), each with batches of its own from 0; without any, the
    order is one. ``ord`` is unique. Ranges of the order are worked on side by side, so neither a shard nor the whole is one task.
    """
    cut = runs(rows, [*partition, "ord"], [*partition, "dataset", "context"], size, range_rows).withColumnRenamed("chunk", "batch")
    if partition:
        first = cut.groupBy(*partition).agg(F.min("batch").alias("_first"))
        cut = cut.join(first, list(partition)).withColumn("batch", F.col("batch") - F.col("_first"))
    return cut.select(*rows.columns, "batch")


def gene_groups(batched: DataFrame) -> DataFrame:
    """(batch, dataset, n, labelled) of rows with ``batch`` and ``labelled``: the rows of a batch that share a dataset's genes."""
    return batched.groupBy("batch", "dataset").agg(F.count("*").alias("n"), F.bool_and("labelled").alias("labelled"))


def mixed_groups(batched: DataFrame) -> DataFrame:
    """(batch, dataset) of groups that mix labelled and query rows: must be empty."""
    told = batched.groupBy("batch", "dataset").agg(F.min(F.col("labelled").cast("int")).alias("low"), F.max(F.col("labelled").cast("int")).alias("high"))
    return told.filter("low <> high").select("batch", "dataset")


# --- blended sampling -----------------------------------------------------------------------------

#: A prime below 2**31, a multiplier and the rounds of the keyed permutation.
PRIME, FACTOR, ROUNDS = 2147483647, 48271, 8


def _mixed(x: Column | np.ndarray | int, key: Column | np.ndarray | int) -> Column | np.ndarray | int:
    """A number below PRIME from two numbers below it: a square modulo a prime, then a step."""
    return ((((x + key) % PRIME) * ((x + key) % PRIME) + key) % PRIME * FACTOR + key) % PRIME


def seed_key(*parts: int) -> int:
    """A key below PRIME from numbers of 0 and more."""
    key = 1
    for part in parts:
        key = _mixed(key, part % PRIME)
    return key


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The places of ``x`` in keyed pseudo-random permutations of 0 .. n - 1, element by element.

    A Feistel network over pairs from (a, b), a = ceil(sqrt(n)), b = ceil(n / a), permutes a b >= n numbers; one that
    lands beyond n - 1 goes through the network again until it does not, which ends, since its cycle leads back to ``x``. At most
    a - 1 numbers lie beyond.
    """
    if ((x < 0) | (x >= n)).any():
        raise ValueError("a place to permute lies outside its range")
    a = np.ceil(np.sqrt(n.astype(float))).astype(np.int64)
    b = np.ceil(n / np.maximum(a, 1)).astype(np.int64)

    def once(v: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
        left, right = v % a, v // a
        for i in range(ROUNDS):
            left, right = right, (left + _mixed(right % PRIME, (key + i * FACTOR) % PRIME)) % (b if i % 2 else a)
        return right * a + left

    out = once(x, a, b, key)
    while len(beyond := np.flatnonzero(out >= n)):
        out[beyond] = once(out[beyond], a[beyond], b[beyond], key[beyond])
    return out


def with_permuted(df: DataFrame, name: str, x: Column, n: Column, key: Column) -> DataFrame:
    """``df`` with ``name``: the place of ``x`` in a keyed permutation of 0 .. n - 1, as arithmetic on the row alone; all three are longs.

    The function counts as non-deterministic for one reason: Spark then computes it once a row, and not again in each condition on it.
    """

    def places_of(x: pa.Array, n: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array(permuted(*[v.to_numpy(zero_copy_only=False) for v in (x, n, key)]))

    return df.withColumn(name, F.arrow_udf(places_of, T.LongType()).asNondeterministic()(x, n, key))


def blend_problems(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(group, problem) of negative weights and of weighted groups without rows; all weights 0 is the problem of a null group. Must be empty."""
    present = rows.select("group").distinct().withColumn("there", F.lit(True))
    told = weights.join(present, "group", "left").withColumn(
        "problem", F.when(F.col("weight") < 0, "negative weight").when((F.col("weight") > 0) & F.col("there").isNull(), "no rows")
    )
    none = weights.agg(F.coalesce(F.max("weight"), F.lit(0)).alias("most")).filter("most <= 0")
    return told.filter("problem IS NOT NULL").select("group", "problem").unionByName(none.select(F.lit(None).cast(weights.schema["group"].dataType).alias("group"), F.lit("no positive weight").alias("problem")))


def blend_counts(sizes: DataFrame, weights: DataFrame, replicas: int) -> DataFrame:
    """(group, no, n, draws, start, total): what an epoch draws of each weighted group, by largest remainders; one row a group.

    An epoch draws as many rows as the weighted groups have, made a multiple of ``replicas``.
    """
    used = sizes.join(weights.filter("weight > 0"), "group").withColumn("no", F.row_number().over(W.orderBy("group")) - 1)
    total = F.ceil(F.sum("n").over(W.partitionBy()) / replicas).cast("long") * replicas
    shared = used.withColumn("total", total).withColumn("x", F.col("weight") / F.sum("weight").over(W.partitionBy()) * F.col("total")).withColumn("low", F.floor("x"))
    rest = F.col("total") - F.sum("low").over(W.partitionBy())
    # fractions are compared to 1e-9, so that equal weights tie
    rank = F.row_number().over(W.orderBy(F.round(F.col("x") - F.col("low"), 9).desc(), "no"))
    dealt = shared.withColumns({"k": rank, "rest": rest}).withColumn("draws", F.col("low") + (F.col("k") <= F.col("rest")).cast("long"))
    before = W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    return dealt.select("group", "no", "n", "draws", F.coalesce(F.sum("draws").over(before), F.lit(0)).alias("start"), "total")


def blended_epochs(rows: DataFrame, weights: DataFrame, epochs: Sequence[int], replicas: int = 1, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(group, row) and (group, weight) -> (epoch, replica, at, group, row, cycle): every draw of some epochs and its place in a replica's share.

    A group is an endless stream of cycles; each cycle takes every row once, in an order of its own, and an epoch goes on where
    the last one stopped. Draws of all groups are dealt to an epoch's slots at random; replicas own equal, contiguous shares of these.
    Both orders are keyed permutations, so a row knows by itself which draws take it: after rows are numbered in their groups nothing is
    shuffled, listed or stored, for any number of epochs. Weights and counts, one row a group, are written, so that Spark knows how small
    they are when it joins rows to them. (group, row) is unique; groups of weight 0 are never drawn.
    """
    if replicas < 1:
        raise ValueError(f"one replica at least, not {replicas}")
    used = materialised(weights.filter("weight > 0").select("group", "weight"))
    known = rows.join(used, "group", "left_semi").select("group", "row")
    placed = places(known, ["row"], ["group"], range_rows=range_rows)
    counts = materialised(blend_counts(placed.groupBy("group").agg(F.count("*").alias("n")), used, replicas).filter("draws > 0"))
    n, draws = F.col("n"), F.col("draws")
    joined = placed.join(counts, "group").withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in epochs])))
    first = F.col("epoch") * draws
    cycles = F.sequence(F.call_function("div", first, n), F.call_function("div", first + draws - 1, n))
    each = joined.withColumn("cycle", F.explode(cycles))
    cycle_key = _mixed(_mixed(F.lit(seed_key(seed, 1)).cast("long"), F.col("no")), F.col("cycle") % PRIME)
    each = with_permuted(each, "offset", F.col("place"), n, cycle_key).withColumn("k", F.col("cycle") * n + F.col("offset") - first)
    drawn = each.filter((F.col("k") >= 0) & (F.col("k") < draws))
    share = F.call_function("div", F.col("total"), F.lit(replicas).cast("long"))
    slotted = with_permuted(drawn, "slot", F.col("start") + F.col("k"), F.col("total"), _mixed(F.lit(seed_key(seed, 0)).cast("long"), F.col("epoch") % PRIME))
    return slotted.select("epoch", F.call_function("div", F.col("slot"), share).alias("replica"), (F.col("slot") % share).alias("at"), "group", "row", "cycle")


def largest_remainder(weights: list[float], total: int) -> list[int]:
    """The same on the driver."""
    raw = np.asarray(weights, dtype=float) / sum(weights) * total
    low = np.floor(raw).astype(int)
    order = sorted(range(len(weights)), key=lambda i: (-(raw[i] - low[i]), i))
    for i in order[: total - int(low.sum())]:
        low[i] += 1
    return low.tolist()


class BlendedSampler:
    """Exact per-epoch mix of groups, each drawn without replacement across epochs, in contiguous shards per replica.

    ``members`` holds each numbered group's rows and ``weights`` its weight; a weight of 0 is never drawn. The
    generator seeds are fixed values: (seed, 0, epoch) deals slots to groups, (seed, 1, group, cycle) orders a
    group's cycle. Index arithmetic on the driver: it feeds loaders, not queries.
    """

    def __init__(self, members: Mapping[int, list[int]], weights: Mapping[int, float], replicas: int = 1, rank: int = 0, seed: int = 0) -> None:
        if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
            raise ValueError("weights must be non-negative and have a positive sum")
        used = {g: np.asarray(members.get(g, ()), dtype=np.int64) for g in sorted(weights) if weights[g] > 0}
        if bare := [g for g, rows in used.items() if not len(rows)]:
            raise ValueError(f"weighted groups without rows: {bare}")
        self.members, self.seed, self.epoch = used, seed, 0
        self.share = -(-sum(map(len, used.values())) // replicas)
        self.first = rank * self.share
        self.total = self.share * replicas
        self.counts = dict(zip(used, largest_remainder([weights[g] for g in used], self.total), strict=True))

    def __len__(self) -> int:
        return self.share

    def stream(self, group: int, start: int, length: int) -> np.ndarray:
        """Places start .. start + length of the group's endless sequence of permuted cycles."""
        rows = self.members[group]
        n = len(rows)
        cycles = range(start // n, -(-(start + length) // n))
        if n == 1:
            return np.repeat(rows, length)
        orders = [np.random.default_rng([self.seed, 1, group, c]).permutation(n) for c in cycles]
        if not orders:
            return rows[:0]
        skip = start - cycles[0] * n
        return rows[np.concatenate(orders)[skip : skip + length]]

    def __iter__(self) -> Iterator[int]:
        owner = np.array([g for g, n in self.counts.items() for _ in range(n)], dtype=np.int64)
        np.random.default_rng([self.seed, 0, self.epoch]).shuffle(owner)
        # the i-th slot of a group takes the i-th row of its stream in this epoch
        dealt = np.empty(self.total, dtype=np.int64)
        for g, n in self.counts.items():
            dealt[np.flatnonzero(owner == g)] = self.stream(g, self.epoch * n, n)
        return iter(dealt[self.first : self.first + self.share].tolist())
