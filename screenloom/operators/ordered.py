"""Places, runs and chunks over one order of all rows, without a window over all rows.

Rows are dealt to ranges of the order and written once with their range's number. What a range must know of the ranges before it
(how many rows, which key came last, where the open run began) is summarised in one row a range; windows over these
summaries carry it on, and sorting or windows inside the ranges do the rest. Equal keys of the order stand in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.sources.shared import materialised

RANGE_ROWS = 1 << 20
#: A range is a task and a file: beyond these, ranges of less than RANGE_ROWS rows take more rows instead of becoming more.
MOST_RANGES = 1024


def ranges_of(n: int, range_rows: int) -> int:
    """Into how many ranges ``n`` rows go: some ``range_rows`` each, more only where there would be over MOST_RANGES small ones."""
    return max(1, min(-(-n // range_rows), max(MOST_RANGES, -(-n // max(range_rows, RANGE_ROWS)))))


def _dealt(rows: DataFrame, order: Sequence[str], range_rows: int) -> DataFrame:
    return rows.repartitionByRange(ranges_of(rows.count(), range_rows), *_ascending(order))


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def in_ranges(rows: DataFrame, order: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``part``: the number of their range of ``order``, ascending; some ``range_rows`` each. Written once."""
    return materialised(_dealt(rows, order, range_rows).withColumn("part", F.spark_partition_id()))


def _inside(order: Sequence[str]) -> W:
    return W.partitionBy("part").orderBy(*_ascending(order))


def _earlier(*by: str) -> W:
    """Summaries of the ranges before; one row a range (and group)."""
    return W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)


def places(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "place", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``: the 0-based place in ``order``, in each group of ``by``.

    A group of very many rows spreads over ranges. Rows that tie throughout ``order`` take their places in any order.
    Ranges are sorted as they are written, with each row's number in its range (the lower 33 bits of Spark's increasing id), so nothing
    but the summaries is shuffled after that; these are written too, so that Spark knows how small they are when it plans the join.
    """
    by = list(by)
    ordered = _dealt(rows, [*by, *order], range_rows).sortWithinPartitions(*_ascending([*by, *order]))
    dealt = materialised(ordered.withColumns({"part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = dealt.groupBy("part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(_earlier(*by)), F.lit(0))
    starts = materialised(counts.select("part", *by, (before - F.col("_first")).alias("_start")).withColumnsRenamed({c: f"_{c}" for c in ["part", *by]}))
    match = F.col("part") == F.col("_part")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return dealt.join(starts, match).select(*rows.columns, (F.col("_start") + F.col("_at")).alias(name))


def _differs(now: Sequence[str], before: Sequence[Column]) -> Column:
    out = F.lit(False)
    for a, b in zip(now, before, strict=True):
        out = out | ~F.col(a).eqNullSafe(b)
    return out


def runs(rows: DataFrame, order: Sequence[str], keys: Sequence[str], size: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``place``, ``run_start`` (the place at which its run of equal ``keys`` began) and ``chunk``.

    A run is cut into chunks of ``size`` rows; chunks are numbered over all rows. ``order`` must be unique.
    """
    if size < 1:
        raise ValueError(f"a chunk takes one row at least, not {size}")
    dealt = in_ranges(rows, order, range_rows)
    w = _inside(order)
    # a range's rows, and the keys at its end
    first = dealt.groupBy("part").agg(F.count("*").alias("n"), F.max_by(F.struct(*keys), F.struct(*order)).alias("end"))
    starts = first.select("part", F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("start"), F.lag("end").over(W.orderBy("part")).alias("before"))
    # a row begins a run if its keys differ from the row before it, in its range or at the end of the last one
    lagged = [F.lag(c).over(w) for c in keys]
    placed = dealt.withColumns({"at": F.row_number().over(w) - 1, "changed": _differs(keys, lagged)}).join(starts, "part")
    carried = _differs(keys, [F.col(f"before.{c}") for c in keys]) | F.col("before").isNull()
    placed = placed.withColumns({"place": F.col("start") + F.col("at"), "changed": F.when(F.col("at") == 0, carried).otherwise(F.col("changed"))}).drop("start", "before", "at")
    placed = placed.withColumn("own_start", F.max(F.when(F.col("changed"), F.col("place"))).over(w))
    # runs that are open at a range's start began in an earlier one
    opened = placed.groupBy("part").agg(F.max("own_start").alias("last"))
    opened = opened.select("part", F.max("last").over(_earlier()).alias("open"))
    placed = placed.join(opened, "part").withColumn("run_start", F.coalesce("own_start", "open")).drop("own_start", "open", "changed")
    placed = placed.withColumn("cut", ((F.col("place") - F.col("run_start")) % size == 0).cast("long"))
    chunks = placed.groupBy("part").agg(F.sum("cut").alias("c")).select("part", F.coalesce(F.sum("c").over(_earlier()), F.lit(0)).alias("chunks"))
    told = placed.withColumn("own", F.sum("cut").over(w)).join(chunks, "part")
    return told.select(*rows.columns, "place", "run_start", (F.col("chunks") + F.col("own") - 1).alias("chunk"))
