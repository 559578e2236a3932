"""Vector code compression: product quantisation in exact integers.

Every component x becomes floor(4096 x). A vector is cut into equal parts, and each part position has a codebook, first
that part of the vectors of smallest id. A round assigns every part to its nearest entry and moves each entry
to the floored mean of its parts. A round is one map over the table, which carries one sum and count for each entry out of
each task, and one aggregation of these; the codebooks (entries x components numbers) are all that the driver
holds and sends around. The table is read once for its longest vector, once for the first entries, once a round
and once for the codes; write it down first if it comes from an expensive plan.

Nearest entries are screened by one float32 matrix product a part. |fl(x.c) - x.c| is at most g |x||c| with
g = (w + 2) u / (1 - (w + 2) u) for parts of w components and u = 2**-24 (two roundings of the inputs, w of the sum, in any order), so
each entry's distance lies in an interval. Where the intervals of several entries overlap the best one, these alone are
computed again in int64, and the lowest index wins a tie. Results are those of exact arithmetic throughout.

Defined results. A row is left out if its vector is null, holds a null or non-finite component, or one so large
that squared distances would pass 63 bits (with n components an integer over sqrt(2**63 / n) / 2). Vectors shorter than the
longest, or whose length is no multiple of the number of parts, are filled up with zeros. Order is ascending id (null first), then the
components. Fewer vectors than entries: as many entries. Repeated rows stay. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import map_batches, written

SCALE = 4096
UNIT = 2.0**-24
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), dtype=np.uint8).reshape(256, 2)


def largest(length: int) -> int:
    """The largest component with which squared distances of ``length`` components stay below 2**63."""
    return math.isqrt(((1 << 63) - 1) // max(length, 1)) // 2


def integers(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(floor(SCALE x), filled up to ``length``; positions) of the rows that are kept."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    wrong = ~(np.abs(values) <= largest(length))  # null and NaN, too
    sizes = np.maximum(lengths, 0)
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], np.cumsum(wrong)])
    keep = (lengths >= 0) & (before[ends] == before[ends - sizes])
    if len(sizes) and (sizes == length).all():
        return values.reshape(len(sizes), length)[keep].astype(np.int64), np.flatnonzero(keep)
    out = np.zeros((len(sizes), length), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
    good = keep[row]
    out[row[good], place[good]] = values[good].astype(np.int64)
    return out[keep], np.flatnonzero(keep)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, whether float32 alone decided it) for rows of int64 parts; ties go to the lower index."""
    width = x.shape[1]
    g = (width + 2) * UNIT / (1 - (width + 2) * UNIT)
    square = (book * book).sum(axis=1)
    lengths = np.sqrt((x * x).sum(axis=1).astype(np.float64)), np.sqrt(square.astype(np.float64))
    reach = np.outer(*lengths)
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    # squared distance less |x|**2; the last term covers the rounding of this line and of the lengths in float64
    score = square - 2 * product
    slack = 2 * g * reach + 2.0**-48 * (square + 2 * reach)
    near = score - slack <= (score + slack).min(axis=1, keepdims=True)
    index, sure = near.argmax(axis=1), near.sum(axis=1) == 1
    again = np.flatnonzero(~sure)
    if len(again):
        exact = square - 2 * (x[again] @ book.T)
        index[again] = np.where(near[again], exact, np.iinfo(np.int64).max).argmin(axis=1)
    return index, sure


def _rows(table: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    vector: Column = F.col(f"`{vector_col}`")
    kind = table.schema[vector_col].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        vector = vector.cast("array<double>")
    return table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("vector"))


def longest(rows: DataFrame) -> int:
    """Components of the longest vector that holds no null and nothing non-finite."""
    fine = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is above infinity here
    return rows.agg(F.max(F.when(fine, F.size("vector")))).first()[0] or 0


def first_entries(rows: DataFrame, length: int, entries: int) -> np.ndarray:
    """The kept vectors of the smallest ids, (entries, length) integers; as many rows as a codebook has."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, kept = integers(batch.column("vector"), length)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * length), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), lists], names=["id", "x"])

    schema = T.StructType([rows.schema["id"], T.StructField("x", T.ArrayType(T.LongType()))])
    found = map_batches(rows.select("id", "vector"), step, schema).orderBy(F.col("id").asc_nulls_first(), "x").limit(entries)
    first = [r["x"] for r in found.collect()]
    return np.array(first, dtype=np.int64).reshape(len(first), length)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, entries, width) after one round."""
    parts, entries, width = books.shape

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in it:
            x, _ = integers(batch.column("vector"), parts * width)
            for at in range(0, len(x), 1 << 15):
                block = x[at : at + (1 << 15)]
                block = block.reshape(len(block), parts, width)
                for p in range(parts):
                    own = np.ascontiguousarray(block[:, p])
                    index, _ = nearest(own, books[p])
                    # one-hot product in float64, exact: 2**15 rows of components below 2**31
                    chosen = (np.arange(entries)[:, None] == index).astype(np.float64)
                    sums[p] += (chosen @ own.astype(np.float64)).astype(np.int64)
                    counts[p] += np.bincount(index, minlength=entries)
        used = np.argwhere(counts > 0)
        picked = [sums[p, e] for p, e in used]
        columns = [pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)), pa.array(counts[counts > 0])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tolist() for s in picked], type=pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    found = map_batches(rows.select("vector"), step, "part int, entry int, n long, total array<long>")
    means = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    books = books.copy()
    for r in means.collect():  # one row for each entry
        books[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return books


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error, rescued): rescued counts the parts that float32 could not decide."""
    parts, _, width = books.shape
    fields = [rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("rescued", T.IntegerType())]

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, kept = integers(batch.column("vector"), parts * width)
            x = x.reshape(len(x), parts, width)
            index = np.zeros((len(x), parts), dtype=np.int64)
            error, unsure = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int32)
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p])
                index[:, p], sure = nearest(own, books[p])
                unsure += ~sure
                apart = own - books[p][index[:, p]]
                error += (apart * apart).sum(axis=1)
            text = np.ascontiguousarray(_HEX[index].reshape(len(x), 2 * parts)).view(f"S{2 * parts}").ravel()
            at = pa.array(kept)
            columns = [batch.column("id").take(at), batch.column("label").take(at), pa.array(text.tolist(), type=pa.binary()).cast(pa.string()), pa.array(error), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return map_batches(rows, step, T.StructType(fields))


def fit_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after all rounds; no entries if no vector is kept."""
    width = -(-longest(rows) // parts)
    start = first_entries(rows, parts * width, entries)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    if len(start):
        for _ in range(rounds):
            books = moved(rows, books)
    return books


def compress_vectors(
    table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """Per kept row: id, code (two hex digits a part), error, label_error, codebooks_sha256, rescued.

    The sums of a label come back by a join on the label; adaptive execution splits a label that holds much of the rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits takes 1 to 256 entries")
    rows = _rows(table, id_col, label_col, vector_col)
    books = fit_codebooks(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    if books.shape[1]:
        found = written(codes(rows, books))
    else:
        found = rows.filter("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("rescued"))
    totals = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "rescued"
    )
