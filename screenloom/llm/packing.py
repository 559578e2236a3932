"""Best-fit packing with certified bin counts, and exchange between partitions that have a gap.

Documents become token ids and a closing id; longer ones are cut into full pieces of the capacity,
the shorter piece first. Full pieces fill a sequence each. The others are dealt by hash to partitions
of some ``PER_PARTITION`` pieces and packed by best-fit decreasing. Dual feasible functions give
a lower bound on each partition's bins; a partition that meets it is certified and done. In one
with a gap, sequences exchange pieces first: those of the loosest ones and of others, drawn by a
seeded generator, are packed anew in a slightly shaken order, until the gap is closed or
``TRIES`` draws in a row saved nothing. Then the partitions that still have a gap exchange theirs: all
their pieces are dealt anew and packed again, for as long as a round saves a bin for every ``WORTH`` partitions
that it packs (one at least). Only lengths and ids
of pieces are shuffled, no text. Every row says how many bins its partition took and the bound.

Defined results. Null text is the empty text: its closing id alone. Repeated rows are packed each
on its own. Equal lengths are taken in the order of ids. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import cut_lineage, map_batches, text_or_empty

PER_PARTITION = 50_000
#: Exchanges inside a partition that may fail in a row, and sequences in each.
TRIES, DRAWN = 40, 24
#: Partitions that a round may pack for each bin that it saves; a round that costs more is the last.
WORTH = 20


@functools.cache
def encoder(tokenizer_json: str, added_tokens: bool = False):
    """Text -> uint32 ids of a byte-level BPE file, none added; ``added_tokens``: those in the text are read as such.

    The merges run in tiktoken on the file's own vocabulary, some five times faster than the library the
    file is written for; texts that it refuses or that hold an added token to be read, and vocabularies it can't
    mirror, go to that library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_json)
    slow.encode_special_tokens = not added_tokens

    def plain(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(tokenizer_json, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if added_tokens and any(t in text for t in special):
            return plain(text)
        try:
            return np.asarray(fast.encode_ordinary(text), dtype=np.uint32)
        except BaseException as e:  # the compiled part raises panics that are no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return plain(text)

    probe = " a I'll x's 12 abé 中文 \n\n  \t z!?... \U0001f600  "
    if not added_tokens:  # else such a text tells nothing of the faster path
        probe += "<|endoftext|>"
    return encode if np.array_equal(encode(probe), plain(probe)) else plain


#: Fixed value: the byte-level BPE family's pattern of pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cut_points(total: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``total`` ids: full ones, the shorter piece first."""
    return [0, *range((total - 1) % capacity + 1, total, capacity)]


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int, closing: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""

    def tokenise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json, added_tokens=True)
        for batch in it:
            out: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(batch.column("body")):
                ids = np.append(encode(text.as_py()), np.uint32(closing)).astype("<u4")
                for n, start in enumerate(starts := cut_points(len(ids), capacity)):
                    end = starts[n + 1] if n + 1 < len(starts) else len(ids)
                    out.append((row, n, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            if out:
                row, n, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                columns = [batch.column("id").take(pa.array(row)), pa.array(n.astype(np.int32)), *(pa.array(x) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32")),
        ]
    )
    return map_batches(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")), tokenise, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every item, and the number of bins."""
    return best_fit(lengths, capacity, np.argsort(-lengths, kind="stable"))


def best_fit(lengths: np.ndarray, capacity: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every item, taken in that order, and the number of bins.

    Open bins are stacked by the room they have left; a bit set over rooms finds the least one
    that suffices.
    """
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, bins = 0, 0
    for i in order.tolist():
        need = int(lengths[i])
        fitting = present >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - room
        if room > need:
            rooms[room - need].append(b)
            present |= 1 << (room - need)
    return where, offset, bins


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on bins: the best of two families of dual feasible functions, and of their compositions.

    Threshold t: items over capacity - t count as full bins, items under t as nothing. Step k:
    an item counts floor((k + 1) x / capacity) / k bins, or itself where that division is exact.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for t in np.unique(np.concatenate([[0], np.minimum(sizes[counts > 0], capacity // 2)])).tolist():
        value = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, -(-int(counts @ value) // capacity))
        if t % 16 == 0:
            for k in range(1, 9):
                scaled = (k + 1) * value
                step = np.where(scaled % capacity == 0, k * value, scaled // capacity * capacity)
                best = max(best, -(-int(counts @ step) // (k * capacity)))
    return best


def exchanged(lengths: np.ndarray, where: np.ndarray, bins: int, bound: int, capacity: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """A packing with fewer bins, if exchanges between some bins find one: (bin, offset, bins)."""
    rng = np.random.default_rng(seed)
    where = where.copy()
    failed = 0
    while bins > bound and failed < TRIES:
        loose = np.argsort(np.bincount(where, weights=lengths, minlength=bins), kind="stable")
        drawn = np.union1d(loose[: DRAWN // 2], rng.choice(bins, min(bins, DRAWN // 2), replace=False))
        own = np.flatnonzero(np.isin(where, drawn))
        shaken = np.argsort(-lengths[own] * rng.uniform(1 - 0.4 * rng.random(), 1, len(own)), kind="stable")
        found, _, n = best_fit(lengths[own], capacity, shaken)
        failed = 0 if n < len(drawn) else failed + 1
        if n <= len(drawn):  # an exchange that saves nothing still moves pieces
            names = np.concatenate([drawn[:n], [-1]])
            where[own] = names[found]
            gone = drawn[n:]
            for b in sorted(gone.tolist(), reverse=True):  # the last bins take the numbers that are free
                bins -= 1
                where[where == bins] = b
    order = np.argsort(where, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.searchsorted(where[order], np.arange(bins))
    offset = np.empty(len(lengths), dtype=np.int64)
    offset[order] = ends - lengths[order] - (ends - lengths[order])[first][where[order]]
    return where, offset, bins


def _packed(items: DataFrame, n_parts: int, round_no: int, capacity: int, before: int = 0) -> DataFrame:
    """Items dealt to ``n_parts`` partitions and packed: with sequence_id, offset, bins, bound, first (one per bin).

    ``before``: partitions of earlier rounds. Partitions are numbered on from there, so no two rounds share a sequence.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", kind="stable")
        lengths = rows["length"].to_numpy(dtype=np.int64)
        part, bound = int(rows["part"].iloc[0]), bin_bound(lengths, capacity)
        where, offset, bins = best_fit(lengths, capacity, np.argsort(-lengths, kind="stable"))
        if bins > bound:
            where, offset, bins = exchanged(lengths, where, bins, bound, capacity, seed=part)
        base = (before + part) << 32
        return rows.drop(columns="part").assign(sequence_id=base + where, offset=offset, bins=bins, bound=bound, first=offset == 0)

    dealt = items.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(n_parts)))
    longs = [T.StructField(x, T.LongType()) for x in ("sequence_id", "offset", "bins", "bound")]
    schema = T.StructType([*items.schema.fields, *longs, T.StructField("first", T.BooleanType())])
    return cut_lineage(dealt.groupBy("part").applyInPandas(pack, schema))


def pack_documents(
    docs: DataFrame,
    tokenizer_json: str,
    capacity: int = 2048,
    closing: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_partition: int = PER_PARTITION,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and bins and bound of the partition it was packed in.

    A partition with bins = bound is certified: no packing of its pieces takes fewer. A full piece is a partition of its own.
    """
    found = cut_lineage(pieces(docs, tokenizer_json, capacity, closing, id_col, text_col))
    found = found.withColumn("uid", F.monotonically_increasing_id())  # of files written already: stable
    full = found.filter(F.col("length") == capacity)
    one = F.lit(1).cast("long")
    full = full.withColumns({"sequence_id": F.col("uid").bitwiseOR(F.lit(1 << 62)), "offset": F.lit(0).cast("long"), "bins": one, "bound": one})
    items = found.filter(F.col("length") < capacity)
    settled: list[DataFrame] = [full]
    n_parts = max(1, -(-items.count() // per_partition))
    packed = _packed(items, n_parts, 0, capacity)
    round_no, before = 0, n_parts
    while True:
        left, bins, parts = packed.filter("bins > bound").agg(F.count("*"), F.count_if("first"), F.count_distinct(F.shiftright("sequence_id", 32))).first()
        if parts < 2:  # certified, or with nobody to exchange with
            break
        round_no += 1
        n_parts = -(-left // per_partition)
        again = _packed(packed.filter("bins > bound").select(items.columns), n_parts, round_no, capacity, before)
        before += n_parts
        saved = bins - again.filter("first").count()
        if saved <= 0:
            break
        settled.append(packed.filter("bins <= bound"))
        packed = again
        if saved * WORTH < n_parts:
            break
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound"]
    out = [x.select(F.col("id").alias(id_col), *names) for x in [*settled, packed]]
    return functools.reduce(DataFrame.unionByName, out)
