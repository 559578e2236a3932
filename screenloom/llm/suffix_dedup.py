"""Removal of repeated passages with suffix arrays: every byte covered by an L-byte string seen before.

All-pairs merging of document shards by binary search would cost the square of the number of
shards, so shards are cut by content instead of by document, and everything that is equal meets in
one shard:

1. *Anchors.* In every window of L bytes the smallest K-byte hash is the window's anchor (leftmost
   on ties). Equal windows have equal anchors at equal offsets, so a run of windows with one anchor
   is a context, and equal windows lie in contexts of one anchor class. One row per context is
   shuffled, about one for 37 bytes; copies inside an Arrow batch are settled before that.
2. *Contexts.* Of contexts that agree in anchor and in a second hash (128 bits together) all but the
   first are repeats. Most of what repeats ends here without its bytes being moved.
3. *Shards.* Where one anchor class has several contexts (the edges of passages), the bytes of one
   context each are fetched and sorted by anchor class into shards of bounded size: suffix array by
   Larsson-Sadakane refinement, common prefixes by Kasai's recurrence, both in numpy; suffixes that
   share L bytes form a group, whose earliest member stays.
4. *Cross-shard merge.* An anchor class too large for one shard is split over several; the first
   window of each group is then merged across shards by binary-searchable 128-bit keys.
5. The intervals of a document are merged and cut from its bytes.

Defined results. Null text is the empty text. Texts under L bytes lose nothing. Order is ascending
id (null first), then the hash of the text; of rows repeated with equal id and text the first keeps
its bytes and each further one of at least L bytes loses all. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import map_batches, text_or_empty, written

WINDOW = 72  # K-byte strings a window chooses its anchor from; K = length - WINDOW + 1
BLOCK = 1 << 20  # bytes hashed at once
SHARD = 1 << 20  # bytes in one suffix array
CLASS = 4096  # contexts of one anchor class in one shard
PARTS = 1024  # shards of a class too large for one; a power of two
HELD = 200_000  # rows of one class held by a task
U = np.uint64


# --- rolling hashes -------------------------------------------------------------------------------


def _family(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, 256, dtype=U) | U(1), int(rng.integers(0, 2**61)) * 8 + 5


class _Rolling:
    """Polynomial hashes of all slices of a byte array, mod 2**64, from one running sum."""

    def __init__(self, seed: int) -> None:
        self.table, self.base = _family(seed)
        self.up = self.down = np.ones(1, dtype=U)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = max(len(data), BLOCK)
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(n, U(self.base))]))
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(n, U(pow(self.base, -1, 2**64)))]))
        out = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


_FIRST, _SECOND = _Rolling(11), _Rolling(12)


def block_contexts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(lo, n, h, c) of all contexts in a block of whole pieces that end at ``ends``: first window, windows, hashes."""
    k, n = length - WINDOW + 1, len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none.view(U), none.view(U)
    one, two = _FIRST.sums(data), _SECOND.sums(data)
    grams = _mixed((one[k:] - one[:-k]) * _FIRST.down[: n - k + 1])
    low = U((1 << 24) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=U)
    reach = 1
    while reach * 2 <= WINDOW:  # minimum over doubling reaches, then the rest
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < WINDOW:
        best = np.minimum(best[: len(best) - (WINDOW - reach)], best[WINDOW - reach :])
    anchor = (best & low).astype(np.int64)
    piece = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    whole = np.arange(len(anchor)) + length <= ends[piece]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none.view(U), none.view(U)
    anchor_at = anchor[at]
    new = np.flatnonzero((anchor_at[1:] != anchor_at[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    lo, hi = at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]
    chosen = anchor[lo]
    shape = ((chosen - lo) * 1024 + (hi - lo)).astype(U) * U(0x632BE59BD9B4E019)
    return lo, hi - lo + 1, grams[chosen], _mixed(_SECOND.of(two, lo, hi + length) + shape)


def _pieces(starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, start, end), about BLOCK bytes each; a longer document comes in pieces that overlap by length - 1."""
    group: list[tuple[int, int, int]] = []
    size = 0
    for d, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if e - s < length:
            continue
        while e - s > BLOCK:
            yield [(d, s, s + BLOCK)]
            s += BLOCK - length + 1
        if e - s < length:
            continue
        if size + e - s > BLOCK and group:
            yield group
            group, size = [], 0
        group.append((d, s, e))
        size += e - s
    if group:
        yield group


def batch_contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, lo, n, h, c) of all contexts; lo counts from the document's start."""
    parts = []
    for group in _pieces(starts, ends, length):
        doc, s, e = (np.array(x, dtype=np.int64) for x in zip(*group, strict=True))
        cuts = np.cumsum(e - s)
        text = np.concatenate([data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]) if len(s) > 1 else data[s[0] : e[0]]
        lo, n, h, c = block_contexts(text, cuts, length)
        piece = np.searchsorted(cuts, lo, side="right")
        parts.append((doc[piece], lo - (cuts - (e - s))[piece] + s[piece] - starts[doc[piece]], n, h, c))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(U), none.view(U)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- suffix arrays --------------------------------------------------------------------------------


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number, zeros past the end; one more zero at the end."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    words = np.zeros(len(text) + 1, dtype=U)
    for i in range(8):
        words[:-1] = (words[:-1] << U(8)) | padded[i : i + len(text)].astype(U)
    return words


def suffix_array(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least (Larsson-Sadakane refinement).

    Ranks start from eight packed bytes and double in reach; each round sorts only the groups that
    are still undecided. A rank is the place of its group's first member, so settled suffixes keep theirs.
    """
    n = len(text)
    order = np.argsort(words[:-1])
    sorted_words = words[order]
    tied = sorted_words[1:] == sorted_words[:-1]
    place = np.maximum.accumulate(np.where(np.concatenate([[True], ~tied]), np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = place, -1
    reach = 8
    while reach < depth:
        open_at = np.flatnonzero(np.concatenate([tied, [False]]) | np.concatenate([[False], tied]))
        if not len(open_at):
            break
        here = order[open_at]
        key = (place[open_at].astype(U) << U(32)) | (rank[np.minimum(here + reach, n)] + 1).astype(U)
        by = np.argsort(key)
        order[open_at], key = here[by], key[by]
        differ = np.concatenate([[True], key[1:] != key[:-1]])
        place[open_at] = np.maximum.accumulate(np.where(differ, open_at, 0))
        rank[order[open_at]] = place[open_at]
        tied = place[1:] == place[:-1]
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length (up to ``most``) of what each suffix shares with the one before it in ``order``.

    Kasai's recurrence: if the neighbour of suffix i is the next one after the neighbour of i - 1, the
    prefix is one shorter than that of i - 1. Only the starts of such runs are compared, eight bytes
    at a time.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    run = np.concatenate([[True], (before[1:] != before[:-1] + 1) | (before[1:] < 1)])
    starts = np.flatnonzero(run)
    found = np.zeros(len(starts), dtype=np.int64)
    live = np.flatnonzero(before[starts] >= 0)
    at, other = starts[live], before[starts[live]]
    # a run of s suffixes needs s bytes more to stay exact up to ``most``
    limit = np.minimum(most + np.diff(np.append(starts, n))[live], n - np.maximum(at, other))
    reach = 0
    while len(live):
        differ = words[at + reach] ^ words[other + reach]
        whole = differ == 0
        same = np.zeros((~whole).sum(), dtype=np.int64)
        for k in range(1, 8):
            same += differ[~whole] >> U(64 - 8 * k) == 0
        found[live[~whole]] = np.minimum(reach + same, limit[~whole])
        reach += 8
        done = whole & (reach >= limit)
        found[live[done]] = limit[done]
        on = whole & ~done
        live, at, other, limit = live[on], at[on], other[on], limit[on]
    which = np.cumsum(run) - 1
    length = np.where(before >= 0, np.maximum(found[which] - (np.arange(n) - starts[which]), 0), 0)
    return np.minimum(length, most)[order]


def shard_repeats(
    parts: list[bytes], windows: np.ndarray, place: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with ``windows`` windows each and order ``place``: (context, offset) of all repeats, and of all firsts."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    text = np.frombuffer(b"".join(parts), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words = packed(text)
    order = suffix_array(text, words, length)
    shared = common_prefixes(text, words, order, length)
    group = np.cumsum(shared < length)  # suffixes that share `length` bytes
    context = np.repeat(np.arange(len(parts)), sizes)[order]
    offset = order - begin[context]
    is_window = offset < windows[context]
    group, context, offset = group[is_window], context[is_window], offset[is_window]
    key = (place[context] << 32) | offset
    sort = np.lexsort((key, group))
    group, context, offset = group[sort], context[sort], offset[sort]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
    return context[~first], offset[~first], context[first], offset[first]


def _runs(context: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first offset, count) of maximal runs of consecutive offsets."""
    sort = np.lexsort((offset, context))
    context, offset = context[sort], offset[sort]
    new = np.flatnonzero((context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1 if len(context) else []
    start = np.concatenate([[0], new]).astype(np.int64)[: len(context)]
    return context[start], offset[start], np.diff(np.append(start, len(context)))


# --- the operator ---------------------------------------------------------------------------------


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and its offsets into them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), offsets


def repeated_contexts(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, lo, n, h, c, part, split): windows lo..lo+n-1 are repeats if h is null, else a context to be compared in a shard (h, part)."""

    def contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = pa.table({"id": batch.column("id"), "th": batch.column("th")})
            sort = pc.sort_indices(keys, sort_keys=[("id", "ascending"), ("th", "ascending")], null_placement="at_start")
            batch = pa.Table.from_batches([batch]).take(sort).combine_chunks()
            data, offsets = _bytes_of(batch.column("body").combine_chunks())
            ids, th = batch.column("id").combine_chunks(), batch.column("th").combine_chunks()
            starts, ends = offsets[:-1], offsets[1:].copy()
            if len(th) > 1:  # rows repeated with id and text are read once
                again = np.array(pc.and_(pc.equal(th[1:], th[:-1]), pc.or_kleene(pc.equal(ids[1:], ids[:-1]), pc.and_(pc.is_null(ids[1:]), pc.is_null(ids[:-1])))).fill_null(False))
                ends[1:][again] = starts[1:][again]
            doc, lo, n, h, c = batch_contexts(data, starts, ends, length)
            if not len(doc):
                continue
            sort = np.lexsort((c, h))  # stable: the first of equals is the earliest in the batch
            again = np.zeros(len(doc), dtype=bool)
            again[sort[1:]] = (h[sort[1:]] == h[sort[:-1]]) & (c[sort[1:]] == c[sort[:-1]])
            # what is settled here leaves as whole intervals; each goes to a place of its own
            d, e = doc[again], lo[again]
            join = np.concatenate([[True], (d[1:] != d[:-1]) | (e[1:] != e[:-1] + n[again][:-1])]) if len(d) else np.zeros(0, bool)
            new = np.flatnonzero(join)
            total = np.add.reduceat(n[again], new) if len(new) else new
            which = np.concatenate([doc[~again], d[new]])
            settled = np.arange(len(which)) >= (~again).sum()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(which)),
                    th.take(pa.array(which)),
                    pa.array(np.concatenate([lo[~again], e[new]])),
                    pa.array(np.concatenate([n[~again], total]).astype(np.int64)),
                    pa.array(np.concatenate([h[~again], _mixed(np.concatenate([h[again][new], h[:0]]) ^ np.arange(len(new), dtype=U))]).view(np.int64)),
                    pa.array(np.concatenate([c[~again], c[again][new]]).view(np.int64), mask=settled),
                ],
                names=["id", "th", "lo", "n", "h", "c"],
            )

    id_field = T.StructField("id", rows.schema["id"].dataType)
    longs = [T.StructField(x, T.LongType()) for x in ("th", "lo", "n", "h", "c")]
    found = map_batches(rows, contexts, T.StructType([id_field, *longs]))
    # dealt by ranges of (h, c): a class of very many contexts lies in several neighbouring partitions
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartitionByRange(parts, "h", "c").sortWithinPartitions("h", "c", "id", "th", "lo")
    out = [*longs, T.StructField("part", T.LongType()), T.StructField("split", T.BooleanType())]
    return map_batches(dealt, class_marks, T.StructType([id_field, *out]))


def _equal_to_previous(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first equals the one before it, nulls included."""
    a = column.combine_chunks()
    both_null = pc.and_(pc.is_null(a[1:]), pc.is_null(a[:-1]))
    return pc.or_(pc.equal(a[1:], a[:-1]).fill_null(False), both_null).to_numpy(zero_copy_only=False)


def _marked(rows: pa.Table, before: tuple | None, opened: set[int]) -> pa.Table:
    """Of sorted rows of whole classes, or of classes in ``opened``: repeats (h null), and contexts to be compared."""
    h, c = rows.column("h").to_numpy(), rows.column("c").fill_null(0).to_numpy()
    settled = rows.column("c").is_null().to_numpy(zero_copy_only=False)
    new_h = np.concatenate([[before is None or before[0] != h[0]], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[before is None or before[1] != c[0]], c[1:] != c[:-1]])
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    which = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
    contexts = np.add.reduceat((new & ~settled).astype(np.int64), start)[which]
    split = np.isin(h, list(opened)) | (contexts > CLASS)
    repeat = settled | ~new
    # of rows repeated with id and text one stands for all
    twice = np.concatenate([[before is not None and before[2:] == _place(rows, 0)], np.ones(len(h) - 1, dtype=bool)]) & ~new
    for name in ("id", "th", "lo"):
        twice[1:] &= _equal_to_previous(rows.column(name))
    keep = (repeat | (contexts > 1) | split) & ~(twice & ~settled)
    part = np.where(split, c & (PARTS - 1), 0)
    table = rows.drop_columns(["h", "c"])
    for name, values in (("h", h), ("c", c), ("part", part)):  # null for repeats
        table = table.append_column(name, pa.array(values, mask=repeat))
    return table.append_column("split", pa.array(split)).filter(pa.array(keep))


def _place(rows: pa.Table, i: int) -> tuple:
    return tuple(rows.column(x)[i].as_py() for x in ("id", "th", "lo"))


def class_marks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of (h, c, id, th, lo), a partition at a time: what repeats, and what is to be compared by bytes.

    The first and last class of a partition may go on in its neighbours, and a class of more than HELD rows is not
    held together: their contexts are all compared, in shards that are merged by window.
    """
    held: pa.Table | None = None
    before: tuple | None = None
    opened: set[int] = set()
    started = False

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal before
        marked = _marked(rows, before, opened)
        before = (rows.column("h")[-1].as_py(), rows.column("c")[-1].as_py() or 0, *_place(rows, -1))
        yield from marked.combine_chunks().to_batches()

    for batch in it:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if not started:
            started = True
            opened.add(table.column("h")[0].as_py())
        held = table if held is None else pa.concat_tables([held, table])
        h = held.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1]))
        if last:
            yield from told(held.slice(0, last))
            held = held.slice(last)
        if held.num_rows > HELD:
            opened.add(int(h[-1]))
            yield from told(held)
            held = None
    if held is not None and held.num_rows:
        opened.add(held.column("h")[0].as_py())
        yield from told(held)


def class_repeats(contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of contexts (id, th, lo, n, h, part, split, body): repeats (id, th, lo, n); and first windows (id, th, lo, x, y) of split classes."""
    id_field = contexts.schema["id"]

    def flush(rows: list[dict]) -> pa.RecordBatch:
        ids = pa.array([r["id"] for r in rows], type=id_type[0])
        keys = pa.table({"id": ids, "th": [r["th"] for r in rows], "lo": [r["lo"] for r in rows]})
        place = np.empty(len(rows), dtype=np.int64)
        place[np.array(pc.sort_indices(keys, sort_keys=[("id", "ascending"), ("th", "ascending"), ("lo", "ascending")], null_placement="at_start"))] = np.arange(len(rows))
        bodies = [r["body"] for r in rows]
        ctx, off, first_ctx, first_off = shard_repeats(bodies, np.array([r["n"] for r in rows]), place, length)
        ctx, off, count = _runs(ctx, off)
        split = np.array([r["split"] for r in rows])[first_ctx]
        first_ctx, first_off = first_ctx[split], first_off[split]
        digests = [xxhash.xxh128_digest(bodies[c][o : o + length]) for c, o in zip(first_ctx.tolist(), first_off.tolist(), strict=True)]
        xy = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
        which, lows = np.concatenate([ctx, first_ctx]), np.array([r["lo"] for r in rows], dtype=np.int64)
        opened = np.arange(len(which)) >= len(ctx)
        pad = np.zeros((len(ctx), 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(which)),
                pa.array(np.array([r["th"] for r in rows], dtype=np.int64)[which]),
                pa.array(lows[which] + np.concatenate([off, first_off])),
                pa.array(np.concatenate([count, np.ones(len(first_ctx), dtype=np.int64)])),
                *(pa.array(np.concatenate([pad, xy])[:, i], mask=~opened) for i in (0, 1)),
            ],
            names=["id", "th", "lo", "n", "x", "y"],
        )

    id_type: list[pa.DataType] = [pa.null()]

    def shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size, last = 0, None
        for batch in it:
            id_type[0] = batch.schema.field("id").type
            for row in batch.to_pylist():
                if rows and all(rows[-1][x] == row[x] for x in ("h", "part", "id", "th", "lo")):
                    continue  # rows repeated with id and text
                if size >= SHARD and (row["split"] or (row["h"], row["part"]) != last):
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row["body"]), (row["h"], row["part"])
        if rows:
            yield flush(rows)

    longs = [T.StructField(x, T.LongType()) for x in ("th", "lo", "n", "x", "y")]
    dealt = contexts.repartition("h", "part").sortWithinPartitions("h", "part", "id", "th", "lo")
    found = written(map_batches(dealt, shards, T.StructType([T.StructField("id", id_field.dataType), *longs])))
    return found.filter("x IS NULL").select("id", "th", "lo", "n"), found.filter("x IS NOT NULL").drop("n")


def remove_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """Per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, if ``with_text``)."""
    if length <= WINDOW:
        raise ValueError(f"length must exceed {WINDOW} bytes")
    body = text_or_empty(text_col)
    # the hash of the text tells rows apart that share an id; where none do, it need not be moved
    repeated = not docs.groupBy(id_col).count().filter("count > 1").isEmpty()
    told = F.xxhash64(body) if repeated else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), told.alias("th"), body.cast("binary").alias("body"))
    decided = written(repeated_contexts(rows, length))
    wanted = decided.filter("h IS NOT NULL").select("id", "th", F.struct("lo", "n", "h", "part", "split").alias("w"))
    wanted = wanted.groupBy(F.col("id").alias("wid"), F.col("th").alias("wth")).agg(F.collect_list("w").alias("ws"))
    fetched = rows.join(wanted, rows["id"].eqNullSafe(wanted["wid"]) & (rows["th"] == wanted["wth"]))
    contexts = fetched.select("id", "th", "body", F.explode("ws").alias("w")).select(
        "id", "th", "w.*", F.substring("body", F.col("w.lo") + 1, F.col("w.n") + length - 1).alias("body")
    )
    repeats, firsts = class_repeats(contexts, length)
    # split classes: all but the earliest of equal first windows are repeats too
    merged = firsts.groupBy("x", "y").agg(F.min(F.struct("id", "th", "lo")).alias("m"))
    later = firsts.join(merged, ["x", "y"]).filter(~F.struct("id", "th", "lo").eqNullSafe(F.col("m")))
    gone = (
        decided.filter("h IS NULL").select("id", "th", "lo", "n").unionByName(repeats).unionByName(later.select("id", "th", "lo", F.lit(1).cast("long").alias("n")))
    )
    spans = gone.groupBy(F.col("id").alias("sid"), F.col("th").alias("sth")).agg(
        F.collect_list("lo").alias("los"), F.collect_list("n").alias("ns")
    )
    joined = rows.join(spans, rows["id"].eqNullSafe(spans["sid"]) & (rows["th"] == spans["sth"]), "left")
    numbered = joined.withColumn("copy", F.row_number().over(W.partitionBy("id", "th").orderBy("th")))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            for text, los, ns, copy in zip(*(batch.column(x).to_pylist() for x in ("body", "los", "ns", "copy")), strict=True):
                lo, hi = np.array(los or [], dtype=np.int64), np.array(ns or [], dtype=np.int64)
                if copy > 1 and len(text) >= length:
                    lo, hi = np.array([0]), np.array([len(text) - length + 1])
                hi = lo + hi + length - 1
                sort = np.argsort(lo, kind="stable")
                lo, hi = lo[sort], np.maximum.accumulate(hi[sort])
                new = np.concatenate([[True], lo[1:] > hi[:-1]]) if len(lo) else np.zeros(0, dtype=bool)
                begin, end = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)] if len(lo) else hi
                edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept))
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [batch.column("id"), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays if with_text else arrays[:-1], names=names if with_text else names[:-1])

    fields = [T.StructField(id_col, docs.schema[id_col].dataType)]
    fields += [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.BinaryType())] if with_text else []
    return map_batches(numbered.select("id", "body", "los", "ns", "copy"), cut, T.StructType(fields))
