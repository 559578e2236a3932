"""Source divergence audit: how far the vocabularies of a language's sources lie apart, and each source's most over-used terms.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms of at
least ``least_docs`` of its documents. A group (language, source), and the language as a whole, gives each kept term the
share p = 1 + floor(10**9 (count + 2) / (N + 2 V)); two shares differ by f(p, q) = floor((p - q)**2 / (p + q)). All is
exact integer arithmetic.

Counting. A task counts the terms of many documents before anything is shuffled; language, source and term then
spread the counts. Divergence of two sources is V f(p0, q0), as if neither had any term (p0, q0: their shares at
count 0), plus corrections that only occurring terms need. Terms of one source are corrected by count: its histogram of counts
meets the other sources' baselines. Terms that both have are corrected in blocks of terms and of sources (two blocks of some ``BLOCK``
sources at a time), summed inside the block; no row stands for a term and a pair of sources.

Ranking. The best ``top`` terms of a group come from a radix select: histograms of the values' leading 11 bits, then of the next
ones inside the cell that holds the threshold, and so on; what ties there is refined by the UTF-8 bytes in the same
way, two at a time behind the prefix that all of them share. Once at most ``small`` rows of a group tie, they are sorted. So no group is sorted
whole, and a group of very many rows is counted in many tasks.

Defined results. Null text, language and source are the empty string. Repeated rows are documents of their own. A group without terms has
all its pairs; without kept terms their value is 0. A language of one source has no pairs. Ties go by the item's UTF-8 bytes. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.llm.common import map_batches, text_or_empty, written

#: Terms' bytes stand for themselves, A-Z for a-z, all others for a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TEXT_BLOCK = 1 << 20
#: Entries that a task counts before it passes them on.
HELD = 300_000
#: Sources in a block, rows in a block of terms, and parts into which a group's rows are dealt for joins.
BLOCK, TERM_ROWS, SALTS = 64, 16_384, 16
DIGIT = 11


def term_blocks(text: bytes, size: int = TEXT_BLOCK) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some ``size`` bytes at a time."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs), summed inside tasks; a row of null term says that the group occurs."""
    names = ["lang", "source", "term", "n", "docs"]

    def table(held: dict) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in names]
        for (lang, source), (n, seen) in held.items():
            terms = [None, *n]
            parts = ([lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(seen[t] for t in n)])
            for column, part in zip(columns, parts, strict=True):
                column += part
        lang, source, term, n, seen = columns
        arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).view(pa.string()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        entries = 0
        for batch in it:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("body").cast(pa.binary()), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in term_blocks(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                seen.update(own)
                entries += len(n) - before
                if entries > HELD:
                    yield table(held)
                    held, entries = {}, 0
        if held:
            yield table(held)

    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("body"))
    return map_batches(rows, step, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = 10, **columns: str) -> DataFrame:
    """(lang, source, term, n, total, lead): counts of kept terms, in the group and the language; ``lead`` marks one row of each term.

    A row of null term stands for each group that occurs.
    """
    counts = counted_terms(docs, **columns).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")  # as many rows as the term has sources
    spread = counts.withColumns({"seen": F.sum("docs").over(term), "total": F.sum("n").over(term), "low": F.min("source").over(term)})
    kept = spread.filter(F.col("term").isNull() | (F.col("seen") >= least_docs))
    lead = F.col("term").isNotNull() & (F.col("source") == F.col("low"))
    return written(kept.select("lang", "source", "term", "n", "total", lead.alias("lead")))


def share(count: Column, base: Column) -> Column:
    """1 + floor(10**9 (count + 2) / base) by long division, three digits at a time; exact for bases below 9 * 10**15."""
    base = F.nullif(base, F.lit(0).cast("long"))
    quotient = F.call_function("div", count + 2, base)
    rest = (count + 2) % base
    for _ in range(3):
        quotient = quotient * 1000 + F.call_function("div", rest * 1000, base)
        rest = (rest * 1000) % base
    return quotient + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(kept: DataFrame) -> DataFrame:
    """(lang, source, size, base0, terms, lang_size, blocks, block): one row per group; ``base0`` is its share at count 0."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("lead").cast("long")).alias("leads"))
    langs = sums.groupBy("lang").agg(F.sum("leads").alias("terms"), F.sum("size").alias("lang_size"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    found = sums.drop("leads").join(langs, "lang")
    zero = share(F.lit(0).cast("long"), F.col("size") + 2 * F.col("terms"))
    return written(found.withColumns({"base0": zero, "block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")}))


def dealt(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))


def copied(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, n, p, q, base0, blocks, block) of every kept term that occurs in a group."""
    rows = dealt(kept.filter("term IS NOT NULL"), "term").join(copied(groups), ["lang", "source", "salt"])
    p = share(F.col("n"), F.col("size") + 2 * F.col("terms"))
    q = share(F.col("total"), F.col("lang_size") + 2 * F.col("terms"))
    return written(rows.select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "base0", "blocks", "block"))


# --- divergence of sources ------------------------------------------------------------------------


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _common(rows: pd.DataFrame) -> pd.DataFrame:
    """Corrections of terms that two sources share, summed over a block of terms, for sources of two blocks."""
    first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    term, _ = pd.factorize(rows["term"])
    source, names = pd.factorize(rows["source"], sort=True)
    p, base0, block = (rows[c].to_numpy(dtype=np.int64) for c in ("p", "base0", "block"))
    base = np.zeros(len(names), dtype=np.int64)
    base[source] = base0
    of = np.zeros(len(names), dtype=np.int64)
    of[source] = block
    theirs = np.flatnonzero(of == second)
    place = np.full(len(names), -1, dtype=np.int64)
    place[theirs] = np.arange(len(theirs))
    table = np.zeros((term.max() + 1, len(theirs)), dtype=np.int64)
    here = block == second
    table[term[here], place[source[here]]] = p[here]
    order = np.argsort(source, kind="stable")
    bounds = np.searchsorted(source[order], np.arange(len(names) + 1))
    out: list[tuple] = []
    for s in np.flatnonzero(of == first):
        own = order[bounds[s] : bounds[s + 1]]
        sums, met = np.zeros(len(theirs), dtype=np.int64), np.zeros(len(theirs), dtype=bool)
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            x = p[part][:, None]
            k, t = np.nonzero(table[term[part]])
            y = table[term[part]][k, t]
            x, s0, t0 = x[k, 0], base[s], base[theirs[t]]
            np.add.at(sums, t, _apart(x, y) - _apart(x, t0) - _apart(s0, y) + _apart(s0, t0))
            met[t] = True
        out += [(names[s], names[theirs[t]], int(sums[t])) for t in np.flatnonzero(met) if first != second or names[s] < names[theirs[t]]]
    found = pd.DataFrame(out, columns=["a", "b", "value"])
    found.insert(0, "lang", rows["lang"].iloc[0])
    return found


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways."""
    # what two sources would differ by without any term
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = groups.select("lang", F.col("source").alias("a"), F.col("base0").alias("x"), "terms", F.col("block").alias("i"), every.alias("j"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("base0").alias("y"), F.col("block").alias("j"), every.alias("i"))
    plain = F.coalesce(F.col("terms") * apart(F.col("x"), F.col("y")), F.lit(0))
    both = left.join(right, ["lang", "i", "j"])
    parts = both.filter("a <> b").select("lang", "a", "b", plain.alias("value"))
    # terms of one source, by their counts, against the other's baseline
    counts = rows.groupBy("lang", "source", "p", "base0", "blocks").agg(F.count("*").alias("h"))
    mine = dealt(counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "p")
    theirs = copied(groups.select("lang", F.col("source").alias("b"), F.col("base0").alias("y"), F.col("block").alias("j")))
    lone = mine.join(theirs, ["lang", "j", "salt"]).filter("source <> b")
    moved = F.sum(F.col("h") * (apart(F.col("p"), F.col("y")) - apart(F.col("base0"), F.col("y"))))
    lone = lone.groupBy("lang", F.col("source").alias("a"), "b").agg(moved.alias("value"))
    # terms that both have, in blocks
    deal = max(1, -(-rows.count() // TERM_ROWS))
    at = rows.withColumns({"part": F.pmod(F.xxhash64("term"), F.lit(deal)), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    at = at.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("lang", "part", "i", "j", "source", "term", "p", "base0", "block")
    common = at.groupBy("lang", "part", "i", "j").applyInPandas(_common, "lang string, a string, b string, value long")
    for x in (lone, common):
        ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")
        parts = parts.unionByName(x.select("lang", "value", ways).select("lang", "w.a", "w.b", "value"))
    return parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))


# --- radix select ---------------------------------------------------------------------------------


def _cell(counts: DataFrame, keys: Sequence[str], digit: Column) -> DataFrame:
    """(keys, digit, n, need) -> the cell of each group in which the need-th row lies: (keys, digit, n, need), need counted inside the cell."""
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy(digit).rowsBetween(W.unboundedPreceding, 0))
    told = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    return told.select(*keys, "digit", "n", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))


def value_thresholds(rows: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """(keys, value, n, need): each group's top-th value, the rows that have it and how many of them are wanted; smaller groups are absent.

    ``rows`` hold values of 0 and more. One histogram of 2**DIGIT cells at most is made of a group in each round.
    """
    bits = int(rows.agg(F.max("value")).first()[0] or 0).bit_length()
    found = None
    for low in range(-(-bits // DIGIT) * DIGIT - DIGIT if bits else 0, -1, -DIGIT):
        cell = F.shiftright("value", low).alias("digit")
        if found is None:
            counts = rows.groupBy(*keys, cell).agg(F.count("*").alias("n")).withColumn("need", F.lit(top).cast("long"))
        else:
            inside = dealt(rows, "item").join(copied(found), [*keys, "salt"]).filter(F.shiftright("value", low + DIGIT) == F.col("digit"))
            counts = inside.groupBy(*keys, cell, "need").agg(F.count("*").alias("n"))
        found = written(_cell(counts, keys, F.col("digit").desc()))
    return found.withColumnRenamed("digit", "value")


def _shared_prefix(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        lengths = []
        for a, b in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
            n = min(len(a), len(b))
            x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
            differ = np.flatnonzero(x != y)
            lengths.append(int(differ[0]) if len(differ) else n)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("low", "high")), pa.array(lengths, pa.int32())], names=[*(c for c in batch.schema.names if c not in ("low", "high")), "skip"])


def first_by_bytes(ties: DataFrame, keys: Sequence[str], small: int) -> DataFrame:
    """The ``need`` rows of each group that come first by their items' UTF-8 bytes; items of a group are distinct, and at least ``need``."""
    names = ", ".join(f"{k} {ties.schema[k].dataType.simpleString()}" for k in keys)
    taken, open_ = [], written(ties.select(*keys, "item", "need"))
    while True:
        sizes = open_.groupBy(*keys, "need").agg(F.count("*").alias("rows"), F.min(F.encode("item", "utf-8")).alias("low"), F.max(F.encode("item", "utf-8")).alias("high"))
        large = sizes.filter(F.col("rows") > small)
        large = written(map_batches(large.select(*keys, "low", "high"), _shared_prefix, f"{names}, skip int"))
        sorted_ = W.partitionBy(*keys).orderBy("item")
        rest = open_.join(large, list(keys), "left_anti")
        taken.append(rest.withColumn("at", F.row_number().over(sorted_)).filter("at <= need").select(*keys, "item"))
        if large.isEmpty():
            break
        digit = F.substring(F.encode("item", "utf-8"), F.col("skip") + 1, F.lit(2))
        cells = written(dealt(open_, "item").join(copied(large), [*keys, "salt"]).select(*keys, "item", "need", digit.alias("cell")))
        counts = cells.groupBy(*keys, F.col("cell").alias("digit"), "need").agg(F.count("*").alias("n"))
        at = _cell(counts, keys, F.col("digit").asc()).select(*keys, "digit", F.col("need").alias("left"))
        placed = dealt(cells, "item").join(copied(at), [*keys, "salt"])
        taken.append(placed.filter(F.col("cell") < F.col("digit")).select(*keys, "item"))
        open_ = written(placed.filter(F.col("cell") == F.col("digit")).select(*keys, "item", F.col("left").alias("need")))
    found = taken[0]
    for x in taken[1:]:
        found = found.unionByName(x)
    return found


def top_rows(rows: DataFrame, keys: Sequence[str], top: int, small: int = 4096) -> DataFrame:
    """(keys, item, value) with rank: the ``top`` rows of each group by value descending, then item ascending by bytes; values of 0 and more."""
    limits = value_thresholds(rows, keys, top)
    salted = copied(limits.select(*keys, F.col("value").alias("limit"), "need", F.col("n").alias("tied")))
    placed = dealt(rows, "item").join(salted, [*keys, "salt"], "left")
    above = placed.filter("limit IS NULL OR value > limit OR (value = limit AND tied = need)").select(*keys, "item", "value")
    ties = placed.filter("value = limit AND tied > need").select(*keys, "item", "need")
    first = first_by_bytes(ties, keys, small).join(limits.select(*keys, "value"), list(keys))
    best = above.unionByName(first.select(*keys, "item", "value"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "item")))


# --- the operator ---------------------------------------------------------------------------------


def audit_sources(
    docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", small: int = 4096
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` against every other source, part ``term`` the best ``top`` terms of a group."""
    kept = kept_terms(docs, least_docs, lang_col=lang_col, source_col=source_col, text_col=text_col)
    groups = groups_of(kept)
    rows = shares(kept, groups)
    best_first = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # one row for each other source
    pairs = pair_values(rows, groups).withColumn("rank", F.row_number().over(best_first))
    over = written(rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")))
    terms = top_rows(over, ["lang", "source"], top, small)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(names).unionByName(terms.withColumn("part", F.lit("term")).select(names))
