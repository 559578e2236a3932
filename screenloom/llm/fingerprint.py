"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash up to a fixed fraction of the hash range, so sketches of any two
documents are samples of the same hashes: they merge by union, and shares of one text in another
are estimated however unequal the two are. A sketch carries its threshold; a comparison and a merge use
the lower of two. The parameter ``least`` raises the threshold of a text that has fewer hashes below the fraction,
so far that its ``least`` smallest are kept: short texts then keep a sketch that tells something. 0 switches that
off. Everything is one expression on the text column, without a shuffle.

``near_neighbours`` edits each text with the start of the next document's. Documents are dealt by
ranges of ids (bounds from a percentile sketch, for ids that are no numbers from Spark's range partitioning; found by
binary search in the plan), and each range receives a copy of the next range's first document, so no global window is needed.

Defined results. Null text is the empty text. Texts without words have an empty sketch: likeness 1
to each other and 0 to all others. Fewer words than a shingle: the whole sequence is one. Order is
ascending id (null first), then the hash of the text; repeated rows follow each other. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import text_or_empty

WIDTH = 5
FRACTION = 1 / 8
LEAST = 8
ALL = (1 << 63) - 1
RANGE_ROWS = 2000
MOST_RANGES = 65_535


def with_sketch(
    df: DataFrame, text: Column, name: str, width: int = WIDTH, fraction: float = FRACTION, least: int = LEAST
) -> DataFrame:
    """``df`` with ``name``: struct(hashes array<long> ascending, limit long): all hashes up to ``limit``."""
    ceiling = int(-(2**63) + fraction * 2**64) - 1
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = df.withColumn(f"{name}_w", F.transform(words, lambda w: F.xxhash64(w)))
    w, n = F.col(f"{name}_w"), F.size(f"{name}_w")
    shingle = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[w[i + j] for j in range(width)]))
    # of a text with fewer words the whole sequence; of none nothing
    short = F.when(n == 0, F.array().cast("array<long>")).otherwise(
        F.array(F.aggregate(w, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
    )
    hashed = hashed.withColumn(f"{name}_h", F.when(n >= width, shingle).otherwise(short)).drop(f"{name}_w")
    h = F.col(f"{name}_h")
    hashed = hashed.withColumn(f"{name}_b", F.array_sort(F.array_distinct(F.filter(h, lambda x: x <= ceiling))))
    hashed = hashed.withColumn(
        f"{name}_s", F.when(F.size(f"{name}_b") < least, F.slice(F.array_sort(F.array_distinct(h)), 1, least + 1))
    )
    b, s = F.col(f"{name}_b"), F.col(f"{name}_s")
    scaled = F.struct(b.alias("hashes"), F.lit(ceiling).alias("limit"))
    whole = F.struct(s.alias("hashes"), F.lit(ALL).alias("limit"))
    lowest = F.struct(F.slice(s, 1, least).alias("hashes"), F.element_at(s, least).alias("limit"))
    found = F.when(F.size(b) >= least, scaled).when(F.size(s) <= least, whole).otherwise(lowest)
    return hashed.withColumn(name, found).drop(f"{name}_h", f"{name}_b", f"{name}_s")


def sketch_text(sketch: Column) -> Column:
    """A sketch as text: its limit and its hashes, 16 hex digits each."""
    digits = F.transform(F.concat(F.array(sketch["limit"]), sketch["hashes"]), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column, jaccard: bool = False) -> Column:
    """Share of the smaller document's shingles found in the other (or of the union), estimated, 0 to 1."""
    limit = F.least(a["limit"], b["limit"])
    x, y = (F.filter(s["hashes"], lambda h: h <= limit) for s in (a, b))
    both = F.size(F.array_intersect(x, y))
    base = F.size(x) + F.size(y) - both if jaccard else F.least(F.size(x), F.size(y))
    empty = F.when((F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0), 1.0).otherwise(0.0)
    return F.when(base > 0, both / base).otherwise(empty)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, known up to the lower of the two thresholds."""
    limit = F.least(a["limit"], b["limit"])
    both = F.array_sort(F.array_union(a["hashes"], b["hashes"]))
    return F.struct(F.filter(both, lambda h: h <= limit).alias("hashes"), limit.alias("limit"))


def _bounds(rows: DataFrame, ranges: int) -> list:
    """Ids that part the rows into about that many ranges, ascending."""
    if isinstance(rows.schema["id"].dataType, T.NumericType) and not isinstance(rows.schema["id"].dataType, T.DecimalType):
        shares = [(i + 1) / ranges for i in range(ranges - 1)]
        return sorted(set(rows.agg(F.percentile_approx("id", shares, max(10_000, 8 * ranges))).first()[0] or ()))
    tops = rows.filter("id IS NOT NULL").repartitionByRange(ranges, "id").groupBy(F.spark_partition_id()).agg(F.max("id").alias("top"))
    return sorted({r["top"] for r in tops.collect()})[:-1]  # a row per range


def _ranges(rows: DataFrame) -> Column:
    """Number of the row's range of ids; about RANGE_ROWS rows each, equal ids together; ids of any type in order."""
    most = min(MOST_RANGES, rows.count() // RANGE_ROWS)
    bounds = _bounds(rows, most + 1) if most else []
    if not bounds:
        return F.lit(0)
    depth = len(bounds).bit_length()
    padded = F.lit(bounds + [bounds[-1]] * ((1 << depth) - len(bounds)))
    # binary search for the number of bounds that lie below the id; steps beyond the bounds are not taken
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(depth))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(padded, at + step - 1) < F.col("id")), at + step).otherwise(at),
    )


def near_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """Per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (and Jaccard estimates)."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    rows = rows.withColumn("th", F.xxhash64("body"))
    rows = rows.withColumn("range", _ranges(docs.select(F.col(id_col).alias("id"))))
    # the first document of the next range, after the last range of the first; at most MOST_RANGES + 1 rows
    order = W.orderBy("range")
    firsts = rows.groupBy("range").agg(F.min(F.struct("id", "th")).alias("key"))
    following = firsts.select(
        F.col("range").alias("into"),
        F.coalesce(F.lead("key").over(order), F.first("key").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("key"),
    )
    match = rows["id"].eqNullSafe(F.col("key.id")) & (rows["th"] == F.col("key.th"))
    guests = rows.join(F.broadcast(following), match).dropDuplicates(["into"])
    guests = guests.select("id", "th", "body", F.col("into").alias("range"), F.lit(1).alias("guest"))
    sketched = with_sketch(rows.withColumn("guest", F.lit(0)).unionByName(guests), F.col("body"), "own", fraction=fraction, least=least)
    lined = W.partitionBy("range").orderBy("guest", "id", "th")
    paired = sketched.select(
        "id", "guest", "body", "own", F.lead("body").over(lined).alias("next_body"), F.lead("own").over(lined).alias("next_own")
    ).filter("guest = 0")
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), n - half), F.substring("next_body", F.lit(1), half))
    made = paired.select("id", "own", "next_own", n.cast("long").alias("n_chars"), edited.alias("edited"))
    done = with_sketch(made, F.col("edited"), "new", fraction=fraction, least=least)
    own, new, after = F.col("own"), F.col("new"), F.col("next_own")
    return done.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch_text(own).alias("fingerprint"),
        sketch_text(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"),
        likeness(own, after).alias("near_next"),
        likeness(own, new, jaccard=True).alias("jaccard_edited"),
        likeness(own, after, jaccard=True).alias("jaccard_next"),
    )
