"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints. The majority bit over the 64-bit hashes of all word shingles (repeats included);
texts are read whole, in blocks, so a very long text needs no word list of its own.

Search. Every distinct fingerprint emits all variants within half the radius; two fingerprints
within the radius meet in some variant. A bucket holds fingerprints of one small ball (65 at
most for radius 2), so it is bounded whatever the data. Instead of all pairs, each member links to
the bucket's smallest one; the link is verified, and since variants within floor(r/2) and
ceil(r/2) meet at distance r at most, such stars join the same components as all pairs would.

Documents that stay. ``near_survivors`` takes the links of the ball variants, over fingerprints of each text's set of
shingles, as candidates. The radius that these can afford links few pairs of texts below a similarity of 0.98, so MinHash
bands over the same shingles give further ones. Members of a band's bucket are first paired with four of it; where that leaves several components in one bucket, their members
are paired across, those of crowds wherever their sketches do not tell them apart. Pairs are verified by the Jaccard similarity of their shingle sets, or by
their sketches alone where these lie ``SIGMAS`` deviations off the threshold. Texts count as equal if their 64-bit hashes are.

Defined results. Null text is the empty text; a text without words has fingerprint zero, linked
like any other. Repeated rows give repeated result rows. An empty table gives an empty result.
Extra columns are ignored by ``near_groups`` and carried by ``near_survivors``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import cut_lineage, fresh, map_batches, text_or_empty, written
from screenloom.llm.components import components

BLOCK = 1 << 20

#: Bands and permutations in each. A pair of similarity s meets in some bucket with probability 1 - (1 - s**6)**24, 0.9993 at 0.8.
BANDS, PER_BAND = 24, 6
_FACTORS, _TERMS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * PER_BAND, 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)
#: Deviations of a sketch's estimate beyond which it decides alone: at 4.5, some 3 of a million pairs at the threshold are told wrong.
SIGMAS = 4.5
#: Components that are paired with each other in one bucket without a look at their sketches, and members of a block of larger crowds.
CROWD, CROWD_BLOCK = 16, 2048
#: Nodes that are broadcast at most: 8 MB of longs.
FEW = 1_000_000
_ORDERS = [0, *np.random.default_rng(43).integers(-(1 << 63), 1 << 63, 3).tolist()]


def word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of ``data`` (runs without ASCII white space), some ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of a UTF-8 text: a bit is set if set in over half the shingle hashes."""
    carry: list[bytes] = []
    ones, total, words = np.zeros(64, dtype=np.int64), 0, 0
    digest = xxhash.xxh64_intdigest
    for block in word_blocks(text.lower()):  # bytes.lower() changes A-Z alone
        words += len(block)
        block = carry + block
        hashes = [digest(b" ".join(s), seed) for s in zip(*(block[i:] for i in range(width)), strict=False)]
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carry = block[len(block) - min(width - 1, len(block)) :]
    if not total:
        return digest(b" ".join(carry), seed) if words else 0
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("body").cast(pa.binary())
            found = np.array([simhash(t.as_py(), width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return map_batches(rows, batches, schema)


def masks(bits: int) -> list[int]:
    """All 64-bit masks (as signed longs) of at most ``bits`` set bits."""
    return [
        int(np.array(sum(1 << i for i in c), dtype=np.uint64).view(np.int64))
        for n in range(bits + 1)
        for c in itertools.combinations(range(64), n)
    ]


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct (fp) -> verified links (a, b) that join exactly the pairs within ``radius`` into components."""
    inner, outer = radius // 2, (radius + 1) // 2
    near = F.array(*[F.lit(m) for m in masks(inner)])
    far = F.array(*[F.lit(m) for m in masks(outer)])
    ball = prints.select("fp", F.explode(F.transform(far, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    if inner == outer:
        is_near: Column = F.lit(True)
    else:
        is_near = F.array_contains(near, F.col("fp").bitwiseXOR(F.col("variant")))
    centre = ball.groupBy("variant").agg(F.min(F.when(is_near, F.col("fp"))).alias("a"), F.max("fp").alias("top"), F.count("*").alias("n"))
    # a variant met by one fingerprint alone links nothing; most end here
    centre = centre.filter("n > 1 AND a IS NOT NULL").select("variant", "a")
    linked = ball.join(centre, "variant").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return linked.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """Per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col, width))
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(ball_links(prints.select("fp"), radius))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a UTF-8 text; a text of fewer words is one shingle."""
    carry: list[bytes] = []
    found, words = [np.empty(0, dtype=np.uint64)], 0
    digest = xxhash.xxh64_intdigest
    for block in word_blocks(text.lower()):
        words += len(block)
        block = carry + block
        found.append(np.array([digest(b" ".join(s), seed) for s in zip(*(block[i:] for i in range(width)), strict=False)], dtype=np.uint64))
        carry = block[len(block) - min(width - 1, len(block)) :]
    if 0 < words < width:
        found.append(np.array([digest(b" ".join(carry), seed)], dtype=np.uint64))
    return np.unique(np.concatenate(found))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set of shingle hashes."""
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (_FACTORS * hashes[at : at + 4096] + _TERMS).min(axis=1), out=least)
    return least


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed long, of a set of shingle hashes; of none, zero."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def buckets(least: np.ndarray) -> list[int]:
    """One signed long for each band of a sketch."""
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, PER_BAND))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is that high; two empty sets are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _sketched(texts: DataFrame, width: int) -> DataFrame:
    """(node, fp, sketch of 4 bytes a permutation, buckets) of (node, body)."""

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prints, least = [], []
            for t in batch.column("body").cast(pa.binary()):
                hashes = shingles(t.as_py(), width)
                prints.append(majority(hashes))
                least.append(sketch(hashes))
            short = [((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).tobytes() for x in least]
            columns = [batch.column("node"), pa.array(prints, type=pa.int64()), pa.array(short, type=pa.binary()), pa.array([buckets(x) for x in least], type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "fp", "sketch", "buckets"])

    return written(map_batches(texts, mark, "node long, fp long, sketch binary, buckets array<long>"))


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b). Up to FEW of them, counted without a shuffle, are sent to every task; more meet what they choose in a shuffle."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return F.broadcast(ends) if 2 * pairs.count() <= FEW else ends


def _shares(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, share): the share of permutations on which the sketches agree, which estimates their similarity."""

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, BANDS * PER_BAND) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).mean(axis=1))], names=["a", "b", "share"])

    known = marked.select("node", "sketch").join(_ends(pairs), "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(known.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    both = both.join(known.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    return written(map_batches(both, compare, "a long, b long, share double"))


def _verified(pairs: DataFrame, marked: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of that Jaccard similarity: by their sketches where these leave no doubt, else by their shingle sets."""

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            last, first, keep = None, np.empty(0, dtype=np.uint64), []
            for node, x, y in zip(batch.column("a").to_pylist(), batch.column("x").cast(pa.binary()), batch.column("y").cast(pa.binary()), strict=True):
                if node != last:  # rows of one node mostly stand together
                    last, first = node, shingles(x.as_py(), width)
                keep.append(alike(first, shingles(y.as_py(), width), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    shares = _shares(pairs, marked)
    least = _least_share(similarity)
    high = 2 * similarity - least
    unsure = shares.filter((F.col("share") >= least) & (F.col("share") < high)).select("a", "b")
    bodies = written(texts.join(_ends(unsure), "node", "left_semi").dropDuplicates(["node"]))
    both = unsure.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    both = both.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    sure = shares.filter(F.col("share") >= high).select("a", "b")
    return written(sure.unionByName(map_batches(both, verify, "a long, b long")))


def _partners() -> list[Column]:
    """The least node in some orders, the same ones everywhere."""
    return [F.min(F.col("node").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in _ORDERS]


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()


def ball_pairs(marked: DataFrame, radius: int) -> DataFrame:
    """(node, fp) -> pairs (a, b): nodes of one fingerprint with its least node, and the least nodes of fingerprints that ball variants link."""
    prints = written(marked.groupBy("fp").agg(F.min("node").alias("partner")))
    same = marked.select("node", "fp").join(prints, "fp").filter("node <> partner").select("node", "partner")
    links = ball_links(prints.select("fp"), radius)
    near = links.join(prints.select(F.col("fp").alias("a"), F.col("partner").alias("node")), "a").join(prints.select(F.col("fp").alias("b"), "partner"), "b")
    return _ordered(same.unionByName(near.select("node", "partner")))


def star_pairs(rows: DataFrame) -> DataFrame:
    """(node, bucket) -> pairs (a, b) of every member of a bucket with the bucket's least nodes in four orders."""
    centre = rows.groupBy("bucket").agg(F.array_distinct(F.array(*_partners())).alias("partners"), F.min("node").alias("low"), F.max("node").alias("top"))
    centre = centre.filter("low <> top").select("bucket", "partners")
    return _ordered(rows.join(centre, "bucket").select("node", F.explode("partners").alias("partner")).filter("node <> partner"))


def open_pairs(rows: DataFrame, roots: DataFrame, marked: DataFrame, similarity: float, crowd: int = CROWD) -> DataFrame:
    """Pairs that stars may have missed: of every bucket that several components share, their members against each other.

    A component stands in a bucket by four of its members at most. More than ``crowd`` components are compared by their
    sketches in blocks, and only pairs that the sketches do not tell apart come out.
    """
    named = rows.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("bucket", "root").agg(F.array_distinct(F.array(*_partners())).alias("members"))
    several = groups.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    groups = written(groups.join(several, "bucket"))
    listed = groups.filter(F.col("n") <= crowd).groupBy("bucket").agg(F.collect_list(F.struct("root", "members")).alias("c"))
    crossed = listed.select("c", F.explode("c").alias("p")).select("p", F.explode("c").alias("q")).filter("p.root < q.root")
    crossed = crossed.select(F.explode("p.members").alias("node"), F.col("q.members").alias("others")).select("node", F.explode("others").alias("partner"))
    crowded = groups.filter(F.col("n") > crowd).select("bucket", "root", F.explode("members").alias("node"))
    found = _ordered(crossed)
    if not crowded.isEmpty():
        found = found.unionByName(crowd_pairs(crowded, marked, similarity)).distinct()
    return found


def _least_share(similarity: float) -> float:
    """The share of equal permutations below which sketches tell two texts apart."""
    return similarity - SIGMAS * (similarity * (1 - similarity) / (BANDS * PER_BAND)) ** 0.5


def crowd_pairs(crowded: DataFrame, marked: DataFrame, similarity: float, block: int = CROWD_BLOCK) -> DataFrame:
    """(bucket, root, node) -> every pair (a, b) of different roots in one bucket whose sketches agree as similar texts' would.

    The members of a bucket are dealt to blocks of some ``block`` rows, and every two blocks meet in one task, which compares
    one byte of each permutation (bytes agree wherever values do, so none is missed). Buckets of the same members are compared once.
    """
    least = _least_share(similarity) * BANDS * PER_BAND

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values("node", kind="stable")
        x, y = (rows[rows["block"] == n] for n in (first, second))
        u, v = (np.frombuffer(b"".join(part["sketch"]), dtype=np.uint8).reshape(len(part), BANDS * PER_BAND) for part in (x, y))
        r, q, p, o = x["root"].to_numpy(), y["root"].to_numpy(), x["node"].to_numpy(), y["node"].to_numpy()
        out = []
        for at in range(0, len(x), 32):
            agree = (u[at : at + 32, None] == v[None]).sum(axis=2)
            k, m = np.nonzero((agree >= least) & (r[at : at + 32, None] != q[None]))
            out.append(np.stack([p[at + k], o[m]], axis=1))
        pairs = np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}).drop_duplicates()

    members = crowded.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
    once = members.groupBy("m", "sum", "xor").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    low = F.expr(f"transform(sequence(0, {BANDS * PER_BAND - 1}), i -> substring(sketch, 4 * i + 1, 1))")
    ends = crowded.select("node").distinct()
    known = marked.join(ends, "node", "left_semi").dropDuplicates(["node"]).select("node", F.array_join(F.transform(low, lambda b: F.hex(b)), "").alias("hexed"))
    known = known.select("node", F.unhex("hexed").alias("sketch"))
    at = crowded.join(once, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(known, "node")
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("bucket", "i", "j", "block", "root", "node", "sketch")
    return at.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def similar_components(texts: DataFrame, width: int, similarity: float, radius: int = 2) -> DataFrame:
    """(node, body), equal nodes having equal bodies -> components (node, root) of the similar ones."""
    marked = _sketched(texts, width)
    rows = marked.select("node", F.explode("buckets").alias("bucket"))
    pairs = written(star_pairs(rows).unionByName(ball_pairs(marked, radius)).distinct())
    links = _verified(pairs, marked, texts, width, similarity)
    roots = components(links)
    missed = written(open_pairs(rows, roots, marked, similarity).join(pairs, ["a", "b"], "left_anti"))
    if missed.isEmpty():
        return roots
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(_verified(missed, marked, texts, width, similarity)))


def near_survivors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One row of each group of near copies: that of smallest id, then of smallest text hash; a null id comes first.

    Near copies are texts whose sets of word shingles have that Jaccard similarity, and what such pairs join.
    Rows that share an id, null or not, but are no near copies each stay.
    """
    node, number = (fresh(docs.columns, x) for x in ("node", "number"))
    body, text_hash = text_or_empty(text_col), F.xxhash64(text_or_empty(text_col))
    # the id as one long, since a null-safe key would cost the texts another exchange
    id_hash = F.xxhash64(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"))
    roots = similar_components(docs.select(text_hash.alias("node"), body.alias("body")), width, similarity)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), id_hash.alias("number"), text_hash.alias("node"))
    rooted = rows.join(roots, "node", "left").select("id", "number", "node", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("id").isNotNull(), "id", "node", "number")).alias("first")
    kept = rooted.groupBy("root").agg(first).select(F.col("first.node").alias(node), F.col("first.number").alias(number))
    keyed = docs.withColumns({node: text_hash, number: id_hash})
    here = keyed.join(kept, [node, number], "left_semi").dropDuplicates([node, number])
    return here.select([F.col(f"`{c}`") for c in docs.columns])
