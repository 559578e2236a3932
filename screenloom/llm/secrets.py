"""Secret scans: candidates by pattern, judged by how many owners and repositories hold the same value.

Candidates. Base kinds are fixed patterns: ``assign`` (a key word, a sign of assignment, a value), ``access`` (AKIA and what
follows), ``hex`` (long runs of hex digits). A further kind, ``key``, are runs of 20 and more letters, digits and a few
signs that look drawn at random: they mix digits with letters of either case, and repeat few characters.

Ownership. A candidate's value (what is assigned, else the whole match) is known by its 128-bit hash, and the corpus tells for each hash
how many repositories and owners hold it. A value of ``most_owners`` owners and more is a widely copied example;
one of fewer that looks random is ``live``; the rest is ``plain`` (a placeholder, a word). Candidates of kind ``key`` count as spans only if
they are live; base spans stay whatever the verdict. Values alone are moved, never texts: (hash, owner, repository) is made distinct before anything
is counted by hash, and a value that very many rows hold meets its verdict in a join that adaptive execution splits.

All is one expression on the text column: the pieces between matches give the places of the matches.

Defined results. Null text is the empty text. Spans are code points, end exclusive. Null owners and repositories are one each. Repeated rows are
rows of their own (and one repository). A text without candidates has no spans. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.llm.common import text_or_empty, written

#: Kinds in their order, and their patterns. ``assign`` is matched as it stands and then held against the least length of its value.
KINDS = ("assign", "access", "hex", "key")
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KEY = "[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 6
#: Parts of values that stand for a secret in examples.
PLACEHOLDERS = ("example", "changeme", "your", "dummy", "sample", "placeholder", "xxxx", "0123456", "abcdef")


def looks_random(value: Column) -> Column:
    """Letters and digits mixed, at least 8 different characters and one for every three, no placeholder's word."""
    different = F.size(F.array_distinct(F.split(value, "")))
    plain = F.lower(value)
    named = F.lit(False)
    for word in PLACEHOLDERS:
        named = named | F.contains(plain, F.lit(word))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & ~named & (different >= 8) & (different * 3 >= F.least(F.char_length(value), F.lit(48)))


def matches(text: Column, kind: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """struct(kind, gaps, sizes, hashes, random) of all matches, leftmost and non-overlapping; a hash is null where the match doesn't count.

    ``gaps`` are the lengths of text before each match since the last one. The value is that group of the match. Null if nothing matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    random = F.transform(values, looks_random)
    if KINDS[kind] == "key":  # of these only what may be live counts
        hashes = F.transform(values, lambda v: F.when(looks_random(v), F.md5(v)))
    else:
        hashes = F.transform(values, lambda v: F.when(F.char_length(v) >= least, F.md5(v)))
    told = F.struct(
        F.lit(kind).alias("kind"),
        F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p)).alias("gaps"),
        F.transform(found, lambda m: F.char_length(m)).alias("sizes"),
        hashes.alias("hashes"),
        random.alias("random"),
    )
    return F.when(text.rlike(pattern), told)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(uid, id, owner, repo, found): every row with the matches of each kind, without its text; written once."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{owner_col}`").alias("owner"), F.col(f"`{repo_col}`").alias("repo"), text_or_empty(text_col).alias("body")
    )
    body = F.col("body")
    kinds = [matches(body, 0, ASSIGN, 2, LEAST_VALUE), matches(body, 1, ACCESS), matches(body, 2, HEX), matches(body, 3, KEY)]
    found = F.filter(F.array(*kinds), lambda k: k.isNotNull())
    return written(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "owner", "repo", found.alias("found")))


def placed_spans(marked: DataFrame) -> DataFrame:
    """(uid, id, owner, repo, kind, start, end, hash, random): one row per match; hash is null where it doesn't count.

    A ``key`` that overlaps a base span doesn't count.
    """
    each = marked.select("uid", "id", "owner", "repo", F.explode("found").alias("k")).select(
        "uid", "id", "owner", "repo", "k.kind", F.posexplode(F.arrays_zip("k.sizes", "k.hashes", "k.random", F.slice("k.gaps", F.lit(1), F.size("k.sizes")).alias("gaps")))
    )
    before = W.partitionBy("uid", "kind").orderBy("pos")
    end = F.sum(F.col("col.gaps").cast("long") + F.col("col.sizes")).over(before)
    rows = each.repartition("uid").select("uid", "id", "owner", "repo", "kind", (end - F.col("col.sizes")).alias("start"), end.alias("end"), F.col("col.hashes").alias("hash"), F.col("col.random").alias("random"))
    in_text = W.partitionBy("uid").orderBy("start", "kind")
    base = (F.col("kind") < KINDS.index("key")) & F.col("hash").isNotNull()
    reached = F.max(F.when(base, F.col("end"))).over(in_text.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.min(F.when(base, F.col("start"))).over(in_text.rowsBetween(1, W.unboundedFollowing))
    covered = ~base & F.coalesce((reached > F.col("start")) | (ahead < F.col("end")), F.lit(False))
    return rows.withColumn("hash", F.when(~covered, F.col("hash")))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of every value."""
    held = spans.filter("hash IS NOT NULL").select("hash", "owner", "repo").distinct()
    return held.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def judged_spans(spans: DataFrame, most_owners: int = 3) -> DataFrame:
    """The spans that count, with n_repos, n_owners and verdict (live, copied, plain); other rows keep a null hash and verdict."""
    held = ownership(spans).withColumnRenamed("hash", "of")
    told = spans.filter("hash IS NOT NULL").join(held, F.col("hash") == F.col("of")).drop("of")
    verdict = F.when(F.col("n_owners") >= most_owners, "copied").when(F.col("random"), "live").otherwise("plain")
    none = F.lit(None)
    rest = spans.filter("hash IS NULL").withColumns({"n_repos": none.cast("long"), "n_owners": none.cast("long"), "verdict": none.cast("string")})
    return told.withColumn("verdict", verdict).unionByName(rest)


def scan_secrets(
    docs: DataFrame, most_owners: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id"
) -> DataFrame:
    """Per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live (the spans that look live)."""
    marked = candidates(docs, id_col, text_col, owner_col, repo_col)
    spans = judged_spans(written(placed_spans(marked)), most_owners)
    key = KINDS.index("key")
    shown = F.col("verdict").isNotNull() & ((F.col("kind") < key) | (F.col("verdict") == "live"))
    gathered = spans.groupBy("uid").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(shown, F.struct("start", "kind", "end", "verdict")))).alias("all"))
    bare = marked.filter(F.size("found") == 0).select("uid", "id", F.array().cast(gathered.schema["all"].dataType).alias("all"))
    rows = gathered.unionByName(bare)
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(keep) -> Column:
        told = F.transform(F.filter("all", keep), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(told, ",")

    def count(keep) -> Column:
        return F.size(F.filter("all", keep)).cast("long")

    def of_kind(kind: int) -> Column:  # a lambda's second parameter would be the place
        return count(lambda s: s["kind"] == kind)

    return rows.select(
        F.col("id").alias(id_col),
        *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(key)],
        F.sha2(text(lambda s: s["kind"] < key), 256).alias("base_sha256"),
        text(lambda s: F.lit(True)).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "copied").alias("n_copied"),
        text(lambda s: s["verdict"] == "live").alias("live"),
    )
