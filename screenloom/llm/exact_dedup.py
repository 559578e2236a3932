"""Exact deduplication by 128-bit content hash, with the bytes compared inside every hash group.

Plan. Rows are aggregated by (hash, text): equal hashes meet in one place and the grouping itself
compares the bytes, so two texts that share a hash stay apart. Copies collapse before the shuffle
(map-side partial aggregation), so a group that holds a third of all rows costs one row per map
task. Decisions go back to documents over (hash, SHA-256) without any text; that join is a plain
equi-join between two exchanges, which adaptive execution splits when one key is hot.

Defined results. Null text is the empty text, and empty texts equal each other. Rows repeated with
the same id and text count separately in ``group_size``; exactly one of them is kept. A null id is
smaller than every id. An empty table gives an empty result. Extra columns are ignored by
``exact_groups`` and carried unchanged by ``exact_survivors``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import fresh, text_or_empty


def content_hash(text: Column) -> Column:
    """128-bit content hash of the UTF-8 bytes."""
    return F.md5(text)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``smallest`` or ``largest``: which stable id of a group stays.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    hashed = rows.select("id", "body", hash_of(F.col("body")).alias("h"))
    classes = hashed.groupBy("h", "body").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = classes.select("h", F.sha2("body", 256).alias("sha"), "keep_id", "group_size")
    members = (
        hashed.select("id", "h", F.sha2("body", 256).alias("sha")).groupBy("id", "h", "sha").agg(F.count("*").alias("n"))
    )
    joined = members.join(classes, ["h", "sha"])
    copies = joined.select(
        "id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    )
    return copies.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns: one shuffle, by (hash, text)."""
    pick = {"smallest": F.min_by, "largest": F.max_by}[keep]
    h, body, row = (fresh(docs.columns, x) for x in ("h", "body", "row"))
    rest = [c for c in docs.columns if c != text_col]
    # a null id is replaced by a flag in front, so that min_by and max_by see every row
    order = F.struct(F.col(f"`{id_col}`").isNotNull(), F.col(f"`{id_col}`"))
    keyed = docs.withColumns({body: text_or_empty(text_col), h: content_hash(text_or_empty(text_col))})
    # the sum of null marks tells a null text from an empty one when the survivor is rebuilt
    chosen = keyed.groupBy(h, body).agg(
        pick(F.struct(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").isNull().alias(h)), order).alias(row)
    )
    out = {c: F.col(f"`{row}`.`{c}`") for c in rest} | {
        text_col: F.when(~F.col(f"`{row}`.`{h}`"), F.col(body))
    }
    return chosen.select([out[c].alias(c) for c in docs.columns])
