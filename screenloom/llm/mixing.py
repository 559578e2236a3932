"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Targets. Every source wants its weight's share of the total; none may exceed ``max_epochs`` times
its own size. Raising one common level L, source i gets min(cap_i, w_i * L). Sorted by cap_i / w_i,
the clamped sources form a prefix, so running sums over the (small) table of sources give the
exact fixed point of "clamp, redistribute the excess proportionally, repeat".

Sampling. A source at e = target / size epochs takes every document floor(e) times whole; the
remaining fraction walks the source's documents in a seeded hash order until the words are spent,
and the last document gives the words still missing. To avoid one sorted window over a hot source,
the walk is two-level: documents fall into 16**``digits`` hash ranges per source, running sums over
bucket totals find the one range in which the walk ends, and only that range is sorted by row.

Defined results. Null and empty texts have size 0, take 0 words and their sources, if nothing
else is in them, get target 0. The null source is a source of its own, last in order. Repeated
rows are separate documents, put in order by the operator's own tie-break. An empty table gives an
empty result. Extra columns are ignored by ``mix`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.llm.common import WORD, cut_lineage, fresh, text_or_empty, written


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, weight, size) -> the same with ``target`` long: capped shares of the summed size.

    One row per source; the unpartitioned window holds the table of sources, never documents.
    """
    cap = F.col("size") * max_epochs
    order = W.orderBy(F.col("ratio"), F.col("source").isNull(), "source")
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    levels = (
        sources.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
        .withColumns(
            {
                "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)),
                "open_weight": F.sum("weight").over(onward),
                "total": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            }
        )
        # the level if this source and all after it are open; it is clamped if its own cap lies below
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("open_weight"))
        .withColumn("clamped", F.col("ratio") <= F.col("level"))
        .withColumn("final", F.max(F.when(~F.col("clamped"), F.col("level"))).over(W.partitionBy()))
    )
    target = F.when(F.col("clamped") | F.col("final").isNull(), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("final")
    )
    return levels.select("source", "weight", "size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
    digits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: id, size, source_size, target, taken, whole (full repetitions), part (further words)."""
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("k"),
        F.col(source_col).isNull().alias("k0"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("order_hash", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    # read more than once below: sizes are counted in one pass over the texts
    base = written(base.withColumn("bucket", F.substring("order_hash", 1, digits)))

    # totals by hash range, then by source
    ranges = base.groupBy("k", "k0", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = (
        ranges.groupBy("k", "k0")
        .agg(F.sum("bucket_size").alias("size"))
        .select(F.when(~F.col("k0"), F.col("k")).alias("source"), "k", "k0", "size")
    )
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy("k0", "k")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = water_fill(ranked.withColumn("weight", weight), max_epochs)
    plan = filled.select(
        F.coalesce("source", F.lit("")).alias("k"),
        F.col("source").isNull().alias("k0"),
        F.col("size").alias("source_size"),
        "target",
        F.round("target").cast("long").alias("words"),
    ).withColumns(
        {
            "whole": F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)),
            "rest": F.when(F.col("source_size") > 0, F.expr("words % source_size")).otherwise(F.lit(0)),
        }
    )
    # where in the hash order the fractional repetition ends
    walked = (
        ranges.join(plan.select("k", "k0", "rest"), ["k", "k0"])
        .withColumn(
            "before",
            F.coalesce(
                F.sum("bucket_size").over(
                    W.partitionBy("k", "k0").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .filter("before < rest AND before + bucket_size >= rest")
        .select("k", "k0", "bucket", (F.col("rest") - F.col("before")).alias("last_rest"))
    )
    ends = walked.select("k", "k0", F.col("bucket").alias("last_bucket"))
    # one row per source; cut, so that the joins below stand on plain exchanges, which can be split
    settled = cut_lineage(plan.join(ends, ["k", "k0"], "left").drop("source", "words"))
    # only the range in which the walk ends is put in order row by row; it is found by source and range,
    # so that a hot source is spread over its ranges
    inside = (
        base.join(walked, ["k", "k0", "bucket"])
        .withColumn(
            "before",
            F.coalesce(
                F.sum("size").over(
                    W.partitionBy("k", "k0", "bucket")
                    .orderBy("order_hash", "id", "size")
                    .rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("last_rest") - F.col("before"))))
    )
    ordered = inside.select("id", "k", "k0", "size", "part").join(settled, ["k", "k0"])
    others = (
        base.join(settled, ["k", "k0"])
        .filter(F.col("last_bucket").isNull() | (F.col("bucket") != F.col("last_bucket")))
        .withColumn("part", F.when(F.col("bucket") < F.col("last_bucket"), F.col("size")).otherwise(F.lit(0)))
        .select(ordered.columns)
    )
    return ordered.unionByName(others).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.col("whole").cast("long").alias("whole"),
        F.col("part").cast("long").alias("part"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows with all their columns, repeated; a further part is a row with that many words of the text."""
    id_, size, nth, plan, copy, row = (fresh(docs.columns, x) for x in ("id", "size", "nth", "plan", "copy", "row"))
    chosen = mix(docs.select(id_col, text_col, source_col), weights, max_epochs, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    # rows that share id and size are alike to the mix; they take their plans in any order
    plans = chosen.groupBy(F.col(id_col).alias(id_), F.col("size").alias(size)).agg(
        F.collect_list(F.struct("whole", "part")).alias(plan)
    )
    sized = docs.withColumn(row, F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long"))
    joined = sized.join(plans, sized[id_col].eqNullSafe(plans[id_]) & (sized[row] == plans[size]))
    numbered = joined.withColumn(nth, F.row_number().over(W.partitionBy(id_, size).orderBy(F.lit(0)))).withColumn(
        plan, F.element_at(plan, F.col(nth))
    )
    whole, part = F.col(f"`{plan}`.whole"), F.col(f"`{plan}`.part")
    times = whole + F.when((part == F.col(size)) & (part > 0), 1).otherwise(0)
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("long"), times.cast("int")),
        F.when((part > 0) & (part < F.col(size)), F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    spread = numbered.withColumn(copy, F.explode(copies))
    words = F.regexp_extract_all(text_or_empty(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col(copy) == 0, F.col(text_col)).otherwise(F.array_join(F.slice(words, 1, F.col(copy).cast("int")), ""))
    return spread.withColumn(text_col, text).select(docs.columns)
