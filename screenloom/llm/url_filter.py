"""URL filter: rules by host and path, else the ratio of two character language models.

Addresses that a rule decides are the labelled examples: one variable-order Markov model over the
characters of accepted addresses, one over those of rejected. A model of order 3 backs off through
orders 2, 1 and 0 by Witten-Bell weights: a context counts the more the more often it was seen and the
fewer different characters followed it. Characters fall into 32 classes, so all contexts with their
next character number 32**4 at most: the log ratio of both models is one dense table of fixed size,
whatever the input, and reaches the tasks as a scalar subquery. Scoring is a map over addresses.

An address scores the mean log2 ratio per character; the threshold is the one with the best balanced
accuracy on the half of the examples that the models haven't counted, chosen by hash of the address.

Defined results. Null addresses, and those without ``://``, have empty host and path and an empty
text: they score 0 and are allowed, whatever the threshold, as is everything when either class has no examples. Of rules
equally long the first given wins. Repeated rows give repeated result rows. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import cut_lineage

SYMBOLS = 32
#: Class of each ASCII character: a-z are 0-25, then digits, slash, dot, dash, query signs, others.
_CLASS = {c: i for i, c in enumerate(string.ascii_lowercase)} | {c: i for i, c in enumerate(string.ascii_uppercase)}
_CLASS |= dict.fromkeys(string.digits, 26) | {"/": 27, ".": 28, "-": 29, "_": 29, "?": 30, "&": 30, "=": 30, "#": 30}
CLASS_OF = [_CLASS.get(chr(i), 31) for i in range(128)]
CELL = 0.01  # width of the histogram cells in which the threshold is sought, over scores from -10 to 10


def address_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty without ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, null if none fits; rules are (host and path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def symbols(text: Column) -> Column:
    """The class of every character."""
    classes = F.array(*[F.lit(c) for c in CLASS_OF])
    return F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c: F.when(F.ascii(c) < 128, F.get(classes, F.ascii(c))).otherwise(31),
    )


def grams(codes: str) -> Column:
    """One number per character of a column of classes: those of the three before it (dots before the start) and its own."""

    def before(i: Column, k: int) -> Column:
        return F.coalesce(F.get(codes, i - k), F.lit(28))

    return F.transform(
        codes,
        lambda c, i: F.shiftleft(before(i, 3), 15).bitwiseOR(F.shiftleft(before(i, 2), 10)).bitwiseOR(F.shiftleft(before(i, 1), 5)).bitwiseOR(c),
    )


def log_ratios(examples: DataFrame) -> DataFrame:
    """(accepted boolean, gram int) -> one row: ``cells``, an array of 32**2 arrays of 32**2 log2 ratios."""
    spark = examples.sparkSession
    counted = examples.groupBy("gram").agg(
        F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    counted = cut_lineage(counted)  # read for every order; 32**4 rows at most
    uniform = 1.0 / SYMBOLS
    dense = spark.range(1).select(F.lit(0).alias("gram"), F.lit(uniform).alias("pa"), F.lit(uniform).alias("pr"))
    for order in range(4):
        size = SYMBOLS ** (order + 1)
        # counts of this order, then of its contexts: seen how often, followed by how many different characters
        own = counted.groupBy(F.col("gram").bitwiseAND(size - 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        seen = own.groupBy(F.shiftright("gram", 5).alias("context")).agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
        )
        lower = dense.select(F.col("gram").alias("lower"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        cells = spark.range(size).select(F.col("id").cast("int").alias("gram"))
        cells = cells.withColumns({"lower": F.col("gram").bitwiseAND(max(size // SYMBOLS, 1) - 1), "context": F.shiftright("gram", 5)})
        # contexts and lower orders number 32**3 at most, whatever the input
        joined = cells.join(own, "gram", "left").join(F.broadcast(seen), "context", "left").join(F.broadcast(lower), "lower")
        value = {
            f"p{x}": F.when(
                F.coalesce(f"n{x}", F.lit(0)) > 0,
                (F.coalesce(x, F.lit(0)) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}")),
            ).otherwise(F.col(f"q{x}"))
            for x in "ar"
        }
        dense = joined.select("gram", *[v.alias(k) for k, v in value.items()])
    ratio = dense.select(F.shiftright("gram", 10).alias("high"), "gram", F.log2(F.col("pa") / F.col("pr")).alias("v"))
    rows = ratio.groupBy("high").agg(F.array_sort(F.collect_list(F.struct("gram", "v"))).alias("c"))
    # the groups are all there: every gram has a cell
    rows = rows.select("high", F.transform("c", lambda x: x["v"]).alias("c"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("high", "c"))).alias("c")).select(
        F.transform("c", lambda x: x["c"]).alias("cells")
    )


def best_threshold(scored: DataFrame) -> DataFrame:
    """(accepted, score) -> one row: ``threshold`` with the best balanced accuracy, the middle of equals; null without both classes."""
    from pyspark.sql import Window as W

    cell = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") / CELL)))
    cells = scored.groupBy(cell.alias("cell")).agg(
        F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    cells = cells.unionByName(scored.sparkSession.range(-1000, 1002).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r")))
    cells = cells.groupBy("cell").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))  # 2002 rows, whatever the input
    below, every = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    told = cells.select(
        "cell",
        F.coalesce(F.sum("r").over(below), F.lit(0)).alias("caught"),
        F.coalesce(F.sum("a").over(below), F.lit(0)).alias("lost"),
        F.sum("a").over(every).alias("na"),
        F.sum("r").over(every).alias("nr"),
    ).filter("na > 0 AND nr > 0")
    told = told.withColumn("gain", F.col("caught") * F.col("na") - F.col("lost") * F.col("nr"))
    top = told.withColumn("top", F.max("gain").over(W.partitionBy())).filter("gain = top")
    return top.agg((F.floor((F.min("cell") + F.max("cell")) / 2) * CELL).alias("threshold"))


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per input row: id, host, path, rule, verdict, score (mean log2 ratio per character)."""
    host, path = address_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says, "fold": F.ascii(F.md5("url")) % 2})
    text = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    rows = rows.withColumn("codes", symbols(text)).withColumn("grams", grams("codes")).drop("url", "codes")
    examples = rows.filter("rule IS NOT NULL").withColumn("accepted", F.col("says") == "allow")
    fitting = examples.filter("fold = 0").select("accepted", F.explode("grams").alias("gram"))
    model = cut_lineage(log_ratios(fitting))
    score = F.aggregate(
        "grams",
        F.lit(0.0),
        lambda s, g: s + F.get(F.get(F.col("cells"), F.shiftright(g, 10)), g.bitwiseAND(1023)),
        lambda s: F.when(F.size("grams") > 0, s / F.size("grams")).otherwise(0.0),
    )

    def scored(df: DataFrame) -> DataFrame:
        told = df.withColumn("cells", model.scalar()).withColumns({"score": score, "empty": F.size("grams") == 0})
        return told.drop("cells", "grams")

    threshold = cut_lineage(best_threshold(scored(examples.filter("fold = 1")).select("accepted", "score")))
    judged = scored(rows).withColumn("threshold", threshold.scalar())
    by_model = F.when(~F.col("empty") & (F.col("score") < F.col("threshold")), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("says", by_model).alias("verdict"), "score"
    )
