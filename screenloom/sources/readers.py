"""Scans: label tables, gene lists, upstream tables of strings, wide matrices, knowledge sources.

Every read states its schema or reads strings; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions.text import strip
from screenloom.operators.labels import map_columns

NUMBERS = ("fdr", "fold_change")


def file_context(kind: str) -> Column:
    """Context from the file: its name without the last suffix (``stem``), or its folder (``parent``)."""
    if kind == "stem":
        return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    if kind == "parent":
        return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    raise ValueError(f"unknown place of the context: {kind}")


def read_labels(spark: SparkSession, path: str, columns: Mapping[str, str], context_from: str = "column") -> DataFrame:
    """(context, pert, gene, fdr, fold_change, file, ord) of CSV or Parquet files; only mapped columns are read.

    ``columns`` maps roles to columns; it names a context exactly when the context comes from a column. ``ord``
    is the place in the file, however it is split: the split's first byte, then the row's number in it.
    """
    if ("context" in columns) != (context_from == "column"):
        raise ValueError("a context column is named exactly when the context comes from one")
    is_csv = path.rstrip("/*").endswith((".csv", ".csv.gz"))
    df = spark.read.option("header", True).csv(path) if is_csv else spark.read.parquet(path)
    meta = {"file": F.col("_metadata.file_path")}
    if context_from != "column":
        meta["file_context"] = file_context(context_from)
    told = df.withColumns(meta | {"ord": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))})
    roles = dict(columns) | {"file": "file", "ord": "ord"} | ({"context": "file_context"} if context_from != "column" else {})
    mapped = map_columns(told, roles)
    return mapped.withColumns({c: F.col(c).cast("double") for c in NUMBERS if c in columns})


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(gene, pos) of a file with one symbol per line, blanks skipped; no genes, or repeated ones, are an error."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "gene"))
    kept = rows.select("pos", strip(F.col("gene")).alias("gene")).filter("gene <> ''")
    if kept.isEmpty():
        raise ValueError(f"no genes in {path}")
    if (twice := kept.groupBy("gene").count().filter("count > 1").first()) is not None:
        raise ValueError(f"gene listed twice: {twice['gene']}")
    return kept


def read_strings(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header, everything a string, ``#`` stripped from the first name; gzip by suffix."""
    df = spark.read.option("sep", sep).option("header", True).option("quote", "").csv(path)
    return df.withColumnsRenamed({c: c.lstrip("#") for c in df.columns if c.startswith("#")})


def read_taxon(spark: SparkSession, path: str, tax_id: str = "9606") -> DataFrame:
    """Rows of one organism; the filter reaches the parser."""
    return read_strings(spark, path).filter(F.col("tax_id") == tax_id)


def protein_coding(gene_info: DataFrame, kinds: Sequence[str] = ("protein-coding",)) -> DataFrame:
    """Rows of the wanted gene types with a symbol."""
    return gene_info.filter(F.col("type_of_gene").isin(list(kinds)) & F.col("Symbol").isNotNull())


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV of strings; see :func:`screenloom.operators.knowledge.gene_effect_matrix`."""
    return spark.read.option("header", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Metadata by suffix: CSV as strings, else Parquet."""
    return spark.read.option("header", True).csv(path) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A dense source (key, vector); another width, a null or a repeated key is an error."""
    df = spark.read.schema("key string, vector array<float>").parquet(path)
    bad = df.filter((F.size("vector") != dim) | F.col("key").isNull()).first()
    twice = df.groupBy("key").count().filter("count > 1").first()
    if bad is not None or twice is not None:
        raise ValueError(f"not a source of width {dim}: {bad or twice}")
    return df


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, and their order-independent digest through :func:`tree_hash`."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def tree_hash(hashes: DataFrame) -> DataFrame:
    """One row: SHA-256 over sorted ``path:hash`` lines."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256")))
    return hashes.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
