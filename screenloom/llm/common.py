"""Helpers shared by the text operators: table access, lineage cuts, bounded partition counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by whatever file system Spark resolves for the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of one Arrow batch. Executors hold a few batches for each core, so texts bound their memory by this, not by rows.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of ``BATCH_BYTES`` at most (one row at least); the session's default is lowered."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:  # Spark's default; a value with a unit was chosen by the user
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(step, schema)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, from the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session uses a folder under its warehouse; on a cluster, whose executors share no
    local folder, it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder: lost executors then reread files, not recompute."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, for tables too wide or long for a checkpoint's raw rows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: Sequence[str], wanted: str) -> str:
    """``wanted``, lengthened until it clashes with none of ``columns`` (case-insensitive)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
