"""Label tables that arrive file by file: the latest state of every cell, kept with exactly-once batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from screenloom.operators.labels import last_wins


def follow_labels(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """(context, pert, gene, fdr, fold_change, ord) rows into one Parquet table per batch; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        last_wins(batch, "ord").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_labels(table: DataFrame) -> DataFrame:
    """The last value of each cell over all batches."""
    return last_wins(table, "batch", "ord")
