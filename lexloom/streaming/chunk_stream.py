"""Chunk counts of a stream of texts, kept in an artifact-like table of increments.

Counts add up in any order, so each micro-batch writes its own counts under its batch id; a batch
that is run again overwrites what it wrote before, which makes the sum exact once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.pretok import PreTokenizer
from lexloom.functions.specials import SpecialTokens
from lexloom.operators.chunks import chunk_counts


def count_stream(texts: DataFrame, text: str, pretok: PreTokenizer, path: str, checkpoint: str, specials: SpecialTokens | None = None, **trigger):
    """Start the query. ``trigger`` is what DataStreamWriter.trigger takes, available_now by default."""

    def write(batch: DataFrame, batch_id: int) -> None:
        chunk_counts(batch, text, pretok, specials).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_counts(spark: SparkSession, path: str) -> DataFrame:
    """``chunk, cnt`` of all increments so far."""
    return spark.read.parquet(path).groupBy("chunk").agg(F.sum("cnt").alias("cnt"))
