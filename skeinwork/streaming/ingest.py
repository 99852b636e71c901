"""Incremental ingest of chunk files (an extension: new files are embedded as they arrive)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinwork.sources.tables import RAW_CHUNK


def stream_chunks(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Stream of raw chunks, each id once within an hour of arrival."""
    rows = spark.readStream.schema(RAW_CHUNK).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.jsonl").json(path)
    return rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 hour").dropDuplicatesWithinWatermark(["id"])


def ingest(chunks: DataFrame, target: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Embed each batch and write it under its number, so that a batch that is run again is written once; runs until the files that are there are done."""

    def write(batch: DataFrame, number: int) -> None:
        embed(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
