"""Shards compacted as they arrive, by Structured Streaming: the checkpoint replaces a test for files already done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumenlex.operators.compact import compact_works


def compact_stream(spark: SparkSession, raw_path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of compact records from the Parquet files that appear under raw_path."""
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).parquet(raw_path)
    return compact_works(raw)


def run_available(stream: DataFrame, compact_path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived, exactly once, and ends; run again, it goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", compact_path).option("compression", "zstd").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
