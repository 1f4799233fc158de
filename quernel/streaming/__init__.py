"""Unbounded input: SELECT statements over streams.

The dialect's filters, projections and grouped aggregates bind to a streaming DataFrame as they do to a table; register
it in a Database under a name and write what execute() gives with writeStream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files that appear in folder, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
