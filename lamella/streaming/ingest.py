"""Each new slide once: a file stream into a table, with what is done kept in a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ingest_new(spark: SparkSession, source: str, schema, table: str, checkpoint: str, transform=lambda df: df) -> DataFrame:
    """Runs over the files that are new since the last call and ends; returns the table so far. Exactly once, by the file
    sink's log."""
    rows = transform(spark.readStream.schema(schema).parquet(source))
    rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table)
