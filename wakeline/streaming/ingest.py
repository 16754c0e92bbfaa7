"""Incremental ingest: new CSV files of a folder become typed, day-partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wakeline.functions.scalars import day_columns
from wakeline.sources.csv_ingest import raw_rows, typed
from wakeline.sources.layouts import DAY


def ingest_new(spark: SparkSession, folder: str, out: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Process the files that have come since the last call, then stop; each is taken exactly once."""
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", max_files).load(folder)
    rows = typed(raw_rows(lines)).withColumns(day_columns(F.col("BaseDateTime")))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy(*DAY).trigger(availableNow=True).start()
