"""Mutation logs and counts on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.ingest import Table, compact


def consume(spark: SparkSession, log_path: str, schema, table: Table, checkpoint: str, id_col: str = "_id") -> None:
    """Apply all log files not yet seen to the table, a batch at a time; the checkpoint makes it restartable.

    A batch that is run again gives the same rows, since its changes replace rows by id.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            table.apply(compact(df, id_col), id_col)

    s = spark.readStream.schema(schema).parquet(log_path)
    s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(spark: SparkSession, path: str, schema, ts: str, key: str, width: str, late: str, checkpoint: str, out: str, only: str = "*") -> None:
    """Counts by tumbling window and key of a file stream, appended once a window is closed. only: names of files that count."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", only).parquet(path).withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    c = s.groupBy(F.window("_t", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
    c.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
