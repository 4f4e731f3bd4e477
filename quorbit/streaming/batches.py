"""Batch records as they are appended: the stream form of the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quorbit.operators.summary import summarize
from quorbit.sources.files import BATCH_SCHEMA


def batch_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(BATCH_SCHEMA).option("header", True).csv(folder)


def follow(spark: SparkSession, folder: str, table: str, summary_path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to ``table``, then writes the summary of all that arrived.

    A micro-batch that is run again replaces its own folder, so a lost driver
    counts no record twice.
    """

    def consume(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        summarize(rows.sparkSession.read.parquet(table)).write.mode("overwrite").parquet(summary_path)

    return batch_stream(spark, folder).writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
