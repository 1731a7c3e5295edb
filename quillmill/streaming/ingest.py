"""Streaming ingest: new text files become paper records in a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.extract import builtin_extract


def ingest_texts(spark: SparkSession, folder: str, table_path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Each file is read once (the checkpoint remembers it); a batch is written under its own number, so
    that a repeated batch replaces itself."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(folder)
    texts = files.select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.[^.]*$", "").alias("paper_id"), F.col("value").alias("text"))

    def store(batch: DataFrame, number: int) -> None:
        builtin_extract(batch).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    writer = texts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
