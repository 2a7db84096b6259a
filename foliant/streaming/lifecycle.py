"""Uploaded files through their states as a stream, and limits on requests. Extensions: the states are the stored ones, the stream is ours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources import tables


def process_batch(batch: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work gives text, confidence and error for each row of (document_id, content); the state follows: failed with an error, else completed."""
    done = work(batch)
    return done.withColumns({"status": F.when(F.col("error").isNotNull(), "failed").otherwise("completed"), "error_message": F.col("error")})


def run_stream(stream: DataFrame, work: Callable[[DataFrame], DataFrame], root: str, checkpoint: str):
    """Write results for each batch of a stream of (document_id, file_name, content, length). Recognised text is written before the state, so a later failure keeps it.

    Each batch writes to folders named by its number, replacing what a failed attempt left: every batch is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = process_batch(batch, work).persist()
        try:
            done.where("error is null").select("document_id", F.col("text").alias("raw_text"), "confidence").write.mode("overwrite").parquet(f"{root}/document_ocr_results/batch={number}")
            done.select("document_id", "file_name", "status", "error_message").write.mode("overwrite").parquet(f"{root}/documents/batch={number}")
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, root: str) -> DataFrame:
    """Each document's state by its last batch."""
    rows = spark.read.parquet(f"{root}/documents")
    return rows.groupBy("document_id").agg(F.max_by(F.struct("file_name", "status", "error_message"), "batch").alias("r")).select("document_id", "r.*")


def over_limit(requests: DataFrame, most: int = 60, client: str = "user_id", at: str = "ts", width: str = "1 minute", lateness: str | None = None) -> DataFrame:
    """Windows in which a client made more requests than allowed; works on streams, too, given how late events may be."""
    if lateness:
        requests = requests.withWatermark(at, lateness)
    counted = requests.groupBy(F.window(at, width), client).agg(F.count("*").alias("requests"))
    return counted.where(F.col("requests") > most).select(F.col("window.start").alias("window_start"), client, "requests")


STATUS = tables.STATUS
