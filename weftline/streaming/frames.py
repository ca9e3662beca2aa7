"""Frames from a stream of lines: one batch, one set of frames, written idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.frames import compress_frames, frame_texts
from ..sources.lines import dense_rows


def read_line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(F.col("value").alias("line"))


def write_frames(lines: DataFrame, out: str, checkpoint: str, rows: int = 1000, available_now: bool = True):
    """Start a query that writes each micro-batch's frames to ``out``/batch=N; a repeated batch overwrites itself."""
    ship(lines.sparkSession)

    def batch(df: DataFrame, batch_id: int) -> None:
        numbered = dense_rows(df.select("line", F.monotonically_increasing_id().alias("at")), "at")
        compress_frames(frame_texts(numbered, rows)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def template_counts(lines: DataFrame) -> DataFrame:
    """A running count of templates over a stream of lines, for schema drift."""
    from ..operators.reshape import tokenised_rows

    return tokenised_rows(lines).groupBy("template_id").agg(F.count("*").alias("rows"), F.max(F.size("vals")).alias("cols"))
