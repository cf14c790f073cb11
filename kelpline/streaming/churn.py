"""Churn of commits that arrive as files: sliding 30-day windows, with late rows up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def churn_windows(commits: DataFrame, late: str = "30 days", length: str = "30 days", slide: str = "1 day") -> DataFrame:
    """commits (date, path, added, removed; a stream or a table) to start, path, commits, added, removed."""
    rows = commits.withWatermark("date", late) if commits.isStreaming else commits
    per = rows.groupBy(F.window("date", length, slide), "path").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return per.select(F.col("window.start").alias("start"), "path", "commits", "added", "removed")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in what there is and ends; windows that the watermark has passed are written."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
