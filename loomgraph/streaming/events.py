"""Relations kept up to date from arriving files, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """``(start, event_type, n, value)`` per tumbling window; a stream drops what is later than ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` between two listings ``(path, content)`` by content hash."""
    digest = lambda df, name: df.select("path", F.sha2("content", 256).alias(name))
    both = digest(old, "a").join(digest(new, "b"), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def keep_relations(files: DataFrame, target: str, checkpoint: str):
    """Starts a query that extracts each arriving batch of files and writes its records."""
    from loomgraph.sources.python_code import extract

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
