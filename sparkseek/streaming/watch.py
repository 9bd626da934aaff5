"""Change events: a path's changes that follow each other within a gap are one burst (trailing-edge debounce)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP = "1600 milliseconds"


def bursts(changes: DataFrame, gap: str = GAP, late: str | None = None) -> DataFrame:
    """(path, first_change, last_change, n) of each burst; changes: path, ts. `late` sets a watermark, as streams need."""
    rows = changes.where("path is not null and ts is not null")
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy("path", F.session_window("ts", gap)).agg(F.min("ts").alias("first_change"), F.max("ts").alias("last_change"), F.count("*").alias("n")).drop("session_window")


def watch(spark: SparkSession, folder: str, rebuild: Callable[[DataFrame], None], every: str = GAP) -> StreamingQuery:
    """Calls rebuild with the files that appeared or changed in the folder, once for each trigger that has any.

    A file source doesn't see deletions; a rebuild should list the folder anew.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "modificationTime", "length").writeStream.foreachBatch(lambda df, _: rebuild(df)).trigger(processingTime=every).start()
