"""Chunkers as row-generating expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES, OVERLAP = 50, 5


def lines(text: Column) -> Column:
    """Lines with their ends (\\n, \\r\\n or \\r); an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)|(?<=\r)(?!\n)", -1), lambda x: x != "")


def line_chunks(files: DataFrame, text: str = "content", size: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """files' other columns with start_line, end_line and content: windows of `size` lines that overlap; blank ones are dropped."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    split = files.withColumn("_l", lines(F.col(text))).drop(text)
    last = F.greatest(F.lit(0), F.ceil((F.size("_l") - size) / F.lit(float(step))).cast("int")) * step
    out = split.where(F.size("_l") > 0).withColumn("_s", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    part = F.slice("_l", F.col("_s") + 1, size)
    out = out.select("*", (F.col("_s") + 1).cast("int").alias("start_line"), F.least(F.col("_s") + size, F.size("_l")).cast("int").alias("end_line"), F.array_join(part, "").alias("content"))
    return out.drop("_l", "_s").where(F.col("content").rlike(r"(?U)\S"))


def page_chunks(files: DataFrame, text: str = "content", size: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """Line windows within pages (divided by form feeds), with the page's number; lines count through the file."""
    pages = files.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f", -1)).alias("_p", "_t"))
    before = F.aggregate(F.slice(F.split(F.coalesce(F.col(text), F.lit("")), "\f", -1), F.lit(1), F.col("_p")), F.lit(0), lambda n, p: n + F.length(F.regexp_replace(p, "[^\n]", "")))
    numbered = pages.withColumn("_b", before).withColumn("page", (F.col("_p") + 1).cast("int")).drop(text, "_p")
    out = line_chunks(numbered.withColumnRenamed("_t", "content"), "content", size, overlap)
    return out.withColumn("start_line", (F.col("start_line") + F.col("_b")).cast("int")).withColumn("end_line", (F.col("end_line") + F.col("_b")).cast("int")).drop("_b")


def resolve(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """(place_id, chunk_id) of the chunk that holds each place's line: the first that doesn't end there, else the first that does.

    places: place_id, file_path, line.
    """
    own = chunks.select("chunk_id", "file_path", "start_line", "end_line")
    found = places.join(own, "file_path").where("line between start_line and end_line")
    return found.groupBy("place_id").agg(F.min_by("chunk_id", F.struct((F.col("line") == F.col("end_line")).cast("int"), "chunk_id")).alias("chunk_id"))
