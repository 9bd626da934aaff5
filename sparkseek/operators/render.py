"""Search results as text: numbered, fenced blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import location, trimmed


def rendered(results: DataFrame, header: str) -> DataFrame:
    """(query_id, rendered); results: query_id, rank, score, file_path, start_line, end_line, content, and locator if there is one."""
    place = location(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("locator") if "locator" in results.columns else None)
    block = F.concat(F.format_string("## %d. %s  [score=%.3f]\n```\n", F.col("rank"), place, F.col("score")), trimmed(F.col("content")), F.lit("\n```\n"))
    blocks = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("b"))  # at most k a query
    return blocks.select("query_id", F.concat(F.lit(header + "\n\n"), F.array_join(F.transform("b", lambda x: x["b"]), "\n")).alias("rendered"))
