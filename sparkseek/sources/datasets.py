"""Benchmark datasets: repositories and annotated queries from JSON, results to JSON."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import category

TARGET = "struct<path:string,start_line:int,end_line:int>"
ANNOTATION = "repo string, query string, category string, relevant array<string>, secondary array<string>"


def repos(spark: SparkSession, path: str) -> DataFrame:
    """(name, language, url, revision, benchmark_root) of a JSON array of repositories."""
    return spark.read.schema("name string, language string, url string, revision string, benchmark_root string").json(path, multiLine=True)


def tasks(spark: SparkSession, folder: str, repos_: DataFrame, only_repos: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(query_id, repo, language, query, category, targets) of the annotation files, one JSON array for each repository.

    A target is a path or an object with path and lines; objects arrive as JSON text and are parsed. A row's repository is its
    file's name unless it says otherwise; rows of unknown repositories are left out. query_id follows file, then place in it.
    """
    rows = spark.read.schema(ANNOTATION).json(f"{folder}/*.json", multiLine=True).withColumn("_n", F.monotonically_increasing_id())
    own = F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1)
    listed = F.concat(F.coalesce("relevant", F.array().cast("array<string>")), F.coalesce("secondary", F.array().cast("array<string>")))
    plain = lambda t: F.struct(t.alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    targets = F.transform(listed, lambda t: F.when(F.startswith(t, F.lit("{")), F.from_json(t, TARGET)).otherwise(plain(t)))
    known = rows.withColumn("repo", F.coalesce("repo", own)).join(F.broadcast(repos_.select(F.col("name").alias("repo"), "language")), "repo")  # one row a repository
    if only_repos:
        known = known.where(F.col("repo").isin(only_repos))
    if languages:
        known = known.where(F.col("language").isin(languages))
    return known.select(F.col("_n").alias("query_id"), "repo", "language", "query", F.coalesce("category", category(F.trim("query"))).alias("category"), targets.alias("targets"))


def commit(folder: str = ".") -> str:
    """The folder's git commit, or "unknown"."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if not done.returncode else "unknown"


def save_results(folder: str, method: str, payload: object) -> str:
    """Writes a report as JSON to <method>-<commit's first 12 digits>.json; returns its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{method}-{commit()[:12]}.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(payload, indent=2) + "\n")
    return path
