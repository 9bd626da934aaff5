"""An index over a source tree or a table: chunks, postings and vectors as Parquet, and searches over it."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import files as kinds
from .functions import text
from .operators import chunks as chunking
from .operators import dense, markup, rank, render, sparse
from .plans import store
from .sources import files, models

MODES = ("hybrid", "semantic", "bm25")
CHUNK = "chunk_id long, file_path string, start_line int, end_line int, content string, language string, heading_path array<string>, locator " + markup.LOCATOR
IN_FILE = 20  # bits of a chunk's number within its file


class Index:
    """chunks: chunk_id, file_path, start_line, end_line, content, language, heading_path, locator.

    postings (term, chunk_id, tf, dl, df, weight) and vectors (chunk_id, embedding, language, file_path) are written to the index's
    folder by the first search that needs them; searches read them from there. The folder is in the shared one until the index is saved.
    """

    def __init__(self, chunks: DataFrame, encoder=None, folder: str | None = None):
        self.spark, self.chunks, self.encoder = chunks.sparkSession, chunks, encoder
        self.folder = folder or store.scratch(self.spark, "index")
        self.made: dict[str, DataFrame] = {}

    def _part(self, name: str, write: Callable[[str], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = write(f"{self.folder}/{name}")
        return self.made[name]

    @property
    def postings(self) -> DataFrame:
        return self._part("postings", lambda path: sparse.build(sparse.occurrences(self.chunks), self.chunks.count(), path))

    @property
    def vectors(self) -> DataFrame:
        embedded = models.embed(self.chunks, self.encoder) if self.encoder is not None else models.empty(self.spark)
        return self._part("vectors", lambda path: store.written(embedded.join(self.chunks.select("chunk_id", "language", "file_path"), "chunk_id"), path))

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, encoder=None, extensions: list[str] | None = None, ignore: tuple[str, ...] = (), include_text_files: bool = False, newest: datetime | None = None) -> Index:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if not os.path.isdir(path):
            raise NotADirectoryError(path)
        listed = files.listing(spark, path, extensions=extensions, documents=include_text_files, ignore=ignore, newest=newest)
        read = files.read(listed).withColumn("language", kinds.language(F.col("file_path")))
        return cls.from_files(read, encoder)

    @classmethod
    def from_git(cls, spark: SparkSession, url: str, ref: str | None = None, **options) -> Index:
        shared = store.shared_dir(spark)
        if "://" in shared and not shared.startswith("file://"):
            raise RuntimeError(f"git clones into folders of the file system only, not into {shared}")
        with files.cloned(url, ref, within=shared.removeprefix("file://")) as folder:
            return cls.from_path(spark, folder, **options)

    @classmethod
    def from_files(cls, read: DataFrame, encoder=None) -> Index:
        """An index of files (file_id, file_path, language, content, and kind if that decides how they are cut); file_id orders them."""
        cut = markup.chunk(read)
        order = Window.partitionBy("file_id").orderBy("start_line", "end_line", "content")  # chunks follow the files' order
        numbered = cut.withColumn("chunk_id", F.shiftleft("file_id", IN_FILE) + F.row_number().over(order)).drop("file_id")
        folder = store.scratch(cut.sparkSession, "index")
        made = store.written(numbered, f"{folder}/chunks")  # the files may go, and executors may be lost, without harm to the index
        if not made.limit(1).count():
            store.remove(cut.sparkSession, folder)
            raise ValueError("nothing to index")
        return cls(made, encoder, folder)

    def save(self, path: str) -> None:
        for name in ("chunks", "postings", "vectors"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def close(self) -> None:
        """Removes the index's folder, unless it was saved there and opened."""
        if "opened" not in self.made:
            store.remove(self.spark, self.folder)

    @classmethod
    def open(cls, spark: SparkSession, path: str, encoder=None) -> Index:
        out = cls(spark.read.parquet(f"{path}/chunks"), encoder, path)
        out.made = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "vectors")} | {"opened": out.chunks}
        return out

    def stats(self) -> DataFrame:
        return self.chunks.groupBy("language").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"))

    def _allowed(self, languages: list[str] | None, paths: list[str] | None) -> DataFrame | None:
        """Chunks of any of the languages or paths; None (no filter) if there are none."""
        if not languages and not paths:
            return None
        own = self.chunks.where(F.col("language").isin(languages or []) | F.col("file_path").isin(paths or [])).select("chunk_id")
        return own if own.limit(1).count() else None

    def search_many(self, queries: DataFrame, k: int = 10, mode: str = "hybrid", languages: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
        """Results (query_id, rank, score and the chunk's columns) of queries (query_id, query, and alpha if given)."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        asked = queries.where(~text.is_blank(F.col("query")))
        given = F.col("alpha") if "alpha" in queries.columns else F.lit(None)
        checked = F.when(given.cast("double").between(0, 1) | given.isNull(), text.alpha(F.col("query"), given)).otherwise(F.raise_error(F.lit("alpha must be between 0 and 1")))
        asked = asked.withColumn("alpha", checked)
        allowed = self._allowed(languages, paths)
        fetch = k if mode != "hybrid" else 5 * k
        found = lexical = semantic = None
        if mode != "semantic":
            found = lexical = sparse.search(self.postings, asked, fetch, allowed)
        if mode != "bm25" and k >= 1:
            vectors = self.vectors if allowed is None else self.vectors.join(allowed, "chunk_id", "left_semi")
            points = models.embed(asked.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("content")), self.encoder).withColumnRenamed("chunk_id", "query_id") if self.encoder else models.empty(self.spark).withColumnRenamed("chunk_id", "query_id")
            found = semantic = dense.search(vectors, points, fetch)
        elif mode != "bm25":
            raise ValueError("k must be at least 1")
        if mode == "hybrid":
            found = rank.hybrid(semantic, lexical, asked, self.chunks, k)
        return found.select("query_id", "chunk_id", "score", "rank").join(self.chunks, "chunk_id").withColumn("source", F.lit(mode))

    def search(self, query: str, k: int = 10, mode: str = "hybrid", alpha: float | None = None, **filters) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query, alpha)], "query_id long, query string, alpha double")
        return self.search_many(asked, k, mode, **filters)

    def resolve(self, file_path: str, line: int) -> int | None:
        place = self.spark.createDataFrame([(0, file_path, line)], "place_id long, file_path string, line int")
        row = chunking.resolve(self.chunks, place).first()
        return row["chunk_id"] if row else None

    def find_related(self, chunk_id: int, k: int = 5) -> DataFrame:
        """The nearest chunks of the same language, by the stored vectors."""
        one = self.spark.createDataFrame([(0, chunk_id)], "query_id long, chunk_id long")
        return self.find_related_many(one, k)

    def find_related_many(self, sources: DataFrame, k: int = 5) -> DataFrame:
        """find_related for each row of sources (query_id, chunk_id) in one search, with its query_id."""
        ids = sources.select("query_id", F.col("chunk_id").alias("self_id"))
        own = ids.join(self.vectors.select(F.col("chunk_id").alias("self_id"), "embedding", "language"), "self_id")
        hits = dense.related(self.vectors, own, k, same="language")
        return hits.join(self.chunks, "chunk_id").withColumn("source", F.lit("semantic"))

    def format(self, results: DataFrame, header: str) -> str:
        row = render.rendered(results, header).first()
        return row["rendered"] if row else f"{header}\n"


__all__ = ["MODES", "Index"]
