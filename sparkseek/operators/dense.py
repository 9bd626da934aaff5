"""Exact cosine search: blocks of queries meet every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparse import top_k


def unit(vector: Column) -> Column:
    """The vector divided by its length (plus 1e-8), in doubles."""
    d = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)) + 1e-8
    return F.transform(d, lambda x: x / length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties by id; only what reaches the k-th is sorted."""
    if len(ids) > k:
        at = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[at], scores[at]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024, same: str | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): each query's k vectors of least 1 - cosine.

    vectors: chunk_id, embedding, and the column `same` if given; queries: query_id, embedding, `same`, and self_id if
    exclude_self. Queries are a bounded set; in blocks of `block` they are broadcast, every batch of vectors is
    multiplied with them, each task keeps its k best for each, and a last ranking joins the tasks' bests.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    names = ["chunk_id", "embedding", *([same] if same else [])]
    rows = queries.toLocalIterator()
    found = None
    while part := [r for _, r in zip(range(block), rows)]:  # noqa: B905
        matrix = np.array([r["embedding"] for r in part], np.float64)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-8
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in part], matrix, [r[same] for r in part] if same else None, [r["self_id"] for r in part] if exclude_self else None))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix, groups, selves = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
            for batch in batches:
                batch = batch[batch["embedding"].notna()]
                if not len(batch):
                    continue
                own = batch["chunk_id"].to_numpy()
                stack = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                stack /= np.linalg.norm(stack, axis=1, keepdims=True) + 1e-8
                cosine = matrix @ stack.T
                for i in range(len(ids)):
                    fit = np.ones(len(own), bool)
                    if groups is not None:
                        fit &= (batch[same] == groups[i]).to_numpy()
                    if selves is not None:
                        fit &= own != selves[i]
                    best[i] = _best(np.concatenate((best[i][0], own[fit])), np.concatenate((best[i][1], cosine[i][fit])), k)
            sizes = [len(x) for x, _ in best]
            if sum(sizes):
                yield pd.DataFrame({"query_id": np.repeat(ids, sizes), "chunk_id": np.concatenate([x for x, _ in best]), "score": np.concatenate([s for _, s in best])})

        hits = vectors.select(names).mapInPandas(run, "query_id long, chunk_id long, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    return top_k(found, k)


def related(vectors: DataFrame, sources: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """The nearest vectors of each source chunk (query_id, self_id, embedding) but itself, of the same group if `same`."""
    return search(vectors, sources, k, same=same, exclude_self=True)
