"""From raw documents to training tokens: five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import bpe, decontaminate, near_copies, quality, substring
from sparkseek.llm._common import cut, table

RANKS = "byte_bpe_50k.tiktoken"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality."""
    model = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.with_scores(docs, model).where("predicted = 1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near copies (five-word shingles, similarity of 0.8 or more) connect.

    That with the smallest (id, hash of the text) of all rows, null ids last; rows that agree in both are interchangeable.
    """
    first = near_copies.groups(docs).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("x"))
    stay = first.select(F.col("x.id").alias("__id"), F.col("x.h").alias("__h"))
    own = docs.withColumn("__k", F.xxhash64("text"))
    found = own.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__h")), "left_semi")
    return found.dropDuplicates(["doc_id", "__k"]).select(docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words that occur earlier; those of which nothing is left go."""
    found = substring.dedup(docs).where("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of fewer than two benchmark items; a single item's passages are cut out."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).where(F.size("items") < 2)
    clean = decontaminate.without_hits(found)
    return clean.withColumn("n_chars", F.when(F.size("items") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (binary, little-endian unsigned 32-bit integers) and whether they decode to its text."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    found = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", near_dedup), ("substring dedup", passage_dedup), ("benchmark decontamination", decontamination), ("byte-level BPE", tokens)]

#: SQL can't express the classifier, the fingerprints' hash or the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
