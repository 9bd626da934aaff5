"""The driver's tables as chunks, vectors and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt out to all of them before costly expressions; larger tables as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk of a file source/lang/doc_<id>.txt."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("chunk_id"), path.alias("file_path"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("language"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as one chunk of the conversation's file."""
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("chunk_id"), path.alias("file_path"), F.coalesce("text", F.lit("")).alias("content"), F.col("role").alias("language"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a chunk of code that defines or uses a name made from the part's own, in a file whose path may have it too."""
    k, n, kind = F.col("p_partkey"), (F.col("p_partkey") % 50).cast("string"), F.lower("p_type")
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    name, snake = F.concat(camel, n), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), n)
    said = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    paths = [said("src/", snake, ".py"), said("src/", kind, "/", F.lower(name), "s.rb"), said("tests/test_", snake, ".py"), said("src/", kind, "/util_", n, ".py"), said("examples/", F.lower(name), ".ts"), said("types/", F.lower(name), ".d.ts"), said("lib/", F.lower(camel), ".cs")]
    contents = [said("class ", name, ":\n    pass"), said("x = ", name, "()"), said("create table ", name, " (id int)"), said("fn  base::", name, "<T>")]
    asked = [name, said("Base::", name), said("how does ", name, " work with ", kind), said(F.col("p_name"), " of the ", kind, " tests")]
    one = lambda of, by: F.get(F.array(*of), (by % len(of)).cast("int"))
    return table(spark, sf_dir, "part").select(k.cast("long").alias("chunk_id"), one(paths, k).alias("file_path"), one(contents, k).alias("content"), F.when(k % 40 == 0, one(asked, F.floor(k / 40))).alias("query"))


def windows(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, window) of every run of n words of the texts, once for each key."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    rows = df.select(key, words.alias("_w")).where(F.size("_w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, F.lit(n)), " "))
    return rows.select(key, F.explode(F.array_distinct(runs)).alias("window"))
