"""Extendible hashing of documents into shards of bounded bytes, in DataFrame functions only.

A document's key hashes to 60 bits. Shards are the leaves of a binary tree over the hash's leading
bits: a bucket holding more than `limit` bytes splits on its next bit, any other bucket stays whole.
The directory maps every prefix of `depth` bits (as many as the round needs) to a leaf, so several
entries may lead to the same shard, as in extendible hashing.

A bucket with a single hash can't be split by bits: a document larger than the limit, or rows with
one key, form a shard of their own once the other hashes have left, marked `oversized`.
Null keys hash as the empty string, null texts have no bytes, an empty table has no shards,
repeated rows keep one shard and count each time; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _bits(total: int, limit: int, left: int) -> int:
    """Bits for the next round: four times as many directory entries as shards of that many bytes."""
    return max(1, min(left, 22, math.ceil(math.log2(max(2.0, total / max(limit, 1)))) + 2))


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """(id, bytes, shard, depth, shard_bytes, oversized) of every row; shard is the prefix as 0s and 1s.

    The text is read once, for its size. Each round adds up bytes by a prefix long enough for its
    largest bucket, and from these sums those of all shorter prefixes; what fits becomes a shard and the
    rest goes on. Sums have at most four entries for a full shard, and only one number comes to the driver.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(id_col).alias("id"), key_hash(F.col(key or id_col)).alias("h"), F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0)).alias("bytes")))
    done, open_, depth = None, rows, 0
    most = rows.agg(F.sum("bytes")).first()[0] or 0
    while True:
        step = _bits(most, limit, BITS - depth)
        deep = depth + step
        fine = open_.groupBy(F.shiftright("h", BITS - deep).alias("p")).agg(F.sum("bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("d")
        nodes = fine.select(levels, "p", "b", "lo", "hi").groupBy("d", F.expr(f"shiftright(p, {deep} - d)").alias("q")).agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = (F.col("b") <= limit) | (F.col("lo") == F.col("hi"))
        # every node carries its bytes down to its entries; an entry's shard is the shortest prefix that fits
        down = fine.select("p", levels).select("p", "d", F.expr(f"shiftright(p, {deep} - d)").alias("q")).join(nodes.where(fits), ["d", "q"])
        entries = cut(down.groupBy("p").agg(F.min_by(F.struct("d", "q", "b"), "d").alias("leaf")).select("p", "leaf.d", "leaf.q", "leaf.b"))
        placed = open_.withColumn("p", F.shiftright("h", BITS - deep)).join(entries, "p", "left")
        leaf = placed.where("d is not null").select("id", "bytes", "d", "q", "b")
        done = leaf if done is None else done.unionByName(leaf)
        left = fine.join(entries, "p", "left_anti").agg(F.max("b")).first()[0]
        if left is None or deep >= BITS:
            break
        open_ = cut(placed.where("d is null").select("id", "h", "bytes"))
        most, depth = left, deep
    bits = F.when(F.col("d") == 0, "").otherwise(F.lpad(F.bin("q"), F.col("d"), "0"))
    return done.select(F.col("id").alias(id_col), "bytes", bits.alias("shard"), F.col("d").cast("int").alias("depth"), F.col("b").alias("shard_bytes"), (F.col("b") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet, a folder for each shard."""
    where = shards(docs, limit, id_col, text_col).select(F.col(id_col).alias("__id"), "shard").distinct()
    docs.join(where, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id").repartition("shard").write.partitionBy("shard").parquet(path)
