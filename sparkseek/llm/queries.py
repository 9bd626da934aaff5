"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprints, html_text, quality, sharding, simhash, substring, toxicity, warc
from ._common import scratch, table

RANKS = "byte_bpe_50k.tiktoken"
SHARD_BYTES = 1 << 20


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.payloads(warc.read(spark, path))
    return found.select(F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return quality.with_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(decontaminate.matches(docs, table(spark, sf_dir, "benchmark")))
    return found.withColumn("contaminated", F.col("n_items") >= 2)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_simhash, op3_toxicity, op4_sharding, op5_substring, op6_warc, op7_quality, op8_decontamination, op9_html, op10_bpe)
}

ORACLES: dict[str, str] = {
    "op4_sharding": f"""
WITH d AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), n AS (
    SELECT doc_id, bytes, h, d, h >> (60 - d) AS q FROM d, (SELECT unnest(range(0, 61)) AS d)
), s AS (
    SELECT *, sum(bytes) OVER w AS b, min(h) OVER w AS lo, max(h) OVER w AS hi FROM n WINDOW w AS (PARTITION BY d, q)
), leaf AS (
    SELECT *, min(d) OVER (PARTITION BY doc_id, h) AS least FROM s WHERE b <= {SHARD_BYTES} OR lo = hi
)
SELECT doc_id, bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(q), d::INTEGER, '0') END AS shard, d::INTEGER AS depth, b::BIGINT AS shard_bytes, b > {SHARD_BYTES} AS oversized
FROM leaf WHERE d = least""",
    "op5_substring": r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
    SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM t
), w AS (
    SELECT doc_id, i, words[i] AS word, CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i : i + 19], ' ') END AS k FROM p
), r AS (
    SELECT doc_id, i, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM w
), c AS (
    SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), a AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN a USING (doc_id)""",
    "op6_warc": """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), t AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM t""",
    "op8_decontamination": r"""
WITH b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), v AS (
    SELECT DISTINCT item_id, least(8, len(words)) AS n, array_to_string(words[i : i + 7], ' ') AS k
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 0) + 2)) AS i FROM b WHERE len(words) > 0)
), t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), g AS (
    SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS k
    FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM t), (SELECT DISTINCT n FROM v) WHERE i + n - 1 <= len(words)
), m AS (
    SELECT doc_id, i, n, item_id FROM g JOIN v USING (n, k)
), h AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id
), c AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
