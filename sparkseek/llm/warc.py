"""WARC archives: written by Spark tasks, read back with boundary-chain verification.

Writing: each row becomes a record (WARC/1.0, headers, payload in UTF-8). Of records with equal payloads of
at least `least` bytes, the one with the largest id is the response and the others are revisits that refer to
it and have no payload; smaller payloads are always written. Every task writes archives of at most `records`
records through Spark's own writer, so any file system that Spark reaches will do.

Reading: the bytes "WARC/1.0" may also stand inside a payload, where no reader that starts in the middle can
tell. Every occurrence is a candidate; from its headers follows where its successor would begin. Candidates of
a file form a graph with one edge each (offset to successor), and those reachable from offset 0 are the
records. Reachability is found by pointer jumping: with each round the jumps double in length, so a chain of
n records takes log2(n) rounds. A candidate whose headers don't parse, or whose record doesn't end in the
required separator, has no successor. A chain that doesn't end at the end of its file raises an error.

Null payloads are empty, a null url gives no target header, line breaks in urls are percent-encoded. Rows that
repeat the largest id of a payload are all responses. Where ids are null: a null id is never the largest unless
there is no other (then all are responses). Empty tables give no archives and no records; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut

MAGIC = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _record(date: str) -> Column:
    """The text of a record without its last line break, which the writer's line separator adds."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, records: int = 1000, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Archives of the rows in the folder path; compression is gzip or none."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1(F.col("payload").cast("binary")).alias("digest"))
    # only payloads that occur more than once go into the table of originals
    same = cut(rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("top"), F.count("*").alias("k")).where("k > 1").select("digest", "size", "top"))
    linked = rows.join(same, ["digest", "size"], "left")
    refers = F.when(F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), F.col("top"))
    out = linked.withColumn("refers_to", refers).select(_record(date).alias("value"))
    out.write.option("lineSep", "\r\n").option("maxRecordsPerFile", records).option("compression", compression).text(path)


def successor(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(start of payload, end of payload, start of the next record) of a candidate; None if it is no record."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    length = None
    for line in data[at + len(MAGIC) : head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        if name.strip().lower() == b"content-length":
            if not value.strip().isdigit():
                return None
            length = int(value)
    if length is None:
        return None
    start, end = head + 4, head + 4 + length
    return (start, end, end + 4) if data[end : end + 4] == b"\r\n\r\n" else None


def headers(data: bytes, at: int, start: int) -> dict[str, str]:
    lines = data[at + len(MAGIC) : start - 4].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def candidates(data: bytes) -> Iterator[int]:
    at = data.find(MAGIC)
    while at >= 0:
        yield at
        at = data.find(MAGIC, at + 1)


def reachable(offsets: np.ndarray, following: np.ndarray, size: int) -> np.ndarray:
    """Which candidates are on the chain from offset 0, by pointer jumping; following: offset of the next, -1 for none."""
    order = np.argsort(offsets)
    offsets, following = offsets[order], following[order]
    n = len(offsets)
    found = np.searchsorted(offsets, following)
    jump = np.where((found < n) & (offsets[np.minimum(found, n - 1)] == following), found, n)  # n: no candidate there
    jump = np.append(jump, n)
    on = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        on[0] = True
    for _ in range(max(1, n.bit_length())):
        on[jump[on]] = True
        on[n] = False
        jump = jump[jump]
    last = np.flatnonzero(on[:n])
    if size and (not len(last) or following[last[-1]] != size):
        raise ValueError("the chain of records breaks off before the end of the file")
    out = np.empty(n, bool)
    out[order] = on[:n]
    return out


CANDIDATE = "path string, file_size long, at long, following long, kind string, record_id string, url string, digest string, refers_to string, start long, size long, sha1 string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row for each candidate of every archive in the folder."""
    names = [c.split()[0] for c in CANDIDATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                data, rows = bytes(data), []
                if name.endswith(".gz"):
                    data = gzip.decompress(data)
                for at in candidates(data):
                    found = successor(data, at)
                    if found is None:
                        rows.append((name, len(data), at, -1, None, None, None, None, None, 0, 0, None))
                        continue
                    start, end, following = found
                    h = headers(data, at, start)
                    rows.append((name, len(data), at, following, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), start, end - start, hashlib.sha1(data[start:end]).hexdigest()))
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInPandas(run, CANDIDATE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in the folder: the candidates that are reachable from their file's start."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[reachable(rows["at"].to_numpy(), rows["following"].to_numpy(), int(rows["file_size"].iloc[0]))]

    return scan(spark, path).groupBy("path").applyInPandas(keep, CANDIDATE)


def payloads(records: DataFrame) -> DataFrame:
    """(id, size, digest, type, refers_to) of each record; a revisit has its original's size."""
    number = lambda c: F.regexp_extract(c, "<urn:record:(-?[0-9]+)>", 1).try_cast("long")
    rows = records.select(number("record_id").alias("id"), "size", F.regexp_replace("digest", "^sha1:", "").alias("digest"), "sha1", F.col("kind").alias("type"), number("refers_to").alias("refers_to"))
    full = rows.where("type = 'response'")
    checked = full.select("id", "size", F.when(F.col("digest") == F.col("sha1"), F.col("digest")).otherwise(F.raise_error(F.lit("a payload doesn't have the digest of its record"))).alias("digest"), "type", F.lit(None).cast("long").alias("refers_to"))
    revisits = rows.where("type = 'revisit'").select("id", "digest", "type", "refers_to")
    originals = full.select(F.col("digest").alias("digest"), F.col("id").alias("refers_to"), "size").dropDuplicates(["digest", "refers_to"])
    again = revisits.join(originals, ["digest", "refers_to"], "left").select("id", "size", "digest", "type", "refers_to")
    return checked.unionByName(again)
