"""Byte-level BPE encoding and decoding by a rank file.

A text is split by a pattern, and each match is encoded by itself. Its bytes are the leaves of a segment
tree: leaf i holds the rank of merging the part that begins at byte i with the part after it, and an inner
node holds the least (rank, position) below it, so the root names the leftmost pair of least rank. A merge changes
three leaves (the pair's own, the one before it, the one that is gone), each in a logarithmic number of
steps, so a match of n bytes takes O(n log n), however long it is. Parts form a linked list by byte positions.

Matches repeat, so each worker keeps those it has encoded, up to a fixed number. The rank file is read once on the
driver and broadcast; its size is fixed.

Null texts are empty and have no ids; special tokens' strings are ordinary text. Repeated rows get equal
results; an empty table works; extra columns are ignored by `encode` and `decode`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, tidy

NONE = 1 << 62
POSITION = (1 << 40) - 1
KEEP = 300_000  # encoded matches in each of a worker's two generations, give or take a step
STEP = 1 << 14  # matches that are encoded between two looks at how many are kept


class Kept(dict):
    """Encoded matches; one that isn't there is taken from the older generation or encoded."""

    def __init__(self, codec: Codec, older: dict[str, bytes]):
        self.codec, self.older = codec, older

    def __missing__(self, match: str) -> bytes:
        found = self.older.get(match)
        if found is None:
            raw = match.encode()
            rank = self.codec.ranks.get(raw)
            found = pack("<I", rank) if rank is not None else pack(f"<{len(ids := self.codec.merges(raw))}I", *ids)
        if len(match) <= 64:
            self[match] = found
        return found


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.forget()

    def merges(self, match: bytes) -> list[int]:
        """The ids of one match."""
        n, rank_of = len(match), self.ranks.get
        if n < 2:
            return [self.ranks[match[i : i + 1]] for i in range(n)]
        # after[i]: where the part that begins at i ends, and the next one begins; before[i]: where the part before it begins
        after, before = list(range(1, n + 2)), list(range(-1, n))
        width = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            rank = rank_of(match[i : i + 2])
            if rank is not None:
                tree[width + i] = rank << 40 | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        while (least := tree[1]) < NONE:
            i = least & POSITION
            j = after[i]
            k = after[i] = after[j]
            changed = [width + i]
            if j < n - 1:
                tree[width + j] = NONE
                changed.append(width + j)
            rank = None
            if k < n:
                before[k] = i
                rank = rank_of(match[i : after[k]])
            tree[width + i] = NONE if rank is None else rank << 40 | i
            h = before[i]
            if h >= 0:
                rank = rank_of(match[h:k])
                tree[width + h] = NONE if rank is None else rank << 40 | h
                changed.append(width + h)
            for at in changed:
                while at > 1:
                    a, b = tree[at], tree[at ^ 1]
                    if b < a:
                        a = b
                    at >>= 1
                    if tree[at] == a:
                        break
                    tree[at] = a
        out, i = [], 0
        while i < n:
            out.append(self.ranks[match[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        matches, out = self.split(text), []
        for at in range(0, len(matches), STEP):
            if len(self.kept) >= KEEP:
                self.kept.older = {}
                self.kept = Kept(self, self.kept)
            out.append(b"".join(map(self.kept.__getitem__, matches[at : at + STEP])))
        return b"".join(out)

    def forget(self) -> None:
        """Drops the kept matches; a worker that waits for its next task holds none."""
        self.kept = Kept(self, {})

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(file: bytes, pattern: str) -> Codec:
    """The codec of a rank file's bytes; one for each process."""
    key = hash(file), pattern
    if key not in _CODECS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row; ids is binary, little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([own.encode(t or "") for t in part.column("text").to_pylist()], pa.binary())], ["id", "ids"])
        own.forget()
        tidy()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with the bytes that its ids stand for in column decoded."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = encoded.drop("decoded")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, ids_col, 2 << 20):
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array([own.decode(x or b"") for x in part.column(ids_col).to_pylist()], pa.binary())], [*names, "decoded"])
        tidy()

    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit(b"")).schema)
