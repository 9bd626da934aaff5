"""SimHash near-duplicates through a segment-popcount embedding and a grid range join.

Fingerprint: 64 bits; each word shingle (repeats included) votes with the bits of its XXH64 (UTF-8,
seed 42), and a bit is set if over half of the shingles have it. A text with fewer words than a
shingle has them all as its one shingle; a text without words, or a null one, has fingerprint zero.

Links: two fingerprints link if at most `distance` bits differ. The fingerprint is embedded as the
bit counts of 32 segments of two bits, a point of a grid. The Manhattan distance of two points is at most the
number of differing bits, so it is a lower bound. Segments form `groups` runs; within radius
`distance` at most that many runs can differ, so the pair agrees in the bit counts of the others,
that is, shares the grid cell of one choice of `groups - distance` runs. A fingerprint without company in all its
cells has no links. The others are joined by range, without forming a cell's pairs, whatever its size: values within
`distance` of each other lie within half of it of a value between them, so each fingerprint
goes to every value with at most `distance / 2` of its bits changed, and links to the smallest fingerprint there. That loses no
connection and makes rows in proportion to the fingerprints. Each link is kept if the Manhattan distance of the embeddings and then the exact Hamming
distance are within the radius.

Equal fingerprints are one node, whatever the number of documents. Rows with null ids take part in
links but don't name a component unless it has no other ids (then: null); repeated rows, ties and
clashing column names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop, raw, slices
from .components import components

SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EVEN_BITS = 0x5555555555555555


def hashed(text: bytes, shingle: int = 3, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in blocks."""
    words = text.translate(LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    ends = starts + size
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), block):
        pairs = zip(starts[at : at + block].tolist(), ends[at : at + block].tolist(), strict=True)
        yield np.fromiter([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, shingle: int = 3, block: int = 1 << 16) -> int:
    """The fingerprint of a text, in blocks of shingles so that memory stays bounded."""
    return majority(hashed(text, shingle, block))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row, fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([simhash(t, shingle) for t in raw(part.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def counts(fp: Column) -> Column:
    """The embedding: 32 bit counts of two-bit segments, each as a two-bit field of a 64-bit integer."""
    low, high = fp.bitwiseAND(F.lit(EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings: fields 0, 1 and 2 in unary, then differing bits."""
    unary = lambda x: (F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVEN_BITS)).bitwiseOR(x.bitwiseAND(F.lit(EVEN_BITS))), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVEN_BITS)))
    (a1, a2), (b1, b2) = unary(a), unary(b)
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def cells(distance: int, groups: int) -> list[int]:
    """Masks over the embedding, one for each choice of groups - distance runs of segments."""
    ends = [round(i * 32 / groups) for i in range(groups + 1)]
    runs = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(ends, ends[1:], strict=False)]
    masks = [sum(keep) for keep in combinations(runs, groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def between(fp: Column, distance: int) -> Column:
    """All values with at most distance / 2 of fp's bits changed."""
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    flips = [sum(c) for k in range(distance // 2 + 1) for c in combinations(bits, k)]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: fp.bitwiseXOR(x))


def links(prints: DataFrame, distance: int = 2, groups: int = 5) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, prints having them in column fp, that connect all within the distance, which is 0, 2 or 4."""
    if distance not in (0, 2, 4) or groups <= distance:
        raise ValueError("distance must be 0, 2 or 4, and groups more than that")
    masks = cells(distance, groups)
    pts = prints.select("fp", counts(F.col("fp")).alias("e"))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("e").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)])
    placed = pts.select("fp", F.explode(keys).alias("c")).groupBy("c").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("c")
    company = pts.select("fp", F.explode(keys).alias("c")).join(placed, "c", "left_semi").select("fp").distinct()
    near = cut(company.select(F.col("fp").alias("u"), F.explode(between(F.col("fp"), distance)).alias("mid")))
    least = near.groupBy("mid").agg(F.min("u").alias("v"))
    pairs = near.join(least, "mid").where("u <> v").select("u", "v").distinct()
    kept = cut(pairs.where(manhattan(counts(F.col("u")), counts(F.col("v"))) <= distance).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
    drop(near)
    return kept


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    edges = links(nodes, distance)
    roots = components(edges).withColumnRenamed("u", "fp")
    rooted = cut(nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    drop(nodes, edges, roots, rooted)
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
