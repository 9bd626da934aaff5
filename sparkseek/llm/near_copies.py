"""Near copies by exact similarity: SimHash links first, then every pair that can reach the similarity.

A text is the set of its word shingles (lowered and split as for SimHash; a text with fewer words than a
shingle has them all as its one shingle), each a 64-bit hash. Two texts are near copies if the sets'
Jaccard similarity is at least 4/5. No distance of fingerprints decides that: at 4/5 about ten of 64
bits differ on average, and a pair may differ in any number. So fingerprints only propose, and what they miss
is found by prefixes:

1. Equal sets are one node. All shingles have one total order, rare ones first: by the number of nodes that have
   them, counted over all texts, then by value. Two sets of n and m shingles that are similar share
   one of their first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1. A cell holds the nodes that have one
   shingle there; cells of one node are dropped. Shingles of one node come first and are only counted. The counting
   takes rounds, each for a share of the shingles by value, so that only this share is on disk at once.
2. Cheap pairs, in proportion to the nodes: SimHash links within two bits, and in each cell its nodes in a
   random order, each with the one before it and with the first. They are compared exactly and those that
   are similar form components, so that a large group of near copies needn't be paired.
   A comparison first bounds what two sets can share by their counts of shingles by leading byte; sets are made again, from one text for
   each node, for the pairs that this leaves, so that they are never stored for all texts.
3. In cells that still hold several components, each node is compared with the PARTNERS before it, in another random order
   within its size, that are of other components. This is repeated while at least one pair in a hundred so compared is similar:
   rows that resemble only some of a large group's members thus join it without meeting all of them.
4. In cells that still hold several components, all pairs of different components are compared, unless their
   sizes or places in the order rule the similarity out.

Every similar pair is either compared or already connected, so the components are exact, up to hash collisions.
Texts without words are equal to each other. Rows with null ids take part like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from ._common import cut, drop, raw, slices, tidy
from .components import components

BROADCAST, PARTNERS, ROUNDS = 2_000_000, 24, 3
SAMPLE = 16_000  # rows of which all shingles are counted in one round; more take ROUNDS


def _first_places(n: Column) -> Column:
    """How many of n shingles in order hold one that any similar set shares."""
    return n - F.floor((4 * n + 4) / 5) + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _set(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _nodes(shingle: int):
    """id, h, node, fingerprint, size and shingles by leading byte of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, prints, sketches, sizes = [], [], [], []
                for text in raw(part.column("text")):
                    blocks = list(simhash.hashed(text, shingle))
                    own = _set(blocks)
                    nodes.append(_node(own))
                    prints.append(simhash.majority(blocks))
                    sketches.append(np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                    sizes.append(len(own))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), _signed(nodes), _signed(prints), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], ["id", "h", "node", "fp", "n", "sketch"])
        tidy()

    return run


def _sets(shingle: int):
    """node, size and all shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [_set(list(simhash.hashed(text, shingle))) for text in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays([_signed([_node(x) for x in sets]), pa.array([len(x) for x in sets], pa.int32()), _lists(sets)], ["node", "n", "shingles"])
        tidy()

    return run


def _shingles(shingle: int, turn: int, rounds: int):
    """node and shingle, a row for each of a text's shingles that are the turn's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [_set(list(simhash.hashed(text, shingle))) for text in raw(part.column("text"))]
                mine = [own[(own >> np.uint64(32)) % np.uint64(rounds) == turn] for own in sets]
                nodes = np.repeat(np.array([_node(x) for x in sets], np.uint64), [len(x) for x in mine])
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(np.concatenate(mine).view(np.int64))], ["node", "s"])
        tidy()

    return run


def _shared(rows: DataFrame, shingle: int) -> list[DataFrame]:
    """(node, s, k) of each node's shingles that other nodes have too; k: the nodes that have it."""
    rounds, here = ROUNDS if rows.count() > SAMPLE else 1, Window.partitionBy("s")
    out = []
    for turn in range(rounds):
        every = rows.mapInArrow(_shingles(shingle, turn, rounds), "node long, s long")
        once = every.withColumn("was", F.lag("node").over(here.orderBy("node"))).where("was is null or was <> node")
        out.append(cut(once.withColumn("k", F.count("*").over(here)).where("k > 1").select("node", "s", "k")))
    return out


def _first(shared: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """(s, x) of the shared shingles in each node's first places; x: node, size and place."""
    own, n, rows = Window.partitionBy("node"), F.col("n"), shared[0]
    for more in shared[1:]:
        rows = rows.unionByName(more)
    placed = rows.withColumns({"i": F.row_number().over(own.orderBy("k", "s")), "k": F.count("*").over(own)}).join(sizes, "node").withColumn("at", (n - F.col("k") + F.col("i") - 1).cast("int"))
    return placed.where(F.col("at") < _first_places(n)).select("s", F.struct("node", "n", "at").alias("x"))


def _similar(shared: Column, n: Column, m: Column) -> Column:
    """Whether shared / (n + m - shared) reaches 4/5."""
    return 9 * shared >= 4 * (n + m)


def _possible(a: str, b: str) -> Column:
    """Whether two rows of a cell, structs of node, n and at, may be similar, this being the first shingle they share."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & _similar(rest, n, m)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose counts of shingles by leading byte leave room for the similarity; counts of 255 may be more."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("ku", "kv"))
            least = np.minimum(a, b)
            n = sum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("nu", "nv"))
            stay = (least.max(axis=1) == 255) | (9 * least.sum(axis=1, dtype=np.int64) >= 4 * n)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(stay)) for c in ("u", "v")], ["u", "v"])


def _verified(pairs: DataFrame, rows: DataFrame, made: DataFrame, one: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) of nodes that are similar; one names a text for each node. Sets are made only if the pair's sketches leave room."""
    pairs = cut(pairs.where("u <> v").distinct())

    def chosen(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        return cut(one.join(ends, "node", "left_semi").select(F.col("x.id").alias("_i"), F.col("x.h").alias("_h")))

    def of(frame: DataFrame, needed: DataFrame) -> DataFrame:
        needed = F.broadcast(needed) if needed.count() <= BROADCAST else needed
        return frame.join(needed, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left_semi")

    def both(pairs: DataFrame, own: DataFrame, what: str, k: str) -> DataFrame:
        side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col(what).alias(f"{k}{x}"))
        return pairs.join(side("u"), "u").join(side("v"), "v")

    needed = chosen(pairs)
    sketches = of(made, needed).select("node", "n", "sketch").dropDuplicates(["node"])
    left = cut(both(pairs, sketches, "sketch", "k").select("u", "v", "nu", "nv", "ku", "kv").mapInArrow(_bounded, "u long, v long"))
    drop(pairs, needed)
    needed = chosen(left)
    sets = cut(of(rows, needed).mapInArrow(_sets(shingle), "node long, n int, shingles array<long>").dropDuplicates(["node"]))
    near = cut(both(left, sets, "shingles", "s").where(_similar(F.size(F.array_intersect("su", "sv")), F.col("nu"), F.col("nv"))).select("u", "v"))
    drop(left, needed, sets)
    return near


def _proposed(made: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints are equal or link, by the smallest node of each fingerprint."""
    prints = cut(made.where("n > 0").select("fp", "node").distinct())
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("low")))
    same = prints.join(least, "fp").select(*_ordered(F.col("node"), F.col("low")))
    ends = [least.select(F.col("fp").alias(x), F.col("low").alias(f"low_{x}")) for x in ("u", "v")]
    linked = simhash.links(least.select("fp")).join(ends[0], "u").join(ends[1], "v").select(*_ordered(F.col("low_u"), F.col("low_v")))
    return same.unionByName(linked)


def _open(cells: DataFrame, near: DataFrame) -> DataFrame:
    """The rows (s, x, r) of cells that hold several components, r being the row's component."""
    roots, here = components(near).withColumnRenamed("u", "node"), Window.partitionBy("s")
    placed = cells.select("s", "x", F.col("x.node").alias("node")).join(roots, "node", "left").select("s", "x", F.coalesce("root", "node").alias("r"))
    rows = cut(placed.withColumns({"lo": F.min("r").over(here), "hi": F.max("r").over(here)}).where("lo <> hi").select("s", "x", "r"))
    drop(roots)
    return rows


def _some_across(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of nodes of different components: each row's with those of the PARTNERS rows before it, in an order drawn by turn."""
    size = F.floor(F.log("x.n") / F.log(F.lit(1.25)) + F.lit(turn % 2 / 2))
    mixed = Window.partitionBy("s").orderBy(size, F.xxhash64(F.lit(turn), "s", "x.node"), "x.node").rowsBetween(-PARTNERS, -1)
    other = F.filter("before", lambda y: y["r"] != F.col("r"))
    pairs = rows.select("x", "r", F.collect_list(F.struct("x", "r")).over(mixed).alias("before")).select("x", F.explode(other).alias("y")).select("x", F.col("y.x").alias("y"))
    return pairs.where(_possible("x", "y")).select(*_ordered(F.col("x.node"), F.col("y.node")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, h, root) of every row: h is the text's xxhash64, root is equal for rows that near copies connect."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    made = cut(rows.mapInArrow(_nodes(shingle), "id long, h long, node long, fp long, n int, sketch binary"))

    one = cut(made.groupBy("node").agg(F.min(F.struct("id", "h")).alias("x")))
    shared, here = _shared(rows, shingle), Window.partitionBy("s")
    cells = cut(_first(shared, made.select("node", "n").distinct()).withColumn("k", F.count("*").over(here)).where("k > 1").select("s", "x"))
    drop(*shared)
    mixed = here.orderBy(F.xxhash64("s", "x.node"), "x.node")
    beside = cells.select("x", F.array(F.lag("x").over(mixed), F.first("x").over(mixed)).alias("y")).select("x", F.explode("y").alias("y")).where(_possible("x", "y"))
    near = _verified(_proposed(made).unionByName(beside.select(*_ordered(F.col("x.node"), F.col("y.node")))), rows, made, one, shingle)

    open_, turn, often_similar = _open(cells, near), 0, True
    while often_similar:
        turn += 1
        tried = cut(_some_across(open_, turn).distinct())
        more = _verified(tried, rows, made, one, shingle)
        often_similar = 0 < tried.count() <= 100 * more.count()
        joined = cut(near.unionByName(more))
        drop(near, tried, more, open_)
        near = joined
        open_ = _open(cells, near)
    other = open_.select("s", F.col("x").alias("y"), F.col("r").alias("q"))
    across = open_.join(other, "s").where("x.node < y.node and r <> q").where(_possible("x", "y"))
    far = _verified(across.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")), rows, made, one, shingle)

    roots = components(near.unionByName(far)).withColumnRenamed("u", "node")
    named = cut(made.select("id", "h", "node").join(roots, "node", "left").select("id", "h", F.coalesce("root", "node").alias("root")))
    drop(made, one, cells, near, open_, far, roots)
    return named
