"""Removal of repeated passages by FM-indexes over shards of the corpus.

A window is `window` consecutive words of one document. A window is repeated if its word sequence
also starts earlier: in a document with a smaller id, or earlier in the same one. Words covered by a
repeated window go; windows are judged on the input.

Which shard a document is streamed against, so that not every document passes every shard:

1. Each window is assigned to its minimizer, the run of `gram` words with the least hash in it, the
   leftmost of several, so that no segment holds a window twice. Neighbouring windows with one minimizer form
   a segment (about one for eight words; one a word where a word recurs). Equal windows have equal minimizers, so
   segments whose minimizer no other segment has are unique and go no further.
2. Segments with equal contents (64 bits of hash beside the minimizer's 64) are one part to be searched: its first place stands
   for all, first within a task's slice of texts and then in a grouped minimum, so that one word repeated through a
   document, or a passage many documents share, makes few rows.
3. Shards by minimizer hold the words of these parts. In each, an FM-index (wavelet matrix over the Burrows-Wheeler
   transform) is built and its parts are streamed against it: backward search gives the interval of all
   occurrences of each window. Together they are as many as the places that their parts stand for; where these are two or
   more, the window is reported, and its first occurrence is the interval's first suffix.
4. A minimizer that more than `most` parts share would overload its shard: its parts are cut again by the minimizers of longer
   runs of words, in the end by whole windows, and go to shards by these. The parts, index and search are the same.

Reports reach the documents as intervals: at a part's first place the windows whose first occurrence is elsewhere, at its other places
all windows. The latter are compared with the part that was searched once more, by a second 64-bit hash of the words themselves, before any word goes.

Null and empty texts have no words. Rows with a null id come after all others; rows that share an id are
ordered by a hash of their texts, identical rows are one document and get the same result; clashing
names of other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop, partitions, raw, slices, tidy
from .fmindex import FMIndex

BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SLICE = 2 << 20
PLACE = pa.struct([("doc", pa.int64()), ("at", pa.int32())])
# a part: the key of its shard; the segment it was cut from (mh, ch), at which window of that, and whether that has other places; its first place, windows, places, words and, once it was cut again, their hash
PART = "key long, mh long, ch long, off int, more boolean, doc long, at int, n int, times long, words binary, hash long"
REPORT = "doc long, at int, n int, mh long, ch long, off int, hash long"  # mh is null where the report is for the first place alone


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(BASE)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any runs of words in a sequence of words."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh64_intdigest
        self.words = np.fromiter((digest(w) for w in words), np.uint64, len(words))
        n = len(words)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * _powers(BASE, n), dtype=np.uint64)))
        self.back = _powers(pow(BASE, -1, 1 << 64), n + 1)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * np.uint64(MIX))


def segments(words: list[bytes], lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document number, start in the document, windows, minimizer's hash, content's hash) of each segment.

    words: of all documents, one after the other; lengths: how many each has.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Hashes(words)
    at = np.arange(n - gram + 1)
    grams = hashes.runs(at, at + gram)
    width = window - gram + 1
    document = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(n - window + 1)
    start = start[document[start] == document[start + window - 1]]
    best = np.empty(len(start), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    for a in range(0, len(start), 1 << 16):
        best[a : a + (1 << 16)] = view[start[a : a + (1 << 16)]].argmin(axis=1)
    best += start
    new = np.ones(len(start), bool)
    new[1:] = (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    first = start[head]
    floor = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    of = document[first]
    return of, first - floor[of], count, grams[best[head]], hashes.runs(first, first + count + window - 1)


def collapsed(mh: np.ndarray, ch: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, other, offsets): of equal segments the first in order of document and start, and the others, those of first[i] from offsets[i] on.

    A document that is there twice, as identical rows, counts once.
    """
    order = np.lexsort((at, doc, ch, mh))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (mh[a] == mh[b]) & (ch[a] == ch[b])
    twice = same.copy()
    twice[1:] &= (doc[a] == doc[b]) & (at[a] == at[b])
    order, same = order[~twice], same[~twice]
    heads = np.flatnonzero(~same)
    return order[heads], order[same], np.append(heads - np.arange(len(heads)), same.sum())


def _find(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                each = [t.split() for t in raw(part.column("text"))]
                lengths = np.fromiter(map(len, each), np.int64, len(each))
                of, at, count, mh, ch = segments([w for x in each for w in x], lengths, window, gram)
                doc, at = part.column("doc").to_numpy(zero_copy_only=False)[of], at.astype(np.int32)
                first, other, offsets = collapsed(mh, ch, doc, at)
                places = pa.StructArray.from_arrays([pa.array(doc[other], pa.int64()), pa.array(at[other])], fields=list(PLACE))
                others = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places)
                yield pa.RecordBatch.from_arrays([pa.array(mh[first].view(np.int64)), pa.array(ch[first].view(np.int64)), pa.array(doc[first], pa.int64()), pa.array(at[first]), pa.array(count[first].astype(np.int32)), others], ["mh", "ch", "doc", "at", "n", "others"])
        tidy()

    return run


def second_hash(words: bytes) -> int:
    return xxhash.xxh3_64_intdigest(words) - (1 << 63)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _cut_out(window: int):
    """The parts that are each document's wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = []
                for text, doc, wanted in zip(raw(part.column("text")), part.column("doc").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    words = text.split()
                    rows += [(w["mh"], w["mh"], w["ch"], 0, w["times"] > 1, doc, w["at"], w["n"], w["times"], b" ".join(words[w["at"] : w["at"] + w["n"] + window - 1]), None) for w in wanted]
                yield _batch(rows, PART)

    return run


def _cut_again(window: int, gram: int):
    """Parts cut by the minimizers of longer runs of words; their keys are those of the parts they come from, mixed with the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words", SLICE):
                each = [w.split() for w in raw(part.column("words"))]
                of, at, count, key, _ = segments([w for x in each for w in x], np.fromiter(map(len, each), np.int64, len(each)), window, gram)
                old = part.to_pylist()
                rows = []
                for i, a, n, k in zip(of.tolist(), at.tolist(), count.tolist(), key.view(np.int64).tolist(), strict=True):
                    r, words = old[i], b" ".join(each[i][a : a + n + window - 1])
                    rows.append((k ^ r["key"], r["mh"], r["ch"], r["off"] + a, r["more"], r["doc"], r["at"] + a, n, r["times"], words, second_hash(words)))
                yield _batch(rows, PART)

    return run


def runs_of(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, window, how many) of each run of set flags, counts giving how many windows each part has."""
    part = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (part[at[1:]] != part[at[:-1]])))
    heads = np.flatnonzero(new)
    return part[at[heads]], offset[at[heads]], np.diff(np.append(heads, len(at)))


def reported(counts: np.ndarray, times: np.ndarray, words: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of these parts, in order: whether its occurrences are two places or more, and whether the first of them is elsewhere.

    Parts are in order of document and start; times: how many places each stands for.
    """
    ids: dict[bytes, int] = {}
    text: list[int] = []
    starts = np.zeros(len(words), np.int64)
    for i, each in enumerate(words):
        starts[i] = len(text)
        text += [ids.setdefault(w, len(ids) + 1) for w in each]
        text.append(0)
    index = FMIndex(np.array(text, np.int64), window)
    low, high = index.stream(starts, counts)
    weight = np.repeat(times, np.diff(np.append(starts, len(text))))
    places = np.concatenate(([0], np.cumsum(weight[index.positions])))
    own = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(len(low))
    return places[high] - places[low] > 1, index.positions[low] != own


def _shard(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        table = pa.Table.from_batches(full).sort_by([("doc", "ascending"), ("at", "ascending")])
        counts, times = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "times"))
        joined = table.column("words").to_pylist()
        found, elsewhere = reported(counts, times, [w.split() for w in joined], window)
        rest = table.select(["mh", "ch", "off", "more", "doc", "at"]).to_pylist()
        rows = []
        for i, a, n in zip(*(x.tolist() for x in runs_of(found & elsewhere, counts)), strict=True):
            rows.append((rest[i]["doc"], rest[i]["at"] + a, n, None, None, None, None))
        for i, a, n in zip(*(x.tolist() for x in runs_of(found, counts)), strict=True):
            r = rest[i]
            if r["more"]:
                words = joined[i].split()[a : a + n + window - 1]
                rows.append((r["doc"], r["at"] - r["off"], n, r["mh"], r["ch"], r["off"] + a, second_hash(b" ".join(words))))
        yield _batch(rows, REPORT)
        tidy()

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with a number in column __doc that orders documents; equal for identical rows only."""
    df = docs.withColumn("__doc", F.col(id_col).cast("long"))
    if not df.groupBy("__doc").agg(F.count("*").alias("k")).where("k > 1 or __doc is null").limit(1).count():
        return df
    own = docs.withColumns({"__i": F.col(id_col).cast("long"), "__h": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    # after a sort by ranges, these numbers grow from partition to partition and within each
    numbers = cut(own.select("__i", "__h").distinct().orderBy(F.col("__i").asc_nulls_last(), "__h").select(F.col("__i").alias("__ni"), F.col("__h").alias("__nh"), F.monotonically_increasing_id().alias("__doc")))
    return own.join(numbers, F.col("__i").eqNullSafe(F.col("__ni")) & (F.col("__h") == F.col("__nh"))).drop("__i", "__h", "__ni", "__nh")


def _indexed(parts: DataFrame, window: int, in_shard: int) -> DataFrame:
    shards = max(partitions(parts.sparkSession), -(-parts.count() // in_shard))
    return cut(parts.repartition(shards, "key").select([c for c in parts.columns if c != "key"]).mapInArrow(_shard(window), REPORT))


def repeats(docs: DataFrame, window: int = 20, gram: int = 6, most: int = 5000, in_shard: int = 20_000) -> DataFrame:
    """(doc, at, n, hash): n windows from word `at` on are repeated, if their words have that hash (null: in any case); docs has columns doc and text."""
    texts = docs.select("doc", F.col("text").cast("string").alias("text"))
    found = cut(texts.mapInArrow(_find(window, gram), "mh long, ch long, doc long, at int, n int, others array<struct<doc:long,at:int>>"))
    times = F.sum(1 + F.size("others").cast("long")).alias("times")
    shared = cut(found.join(found.groupBy("mh").agg(times).where("times > 1").select("mh").hint("shuffle_hash"), "mh"))
    drop(found)
    place = F.struct("doc", "at")
    firsts = shared.groupBy("mh", "ch").agg(F.min(place).alias("first"), F.max("n").alias("n"), times)
    wanted = firsts.groupBy("first.doc").agg(F.collect_list(F.struct("mh", "ch", "first.at", "n", "times")).alias("wanted"))
    parts = cut(texts.join(wanted, "doc").mapInArrow(_cut_out(window), PART))
    reports = []
    for longer in sorted({(gram + window) // 2, window} - {gram}):
        heavy = cut(parts.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > most).select("key"))
        if not heavy.limit(1).count():
            break
        reports.append(_indexed(parts.join(heavy, "key", "left_anti"), window, in_shard))
        again = cut(parts.join(heavy, "key", "left_semi").mapInArrow(_cut_again(window, longer), PART))
        drop(parts, heavy)
        # parts that are equal now: the first stands for all, at the others' first places too
        one = F.struct("mh", "ch", "off", "more", "n", "hash")
        same = again.groupBy("key", "words").agg(F.min(place).alias("first"), F.min_by(one, place).alias("one"), F.sum("times").alias("times"))
        parts = cut(same.select("key", "one.mh", "one.ch", "one.off", "one.more", "first.doc", "first.at", "one.n", "times", "words", "one.hash"))
        rest = again.join(same.select("key", "words", "first"), ["key", "words"]).where(place > F.col("first"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("mh", "long"), ("ch", "long"), ("off", "int"), ("hash", "long"))]
        reports.append(cut(rest.select("doc", "at", "n", *none).unionByName(rest.where("more").select("doc", (F.col("at") - F.col("off")).alias("at"), "n", "mh", "ch", "off", "hash"))))
        drop(again)
    reports.append(_indexed(parts, window, in_shard))
    drop(parts)
    made = reports[0]
    for r in reports[1:]:
        made = made.unionByName(r)
    # at a part's first place; and at its other places, which its segment's rows hold
    first = made.where("mh is null").select("doc", "at", "n", "hash")
    whole = made.where("mh is not null").select("mh", "ch", F.struct("doc", "at").alias("first"), "off", F.col("n").alias("k"), "hash")
    places = F.concat(F.array(place), F.col("others"))
    copies = shared.select("mh", "ch", places.alias("places")).join(whole, ["mh", "ch"]).select("first", "off", "k", "hash", F.explode("places").alias("p")).where(F.col("p") > F.col("first"))
    out = cut(first.unionByName(copies.select("p.doc", (F.col("p.at") + F.col("off")).alias("at"), F.col("k").alias("n"), "hash")))
    drop(shared, *reports)
    return out


def kept(words: list[bytes], runs: list[dict] | None, window: int) -> list[bytes]:
    """The words that no repeated window covers."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        a, b = r["at"], min(len(words), r["at"] + r["n"] + window - 1)
        if r["hash"] is None or second_hash(b" ".join(words[a:b])) == r["hash"]:
            change[a] += 1
            change[b] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """docs with n_words, n_removed and kept, the text of the words that stay, joined by one space.

    Columns of docs with these names are replaced.
    """
    docs = docs.drop(*{"n_words", "n_removed", "kept"} - {id_col, text_col}).withColumn(text_col, F.col(text_col).cast("string"))
    rows = _numbered(docs, id_col, text_col)
    runs = repeats(rows.select(F.col("__doc").alias("doc"), F.col(text_col).alias("text")), window)
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "hash")).alias("__runs")).withColumnRenamed("doc", "__doc")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                n, gone, text = [], [], []
                for t, r in zip(raw(part.column(text_col)), part.column("__runs").to_pylist(), strict=True):
                    words = t.split()
                    stay = kept(words, r, window)
                    n.append(len(words))
                    gone.append(len(words) - len(stay))
                    text.append(b" ".join(stay))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])
        tidy()

    schema = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")}).schema
    return rows.join(runs, "__doc", "left").select(*names, "__runs").mapInArrow(run, schema)
