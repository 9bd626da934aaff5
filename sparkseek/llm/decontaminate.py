"""Benchmark decontamination by a prefix-filtered set join.

Words: A-Z lower-cased, runs of ASCII letters and digits and of all characters beyond ASCII. An item's
windows are its runs of `window` words (an item with fewer words, but not none, is one window). A word of a document is
hit if it lies in an occurrence of any window.

Join: a window's tokens are its shingles of `SHINGLE` words (of a shorter window: all its words). A window occurs only where each
of its shingles does, so one necessary shingle, its prefix, decides where to look: the rarest by the number of its
occurrences in all documents, the leftmost of equals. Documents' shingles meet the prefixes; of a prefix that is met, each place in
a window that any window has it at (six for eight words) leaves room for that window before and after or not (positional and length bounds), and where it
does the words there are looked up among the windows, whole. So an occurrence costs a few look-ups, however many windows share its prefix.
The index is cut into blocks of at most `block` words of windows, whatever items they are from, each of which is
broadcast and meets all documents, so what is broadcast is bounded whatever the benchmark's size.

Null texts have no words; null item ids are ignored; items that repeat count once for each different id. Repeated
documents get equal results; empty tables work; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Container, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import raw, slices

#: A-Z to lower case; all other ASCII but letters and digits to spaces
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = "array<struct<a:int,b:int>>"
SHINGLE = 3
Window = tuple[bytes, ...]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def windows_of(words: list[bytes], window: int) -> Iterator[Window]:
    return (tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))) if words else iter(())


def shingles_of(window: Window) -> list[bytes]:
    n = min(SHINGLE, len(window))
    return [b" ".join(window[i : i + n]) for i in range(len(window) - n + 1)]


def heads_of(shingles: Iterable[bytes]) -> dict[bytes, list[int]]:
    """First word: the numbers of words that shingles which begin with it have."""
    heads: dict[bytes, set[int]] = {}
    for s in shingles:
        heads.setdefault(s.split(b" ", 1)[0], set()).add(s.count(b" ") + 1)
    return {w: sorted(n) for w, n in heads.items()}


def met(words: list[bytes], heads: dict[bytes, list[int]], known: Container[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, shingle) of each known shingle in the words."""
    for at, w in enumerate(words):
        if w in heads:
            for n in heads[w]:
                s = b" ".join(words[at : at + n])
                if s in known:
                    yield at, s


def _counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences in all documents of each shingle of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast((heads_of(vocabulary), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (heads, known), count = shared.value, {}
        for batch in batches:
            for part in slices(batch, "text"):
                for text in raw(part.column("text")):
                    for _, s in met(words_of(text), heads, known):
                        count[s] = count.get(s, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["shingle", "n"])

    rows = docs.select(F.col("text")).mapInArrow(run, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()  # at most the block's vocabulary
    return {bytes(r["shingle"]): r["n"] for r in rows}


class Index:
    """windows: items' numbers by window; prefixes: the (place, words) that windows with a prefix have it at and have; heads of the prefixes."""

    def __init__(self, windows: dict[Window, list[int]], counts: dict[bytes, int]):
        self.windows = {b" ".join(w): items for w, items in windows.items()}
        found: dict[bytes, set[tuple[int, int]]] = {}
        for w in windows:
            shingles = shingles_of(w)
            place = min(range(len(shingles)), key=lambda i: (counts.get(shingles[i], 0), i))
            found.setdefault(shingles[place], set()).add((place, len(w)))
        self.prefixes = {s: sorted(shapes) for s, shapes in found.items()}
        self.heads = heads_of(self.prefixes)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, end) of each occurrence of a window in the words, and the numbers of the items that have any."""
        spans, items = [], set()
        for at, s in met(words, self.heads, self.prefixes):
            for place, n in self.prefixes[s]:
                start, end = at - place, at - place + n
                if start >= 0 and end <= len(words):
                    owners = self.windows.get(b" ".join(words[start:end]))
                    if owners is not None:
                        spans.append((start, end))
                        items.update(owners)
        return spans, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block: int) -> Iterator[tuple[dict[Window, list[int]], list[str]]]:
    """Windows of `block` words in all at most, with the names of their items; an item may go on in the next block."""
    windows: dict[Window, list[int]] = {}
    names: list[str] = []
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).dropna(subset=["i"]).distinct().orderBy("i", "t").toLocalIterator():
        owner = -1
        for w in windows_of(words_of((row["t"] or "").encode()), window):
            if windows and (len(windows) + 1) * window > block:
                yield windows, names
                windows, names, owner = {}, [], -1
            if owner < 0:
                owner = len(names)
                names.append(row["i"])
            windows.setdefault(w, []).append(owner)
    if windows:
        yield windows, names


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, block: int = 2_000_000) -> DataFrame:
    """docs with spans, the word intervals of all occurrences, and items, the items' ids as sorted text.

    Columns of docs with these names are replaced.
    Documents aren't shuffled: each block's index passes through the scan, and its results are added to the row.
    """
    kept = docs.drop(*{"spans", "items"} - {id_col, text_col}).withColumn(text_col, F.col(text_col).cast("string"))
    names = kept.columns
    rows = kept.withColumns({"spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    schema = rows.schema
    for windows, owners in _blocks(benchmark, item_col, item_text_col, window, block):
        counts = _counts(docs.select(F.col(text_col).cast("string").alias("text")), {s for w in windows for s in shingles_of(w)})
        shared = docs.sparkSession.sparkContext.broadcast((Index(windows, counts), owners))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, owners = shared.value
            for batch in batches:
                for part in slices(batch, text_col):
                    spans, items = [], []
                    for text, s, i in zip(raw(part.column(text_col)), part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True):
                        got, found = index.search(words_of(text))
                        spans.append(s + [{"a": a, "b": b} for a, b in got])
                        items.append(sorted({*i, *(owners[o] for o in found)}))
                    yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))], [*names, "spans", "items"])

        rows = rows.mapInArrow(run, schema)
    return rows


def hits(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256) of the rows of `matches`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                total, hit, many, digest = [], [], [], []
                for text, spans, items in zip(raw(part.column("text")), part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True):
                    n = len(words_of(text))
                    total.append(n)
                    hit.append(sum(b - a for a, b in merged(spans)))
                    many.append(len(items))
                    digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(many, pa.int64()), pa.array(digest, pa.string())], ["id", "n_words", "n_hit", "n_items", "items_sha256"])

    rows = found.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "spans", "items")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string").withColumnRenamed("id", id_col)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """The union of word intervals, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without_hits(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `matches` with what lies between the first and last word of each hit run cut from their texts."""
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = []
                for text, spans in zip(part.column(text_col).cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), strict=True):
                    if spans:
                        places, at, left = [m.span() for m in _WORD.finditer(text)], 0, []
                        for a, b in merged(spans):
                            left.append(text[at : places[a][0]])
                            at = places[b - 1][1]
                        text = b"".join([*left, text[at:]])
                    texts.append(text)
                text = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([text if n == text_col else part.column(n) for n in names], names)

    return found.mapInArrow(run, found.schema)
