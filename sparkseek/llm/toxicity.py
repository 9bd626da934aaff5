"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Model: grades 0 to `grades`; P(grade >= k) = logistic(w . x - c_k) with one weight vector w for all thresholds
c_1 < c_2 < ... (proportional odds). x: one entry for each hashed lower-case word of the text and for each prefix
of four to six characters (words inflect), one plus the logarithm of its count, times the fourth power of the share of sampled texts
that don't have it (what all texts have tells little); a document's severity is its expected grade, the sum of P(grade >= k) over k.

The labels are binary, and no table holds severities, so the grades of the training rows are a proxy, not a measure of harm: clean
rows are grade 0, and toxic rows are cut into `grades` parts of about equal size by how surely a model of the other half of the
sample, which hasn't seen them, calls them toxic. Every feature that the sample has takes part; a ridge keeps rare ones small.

The likelihood is maximised over at most `sample` labelled ids (those with the least CRC-32 of salted id, of
several rows with one id the text with the smallest hash). Toxic rows make up half of the sample at most; each row's
likelihood is weighted by its kind's share of all labels over its share of the sample, so that the thresholds, and with them the probabilities,
are those of the labels and not of the sample. Thresholds are kept apart by exponents.

Null texts are empty and get the score of no words; without labels of both kinds every severity is 0. Repeated rows
get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import labelled, raw, slices

PREFIXES = (4, 5, 6, 64)  # characters; the last takes whole words, but for the very longest
RANGE = 1 << 17  # buckets for each prefix length
BUCKETS = len(PREFIXES) * RANGE
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CLEAR = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text's words and their prefixes."""
    words: dict[str, int] = {}
    for w in str(text.translate(_CLEAR), "utf-8", "replace").split(" "):
        words[w] = words.get(w, 0) + 1
    words.pop("", None)
    at, count = [], []
    for i, most in enumerate(PREFIXES):
        seen: dict[str, int] = {}
        for w, n in words.items():
            if len(w) >= most or i == len(PREFIXES) - 1:
                k = w[:most]
                seen[k] = seen.get(k, 0) + n
        at += [i * RANGE + xxhash.xxh32_intdigest(k) % RANGE for k in seen]
        count += seen.values()
    return np.array(at, np.int64), 1 + np.log(np.array(count, np.float64))


class Model:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights.astype(np.float32), cuts

    def at_least(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(grade >= k) for each row and k = 1.. ."""
        z = np.array([float(self.weights[at] @ w) for at, w in rows])
        return _logistic(z[:, None] - self.cuts[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Sample:
    """Rows of (buckets, weights) as one list of entries, sorted by row."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.used, self.at = np.unique(np.concatenate([at for at, _ in rows]), return_inverse=True)
        self.value = np.concatenate([w for _, w in rows]).astype(np.float64)
        self.size = np.array([len(at) for at, _ in rows])
        self.owner = np.repeat(np.arange(len(rows)), self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at] * self.value, minlength=len(self.size))

    def back(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, by_row[self.owner] * self.value, minlength=len(self.used))


def cuts_of(gaps: np.ndarray) -> np.ndarray:
    return gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))


def likelihood(sample: Sample, grade: np.ndarray, weight: np.ndarray, theta: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The penalised mean log-likelihood of the grades, and its gradient; theta: weights, first threshold, logarithms of the gaps."""
    n = len(sample.used)
    w, gaps = theta[:n], theta[n:]
    grades, rows = len(gaps), np.arange(len(grade))
    p = _logistic(sample.dot(w)[:, None] - cuts_of(gaps))
    p = np.concatenate((np.ones((len(grade), 1)), p, np.zeros((len(grade), 1))), axis=1)
    a, b = p[rows, grade], p[rows, grade + 1]  # the probability of a grade is the difference of its neighbouring thresholds'
    mass, share = np.maximum(a - b, 1e-12), weight / weight.sum()
    da, db = share * a * (1 - a) / mass, share * b * (1 - b) / mass
    dcut = np.bincount(grade, -da, minlength=grades + 1)[1:] + np.bincount(grade + 1, db, minlength=grades + 2)[1 : grades + 1]
    tail = np.cumsum(dcut[::-1])[::-1]
    grad = np.concatenate((sample.back(da - db) - ridge * w, tail[:1], tail[1:] * np.exp(gaps[1:])))
    return float(share @ np.log(mass)) - ridge / 2 * float(w @ w), grad


def ascend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, keep: int = 8) -> np.ndarray:
    """The greatest value's place of a smooth function with its gradient: limited-memory quasi-Newton steps, halved until they help."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, back = grad.copy(), []
        for s, y, r in reversed(past):
            back.append(r * (s @ way))
            way -= back[-1] * y
        if past:
            s, y, r = past[-1]
            way *= 1 / (r * (y @ y))
        for (s, y, r), c in zip(past, reversed(back), strict=True):
            way += (c - r * (y @ way)) * s
        slope, size = grad @ way, 1.0 if past else 1 / max(1.0, np.abs(grad).sum())
        while size > 1e-10:
            there = x + size * way
            after, turned = f(there)
            if after >= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = there - x, grad - turned
        gain, x, value, grad = after - value, there, after, turned
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-keep:]
        if gain < 1e-7:
            break
    return x


def solve(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, weight: np.ndarray, grades: int, steps: int, ridge: float) -> Model:
    """The weights and thresholds of greatest penalised likelihood."""
    sample = Sample(rows)
    theta = np.zeros(len(sample.used) + grades)
    theta[len(sample.used)] = 2.0
    theta = ascend(lambda x: likelihood(sample, grade, weight, x, ridge), theta, steps)
    weights = np.zeros(BUCKETS)
    weights[sample.used] = theta[: len(sample.used)]
    return Model(weights, cuts_of(theta[len(sample.used) :]))


def graded(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weight: np.ndarray, grades: int, steps: int, ridge: float) -> np.ndarray:
    """Grades of the rows: 0 if clean, else by how surely a model of the other half calls them toxic."""
    sure, half = np.zeros(len(rows)), np.arange(len(rows)) % 2 == 0
    for own in (half, ~half):
        other = np.flatnonzero(~own)
        if own.any() and toxic[other].any() and not toxic[other].all():
            model = solve([rows[i] for i in other], toxic[other].astype(int), weight[other], 1, steps, ridge)
            sure[own] = [float(model.weights[at] @ w) - model.cuts[0] for at, w in (rows[i] for i in np.flatnonzero(own))]
    bounds = np.quantile(sure[toxic], [k / grades for k in range(1, grades)])
    return np.where(toxic, 1 + np.searchsorted(bounds, sure, "left"), 0)


def labels_of(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Features, kind and weight of at most `sample` labelled ids."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z and y in (0, 1)").select("id", "y")
    order = [F.crc32(F.concat(F.lit("sample"), F.col("id").cast("string"))), "id"]
    chosen = known.where("y = 1").orderBy(*order).limit(sample // 2).unionByName(known.where("y = 0").orderBy(*order).limit(sample // 2))
    every = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [features(t) for t in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([t.astype(np.int32).tobytes() for t, _ in found], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in found], pa.binary())], ["id", "y", "terms", "weights"])

    got = labelled(docs, chosen, id_col, text_col).mapInArrow(run, "id long, y int, terms binary, weights binary").collect()  # at most `sample` rows
    got = sorted(got, key=lambda r: r["id"])
    rows = [(np.frombuffer(r["terms"], np.int32).astype(np.int64), np.frombuffer(r["weights"], np.float32).astype(np.float64)) for r in got]
    toxic = np.array([r["y"] for r in got], bool)
    seen = np.bincount(toxic.astype(int), minlength=2)
    weight = np.array([every.get(y, 0) / max(1, seen[y]) for y in (0, 1)])[toxic.astype(int)]
    return rows, toxic, weight


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, grades: int = 3, steps: int = 60, ridge: float = 1e-4) -> Model:
    """A model of at most `sample` labelled documents; half of the sample at most are toxic rows."""
    rows, toxic, weight = labels_of(docs, labels, label, id_col, text_col, sample)
    if not len(rows) or toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS), np.full(grades, 60.0))
    rare = (1 - np.bincount(np.concatenate([at for at, _ in rows]), minlength=BUCKETS) / len(rows)) ** 4
    rows = [(at, w * rare[at]) for at, w in rows]
    made = solve(rows, graded(rows, toxic, weight, grades, steps, ridge), weight, grades, steps, ridge)
    return Model(made.weights * rare, made.cuts)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, p_toxic, grade, toxic) of every row.

    severity is the expected grade, p_toxic the probability of grade 1 or more, grade the largest one
    reached with probability 1/2, toxic whether that is 1 at least.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = shared.value.at_least([features(t) for t in raw(part.column("text"))])
                grade = (p >= 0.5).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array(grade.astype(np.int32)), pa.array(grade >= 1)], ["id", "severity", "p_toxic", "grade", "toxic"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)
