"""The ten operators against brute force, on small fixtures that hold the awkward cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from sparkseek.llm import bpe, decontaminate, fingerprints, fmindex, html_text, quality, queries, sharding, simhash, substring, toxicity, warc

WORDS = [f"w{i}" for i in range(40)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose("passage", 45)
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
#: null and empty texts, blanks, one word, repeated words, copies, shared passages, repeated rows, null ids, long texts, odd spaces
TEXTS = [
    (0, PASSAGE + "\n" + prose(1, 60)),
    (1, prose(2, 80) + " " + PASSAGE),
    (2, None),
    (3, ""),
    (4, " \n\t \n"),
    (5, "One"),
    (6, "Orre " * 500),
    (7, PASSAGE + "\n" + prose(1, 60)),
    (8, "x y z " + prose(3, 30) + "\x0b\x0c" + ITEM + " " + ITEM.upper()),
    (9, prose(4, 30_000)),
    (10, "é🙂" * 3000),
    (11, prose(5, 25) + " Alpha, beta; GAMMA delta-epsilon zeta eta theta"),
    (12, PASSAGE + " tail " + PASSAGE),
    (12, PASSAGE + " tail " + PASSAGE),
    (13, prose(6, 100)),
    (13, prose(7, 100)),
    (None, prose(8, 40)),
]
UNIQUE = [(i, t) for n, (i, t) in enumerate(TEXTS) if i is not None and n not in (13, 15)]
EXTRA = "id string, doc long, h string, score string, spans string, items string, kept string, n_words string, n string, at string, u string, v string, p string, word string"


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA.split(", ")]) if extra else df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).repartition(3).cache()


@pytest.fixture(scope="module")
def unique(spark):
    return frame(spark, UNIQUE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- 1


def test_edits(docs, unique, empty):
    got = {r["doc_id"]: r for r in fingerprints.edits(unique).collect()}
    order = sorted(UNIQUE, reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after, r = t or "", after or "", got[i]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (sorted(t.split("\n")) == sorted(edited.split("\n")))
    assert got[0]["fingerprint"] == got[7]["fingerprint"] != got[1]["fingerprint"]
    assert got[2]["fingerprint"] == got[3]["fingerprint"]
    assert fingerprints.edits(docs).count() == len(TEXTS)
    assert fingerprints.edits(empty).count() == 0


def test_edits_of_many_ranges(spark):
    texts = [(i * 7, prose(i, 1 + i % 50)) for i in range(300)]
    got = {r["doc_id"]: r for r in fingerprints.edits(frame(spark, texts, False), per_partition=10).collect()}
    order = sorted(texts, reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    assert np.mean([r["near_edited"] - r["near_next"] for r in got.values()]) > 0.25


@pytest.mark.parametrize("ids", [[None] * 200, [5] * 150 + list(range(50)), [None] * 100 + [3] * 100 + [None, 3, 9]])
def test_edits_of_a_hot_id(spark, ids):
    texts = [(i, prose(n, 1 + n % 40) + f" {n}") for n, i in enumerate(ids)]
    key = lambda x: (x[0] is None, -(x[0] or 0), xxhash64_of[x[1]], x[1])
    df = frame(spark, texts, False).repartition(4)
    xxhash64_of = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(texts, key=key)
    expect = [(i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()) for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)]
    got = fingerprints.edits(df, per_partition=5)
    assert rows(got.select("doc_id", "n_chars", "edited_sha256")) == sorted(expect, key=repr)


def test_lanes_wrap_by_themselves(spark):
    got = {r["doc_id"]: r["vector"] for r in fingerprints.fingerprint(frame(spark, [(1, "a b c"), (2, "d e f g"), (3, "a b c\nd e f g")], False)).collect()}
    df = spark.createDataFrame([(got[1], got[2], got[3])], "a array<long>, b array<long>, c array<long>")
    away = fingerprints.combine(F.col("a"), F.col("c"), -1)  # paragraphs that aren't there are taken away first
    assert df.select(fingerprints.combine(away, F.col("c")).alias("x")).first()["x"] == got[1]
    assert df.select(fingerprints.combine(fingerprints.combine(F.col("c"), F.col("b"), -1), F.col("a"), -1).alias("x")).first()["x"] == [0] * len(got[1])


def test_fingerprints_add_up(spark):
    a, b = "one two three four\nfive six", "seven\neight nine ten eleven"
    got = {r["doc_id"]: r["vector"] for r in fingerprints.fingerprint(frame(spark, [(1, a), (2, b), (3, b + "\n" + a)], False)).collect()}
    df = spark.createDataFrame([(got[1], got[2], got[3])], "a array<long>, b array<long>, c array<long>")
    r = df.select(fingerprints.combine(F.col("a"), F.col("b")).alias("sum"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("rest")).first()
    assert r["sum"] == got[3] and r["rest"] == got[1]


# --- 2


def brute_fingerprint(text):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fp"] % (1 << 64)) for r in got) == sorted((i is None, i, f) for i, f in prints)
    for r in got:
        reach, grown = {r["fp"] % (1 << 64)}, True
        while grown:
            more = {f for _, f in prints if any((f ^ g).bit_count() <= 2 for g in reach)}
            grown, reach = more != reach, more
        assert r["component_id"] == min((i for i, f in prints if f in reach and i is not None), default=None)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("distance", [0, 2, 4])
def test_links_connect_all_near_prints(spark, distance):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(30)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centres for _ in range(25)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from sparkseek.llm.components import components

    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, distance + 3)
    root = {x["u"]: x["root"] for x in components(edges).collect()}
    parent = {f: f for f in signed}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in signed:
        for b in signed:
            if ((a ^ b) % (1 << 64)).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {f: root.get(f, f) for f in signed} == {f: find(f) for f in signed}


# --- 3


def test_toxicity(spark, docs, empty):
    r = random.Random(1)
    texts = [(i, prose(i, 60) + (" " + " ".join(r.choice(["vileness", "vilest", "rotten"]) for _ in range(1 + i % 4)) if i % 3 == 0 else "")) for i in range(400)]
    known = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(300)])
    df = frame(spark, texts, False)
    model = toxicity.fit(df, known)
    assert list(model.cuts) == sorted(model.cuts)
    got = {x["doc_id"]: x for x in toxicity.severity(df.unionByName(df), model).collect()}
    assert sorted(got.values()) == sorted(set(toxicity.severity(df, model).collect()))  # repeated rows agree
    assert all(got[i]["toxic"] == (i % 3 == 0) for i in range(300, 400))
    assert all(0 <= x["severity"] <= 3 for x in got.values())
    assert toxicity.severity(docs, model).count() == len(TEXTS)
    assert toxicity.severity(empty, model).count() == 0
    nothing = toxicity.fit(df, labels(spark, [(1, None, None)]))
    assert not any(x["toxic"] for x in toxicity.severity(df, nothing).collect())


def test_likelihood_against_brute_force():
    r = np.random.default_rng(3)
    data = [(np.unique(r.integers(0, 12, 6)), None) for _ in range(40)]
    data = [(at, r.random(len(at)) + 0.5) for at, _ in data]
    grade, weight = r.integers(0, 4, 40), r.random(40) + 0.1
    sample = toxicity.Sample(data)
    theta = r.normal(size=len(sample.used) + 3)
    value, grad = toxicity.likelihood(sample, grade, weight, theta, 0.01)
    w, cuts = dict(zip(sample.used.tolist(), theta, strict=False)), toxicity.cuts_of(theta[-3:])
    expect = 0.0
    for (at, v), g, m in zip(data, grade, weight, strict=True):
        z = sum(w[a] * x for a, x in zip(at.tolist(), v, strict=True))
        reach = [1.0, *[1 / (1 + np.exp(c - z)) for c in cuts], 0.0]
        expect += m * np.log(reach[g] - reach[g + 1]) / weight.sum()
    assert value == pytest.approx(expect - 0.005 * sum(x * x for x in w.values()))
    for i in range(len(theta)):
        step = np.eye(len(theta))[i] * 1e-6
        slope = (toxicity.likelihood(sample, grade, weight, theta + step, 0.01)[0] - toxicity.likelihood(sample, grade, weight, theta - step, 0.01)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-6)


# --- 4


@pytest.mark.parametrize("limit", [1, 100, 2000, 10**9])
def test_sharding(docs, limit):
    got = sharding.shards(docs, limit).collect()
    assert len(got) == len(TEXTS) and sum(r["bytes"] for r in got) == sum(len((t or "").encode()) for _, t in TEXTS)
    size, ids = {}, {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["bytes"]
        ids.setdefault(r["shard"], set()).add(r["doc_id"])
    for r in got:
        assert r["depth"] == len(r["shard"]) and r["shard_bytes"] == size[r["shard"]]
        assert r["oversized"] == (size[r["shard"]] > limit) and (not r["oversized"] or len(ids[r["shard"]]) == 1)
    names = sorted(size)
    assert not any(b.startswith(a) for a in names for b in names if a != b)


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = frame(spark, TEXTS, False)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 2000)
    got = spark.read.parquet(f"file://{tmp_path}/shards")
    assert rows(got.select("doc_id", "text")) == rows(docs)


def test_no_shards(empty):
    assert sharding.shards(empty, 10).count() == 0


# --- 5


def brute_repeats(texts, window):
    seen, out = {}, []
    for i, t in texts:
        w = words(t)
        for a in range(len(w) - window + 1):
            seen.setdefault(tuple(w[a : a + window]), []).append((i, a))
    for i, t in texts:
        w, gone = words(t), set()
        for a in range(len(w) - window + 1):
            if min(seen[tuple(w[a : a + window])]) < (i, a):
                gone.update(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("most", [0, 2, 5000])
def test_substring(spark, unique, monkeypatch, most):
    inner = substring.repeats
    monkeypatch.setattr(substring, "repeats", lambda d, w: inner(d, w, most=most))
    assert sorted(tuple(r) for r in substring.dedup(unique).select("doc_id", "n_words", "n_removed", "kept").collect()) == sorted(brute_repeats(UNIQUE, 20))
    r = random.Random(3)
    few = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(120)]
    assert sorted(tuple(x) for x in substring.dedup(frame(spark, few, False), window=7).select("doc_id", "n_words", "n_removed", "kept").collect()) == sorted(brute_repeats(few, 7))


@pytest.mark.parametrize("text", ["x " * 25, "x " * 400, "a b c " * 30, " ".join(f"w{i}" for i in range(30)) + " x" * 60, "a b c d e f g " * 9 + "x " * 22])
def test_substring_of_words_that_recur_in_one_document_only(spark, text):
    rows = [(1, text)]
    assert [tuple(x) for x in substring.dedup(frame(spark, rows, False)).select("doc_id", "n_words", "n_removed", "kept").collect()] == brute_repeats(rows, 20)


def test_equal_segments_of_a_slice():
    mh, ch = np.array([5, 5, 5, 5, 7], np.uint64), np.array([1, 1, 1, 2, 1], np.uint64)
    first, other, offsets = substring.collapsed(mh, ch, np.array([4, 3, 3, 1, 1]), np.array([0, 2, 1, 0, 0]))
    assert [(f, other[a:b].tolist()) for f, a, b in zip(first.tolist(), offsets, offsets[1:])] == [(2, [1, 0]), (3, []), (4, [])]
    first, other, offsets = substring.collapsed(mh[:3], ch[:3], np.array([3, 3, 4]), np.array([1, 1, 0]))
    assert len(first) == 1 and other.tolist() == [2] and offsets.tolist() == [0, 1]
    assert substring.collapsed(mh[:0], ch[:0], np.zeros(0, int), np.zeros(0, int))[2].tolist() == [0]


def test_substring_is_what_the_index_reports(unique, monkeypatch):
    monkeypatch.setattr(substring, "_shard", lambda window: lambda batches: (substring._batch([], substring.REPORT) for b in batches))
    assert substring.dedup(unique).where("n_removed > 0").count() == 0


def test_a_copy_is_compared_before_it_goes():
    same = substring.second_hash(b"a b c")
    assert substring.kept([b"a", b"b", b"c", b"d"], [{"at": 0, "n": 1, "hash": same}], 3) == [b"d"]
    assert substring.kept([b"a", b"x", b"c", b"d"], [{"at": 0, "n": 1, "hash": same}], 3) == [b"a", b"x", b"c", b"d"]


def test_substring_with_repeated_rows(docs, empty):
    got = substring.dedup(docs).collect()
    assert len(got) == len(TEXTS) and "h" in got[0].asDict()
    twice = [r["kept"] for r in got if r["doc_id"] == 12]
    assert twice[0] == twice[1]
    assert substring.dedup(empty).count() == 0


@pytest.mark.parametrize("depth", [2, 3, 7, 8, 20])
def test_fm_index(depth):
    r = np.random.default_rng(1)
    parts = [r.integers(1, 3, n).tolist() for n in r.integers(depth, depth + 30, 60)]
    text = np.array([x for p in parts for x in [*p, 0]])
    starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))[:-1]
    counts = np.array([len(p) - depth + 1 for p in parts])
    index = fmindex.FMIndex(text, depth)
    low, high = index.stream(starts, counts)
    begin = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, counts, strict=True)])
    where = {}
    for i in begin:
        where.setdefault(tuple(text[i : i + depth]), []).append(i)
    for i, a, b in zip(begin, low, high, strict=True):
        assert index.positions[a:b].tolist() == where[tuple(text[i : i + depth])]


# --- 6


def test_warc(spark, tmp_path):
    big = "<p>" + "y" * 2000
    trap = "WARC/1.0\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    pages = [(1, "u1", big), (2, None, big), (9, "u\r\n9", big), (3, "u", None), (4, "u", ""), (5, "u", "z" * 999), (6, "u", "z" * 999), (7, "u", trap * 50), (8, "u", "WARC/1.0\r\n" + big), (None, "u", big), (10, "u", "é" * 700), (10, "u", "é" * 700)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    for compression in ("gzip", "none"):
        path = f"file://{tmp_path}/{compression}"
        warc.write(df, path, compression=compression)
        got = rows(warc.payloads(warc.read(spark, path)).select("id", "size", "digest", "type", "refers_to"))
        expect = []
        for i, _, h in pages:
            h = (h or "").encode()
            top = max((j for j, _, x in pages if (x or "").encode() == h and j is not None), default=None)
            again = len(h) >= 1000 and i != top
            expect.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top if again else None))
        assert got == sorted(expect, key=repr)
    assert warc.scan(spark, f"file://{tmp_path}/none").count() > len(pages)
    warc.write(df.limit(0), f"file://{tmp_path}/empty")
    assert warc.payloads(warc.read(spark, f"file://{tmp_path}/empty")).count() == 0


def test_reachable():
    at, following = np.array([0, 10, 15, 30, 40]), np.array([10, 30, 40, 50, -1])
    assert warc.reachable(at, following, 50).tolist() == [True, True, False, True, False]
    with pytest.raises(ValueError):
        warc.reachable(at, np.array([10, 30, 40, 44, -1]), 50)


# --- 7


def test_quality(spark, docs, empty):
    texts = [(i, prose(i, 50) if i % 2 else " ".join(w.upper() + "!!" for w in prose(i, 50).split())) for i in range(300)]
    df, known = frame(spark, texts), labels(spark, [(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (7, 0, 0), (301, None, 0)])
    model = quality.fit(df, quality.learnable(known))
    got = quality.with_scores(df, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.with_scores(docs, model).count() == len(TEXTS)
    assert quality.with_scores(empty, model).count() == 0
    assert {r["score"] for r in quality.with_scores(docs, quality.fit(df, labels(spark, []))).collect()} == {0.5}


def test_learned_rows_are_bounded(spark):
    df, known = frame(spark, [(i % 5, prose(i, 20)) for i in range(300)], False), labels(spark, [(i, i % 2, i % 2) for i in range(5)])
    assert len(quality.fit(df, known, sample=4).labels) == 4
    assert toxicity.labels_of(df, known, "toxic", "doc_id", "text", 4)[1].shape == (4,)


def test_equal_texts_score_equally_and_ties_go_to_smaller_ids():
    r = np.random.default_rng(2)
    vectors = np.repeat(r.normal(size=(200, 64)).astype(np.float32), 5, axis=0)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality.Model(np.ones(64, np.float32), np.eye(64, dtype=np.float32), vectors, r.integers(0, 2, 1000).astype(float), 7, 8.0)
    rows_ = [(np.arange(64), r.normal(size=64)) for _ in range(300)]
    whole = model.score(rows_)
    assert [model.score([x])[0] for x in rows_] == whole.tolist() == model.score(rows_[::-1])[::-1].tolist()
    cosines = np.array([[0.5, 0.9, 0.5, 0.5, 0.9, 0.1, 0.5, 0.9, 0.9, 0.5]])
    assert model.nearest(cosines).tolist() == [[0, 1, 2, 3, 4, 7, 8]]


@pytest.mark.parametrize("part", [quality.PART, 100])
def test_all_labels_are_learned_from(spark, monkeypatch, part):
    monkeypatch.setattr(quality, "PART", part)
    r = np.random.default_rng(3)
    signs = list("ab,. A1!|")
    texts = [(i, "".join(r.choice(signs, r.integers(0, 30)))) for i in range(4700)]
    texts += [(i, "ab a1") for i in range(4700, 4760)]
    ys = {i: int(r.integers(0, 2)) for i, _ in texts}
    df = frame(spark, texts, False).repartition(5)
    model = quality.fit(df, labels(spark, [(i, y, 0) for i, y in ys.items()]))
    found = [quality.features(t.encode()) for _, t in texts]
    matrix = np.zeros((len(texts), quality.TERMS))
    for row, (terms, weights) in zip(matrix, found, strict=True):
        row[terms] = weights
    assert model.idf == pytest.approx(np.log((1 + len(texts)) / (1 + (matrix > 0).sum(axis=0))) + 1, rel=1e-6)
    gram = (matrix * model.idf).T @ (matrix * model.idf)
    top = np.linalg.eigvalsh(gram[:, gram.any(axis=0)][gram.any(axis=0)])[-64:].sum()
    assert ((gram @ model.factors) * model.factors).sum() == pytest.approx(top, rel=1e-4)

    vectors = np.stack([model.project(*x) for x in found])
    copies = np.unique(vectors, axis=0, return_counts=True)[1]
    assert len(model.labels) == np.minimum(copies, model.neighbours).sum() > 4000 and copies.max() >= 60
    assert len(model.cells.of) > 50
    every = quality.Model(model.idf, model.factors, vectors, np.array([ys[i] for i, _ in texts]), model.neighbours, model.power)
    got = {x["doc_id"]: x["score"] for x in quality.with_scores(df, model).collect()}
    assert [got[i] for i, _ in texts] == every.score(found).tolist()


def test_a_vector_of_zeros_ties_with_every_row():
    r = np.random.default_rng(1)
    model = quality.Model(np.ones(4, np.float32), np.eye(4, dtype=np.float32), r.normal(size=(30, 4)).astype(np.float32), (np.arange(30) < 3).astype(float), 5, 2.0)
    assert model.score([(np.arange(4), np.zeros(4)), (np.arange(4), r.normal(size=4))])[0] == pytest.approx(0.6)


def test_votes_are_exact():
    r = np.random.default_rng(0)
    vectors = r.normal(size=(50, 4)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality.Model(np.ones(4, np.float32), np.eye(4, dtype=np.float32), vectors, r.integers(0, 2, 50).astype(float), 5, 2.0)
    rows_ = [(np.arange(4), r.normal(size=4)) for _ in range(20)]
    for (_, x), s in zip(rows_, model.score(rows_, block=3), strict=True):
        cosine = vectors @ (x / np.linalg.norm(x))
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 1e-6) ** 2
        assert s == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-4)


# --- 8


@pytest.mark.parametrize("block", [100, 10**6])
def test_decontamination(spark, docs, empty, block):
    items = [("a", ITEM), ("b", "Alpha, beta GAMMA delta epsilon zeta eta theta"), ("c", "w1"), ("d", ""), ("e", None), (None, "w2"), ("a", "w3 w4 w5"), ("f", PASSAGE)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.hits(decontaminate.matches(docs, bench, block=block))
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    expect = []
    for i, t in TEXTS:
        w, hit, names = tokens(t), set(), set()
        for name, x in items:
            if name is None:
                continue
            x = tokens(x)
            for a in range(max(1, len(x) - 7) if x else 0):
                part = x[a : a + 8]
                for b in range(len(w) - len(part) + 1):
                    if w[b : b + len(part)] == part:
                        hit.update(range(b, b + len(part)))
                        names.add(name)
        expect.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    assert rows(found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256")) == sorted(expect, key=repr)
    assert decontaminate.hits(decontaminate.matches(empty, bench)).count() == 0
    assert decontaminate.hits(decontaminate.matches(docs, bench.limit(0))).agg(F.sum("n_hit")).first()[0] == 0


def test_blocks_are_bounded_and_lists_are_not_scanned(spark):
    words_ = [f"w{i}" for i in range(100)]
    bench = spark.createDataFrame([("a", " ".join(words_)), ("b", " ".join(words_[50:]))], "item_id string, text string")
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 8, 80))
    assert all(len(w) <= 10 for w, _ in blocks) and {x for w, names in blocks for x in names} == {"a", "b"}
    windows = {(b"x", b"y", b"z", *(f"{i}{j}".encode() for j in range(5))): [0] for i in range(2000)}
    index = decontaminate.Index(windows, {s: 1 + (s != b"x y z") for w in windows for s in decontaminate.shingles_of(w)})
    assert index.prefixes == {b"x y z": [(0, 8)]}
    assert index.search([b"x", b"y", b"z", *(f"7{j}".encode() for j in range(5)), b"x", b"y", b"z"]) == ([(0, 8)], {0})


def test_hits_are_cut_out(spark):
    bench = spark.createDataFrame([("a", ITEM)], "item_id string, text string")
    df = frame(spark, [(1, "Keep, this. " + ITEM.title().replace(" ", ", ") + "! And that."), (2, "clean"), (3, None)], False)
    got = {r["doc_id"]: r["text"] for r in decontaminate.without_hits(decontaminate.matches(df, bench)).collect()}
    assert got == {1: "Keep, this. ! And that.", 2: "clean", 3: None}


# --- 9

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div id="cookieNotice">Cookies <p>here</div>
<article><header><h2>Head  line</h2><span>By me</span></header><p>First &amp; <b>bold</b>
text&nbsp;goes<br>on.<p>Short.<p><b>Unclosed <i>tags<p>Third &lt;one&gt; &#233;.<script>if (a < b) document.write("<p>no</p>")</script>
<form><p>Your mail</p></form><ul><li>item one<li>item two</ul><div class="ad">Buy</div></article>
<section id="comments"><p>I like it a lot, really a lot, what a long comment this is, longer than all the article.</p></section>
<aside>Side</aside><footer>&copy; Us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ["Head line", "First & bold text goes on.", "Short.", "Unclosed tags", "Third <one> é.", "item one", "item two"]
    long = "".join(f"<p>{prose(i, 20 + i)}</p>" for i in range(20))
    menu = "<ul>" + "".join(f"<li><a href=x>link number {i}</a></li>" for i in range(9)) + "</ul>"
    assert html_text.main_text(f"<div>{menu}</div><div><div>{long}</div></div>") == "\n".join(prose(i, 20 + i) for i in range(20))
    for odd in ("", "<", "<p", "</p>", "<!-- x", "<script>", "a < b", "<p>" * 5000, "<div>" * 5000 + "deep", '<a b="' * 3000, "&#xD800;&#99999999;", "\x00"):
        html_text.main_text(odd)
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_pages_of_any_shape_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        for page in ("<b>" * n + "</i>" * n, "<i><p>" + "<b>" * n + "</i>" * n, "<header>" * n, "<li><b>" * n, "<dl>" * n + "<dt>" * n, "<div>" * n + "</p>" * n, "<p><span>" * n):
            html_text.main_text(page + "text")
        return time.process_time() - began

    took(100)
    assert took(16_000) < 16 * max(0.05, took(2_000))


def test_main_text_without_an_article_is_the_densest_part():
    some = [prose(i, 60) for i in range(8)]
    links = "<div class=left><ul>" + "<li><a href=x>some link</a> and</li>" * 20 + "</ul></div>"
    short = "<div class=top><div><p>Call now</p><p>Open till six</p><p><a href=x>More</a></p></div></div>"
    body = "".join(f"<p>{t}</p>" for t in some)
    for holder in ("div", "section", "td"):
        assert html_text.main_text(f"{short}<{holder}>{body}</{holder}>{links}") == "\n".join(some)


def brute_densest(page):
    """The node of the largest density sum, each measured by a walk of its own."""
    inside = lambda i: [i] if page.dropped[i] else [i, *(k for x in page.parts[i] if isinstance(x, int) for k in inside(x))]
    chars = lambda i: sum(len(" ".join(x.split())) for x in page.parts[i] if isinstance(x, str)) if not page.dropped[i] else 0

    def linked(i):
        return i >= 0 and (page.tags[i] == "a" or linked(page.parents[i]))

    def measure(i):
        nodes = [k for k in inside(i) if not page.dropped[k]]
        return sum(map(chars, nodes)), len([k for k in nodes if k != i]), sum(chars(k) for k in nodes if linked(k)), len([k for k in nodes if k != i and page.tags[k] == "a"])

    c0, _, l0, _ = measure(0)

    def density(i):
        c, t, lc, lt = measure(i)
        if page.dropped[i] or not c:
            return 0.0
        wide = np.log(c / max(1, c - lc) * lc + l0 / max(1, c0) * c + np.e)
        return c / max(1, t) * np.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / max(1.0, np.log(wide))

    each = [density(i) for i in range(len(page.tags))]
    total = [sum(each[x] for x in p if isinstance(x, int)) for p in page.parts]
    return max(range(len(total)), key=lambda i: (round(total[i], 6), -i))


@pytest.mark.parametrize("source", [PAGE, f"<div><p>{prose(1, 30)}</p><p>{prose(2, 50)}</p><div><p>{prose(3, 9)}</p></div></div><ul><li><a>x y</a><li><a>z</a></ul>"])
def test_density_sums_against_brute_force(source):
    page = html_text.Page(source)
    page._settle([False] * len(page.tags))
    assert page._core_of(page._densities()) == brute_densest(page)


def test_references_are_decoded_in_their_own_text():
    assert html_text.main_text(f"<article><p>{prose(1, 30)}</p><p>a&<b>lt;</b>b</p></article>").split("\n")[1] == "a&lt;b"


def test_main_text_of_wrapped_sections():
    some = [prose(i, 30) for i in range(25)]
    links = "<div><ul>" + "<li><a href=x>some link here</a> more</li>" * 30 + "</ul></div>"
    inner = lambda texts: "<section><div>" + "".join(f"<p>{t}</p>" for t in texts) + "</div></section>"
    for page in (inner(some[:5]) + inner(some[5:]), inner(some[:20]) + inner(some[20:]), f"<div><div>{inner(some[:5])}</div></div><div>{inner(some[5:])}</div>"):
        assert html_text.main_text(f'<div id="content">{page}</div>{links}') == "\n".join(some)


@pytest.mark.parametrize("holder", ["article", "main", 'div id="story"'])
def test_named_parts_of_the_article_stay(holder):
    some = [prose(i, 40) for i in range(9)]
    kept = f"""<h2 id="related-work">Related work</h2><p>{some[0]}</p><h2 class="section-header">Prices</h2><p class="share-price">{some[1]}</p>
<pre><code>x = 1 <span class="hljs-comment">note</span></code></pre><section id="related-work-2"><p>{some[2]}</p></section>""" + "".join(f"<p>{t}</p>" for t in some[3:])
    gone = """<div class="share-buttons">Share it</div><section id="comments"><p>I like it</p></section><div class="related-stories"><a href=x>One more</a></div>"""
    text = html_text.main_text(f'<body><div class="menu-top">Menu</div><{holder}>{kept}{gone}</{holder.split()[0]}><p class="copyright">Us</p></body>')
    assert text.split("\n") == ["Related work", some[0], "Prices", some[1], "x = 1 note", *some[2:]]


def test_references_of_the_article_stay():
    references = "<ol>" + "".join(f"<li><a href=x>Reference number {i}</a></li>" for i in range(5)) + "</ol>"
    text = html_text.main_text(f"<ul>{references}</ul><article><p>{prose(1, 40)}</p>{references}<ul class=related>{references}</ul></article>")
    assert text.split("\n") == [prose(1, 40), *[f"Reference number {i}" for i in range(5)]]


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (None, "u", "", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


# --- 10


def test_bpe(docs, empty):
    path, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    own = bpe.codec(bpe.read_ranks(path), pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(2)
    odd = ["<|endoftext|>", "a" * 3000, "日本語🙂" * 50, " \n\n  x", "it's we'll", "".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(97, 122)])) for _ in range(4000))]
    for t in [t or "" for _, t in TEXTS] + odd:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    got = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t in TEXTS)
    assert bpe.encode(empty, path, pattern).count() == 0


# --- queries


def test_oracles_hold(spark):
    """Each query with SQL gives its rows on the smallest tables."""
    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{where}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, where)
        expect = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(expect.columns)
        assert rows(got.select(columns)) == sorted(expect.project(", ".join(columns)).fetchall(), key=repr), name
