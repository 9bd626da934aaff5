"""The pipeline's stages against what they must keep."""

import random
import re

import corpus_pipeline
import duckdb
import pytest

from sparkseek.llm import near_copies, quality, substring
from sparkseek.llm._common import table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, DIR, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DIR).cache()
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(steps, spark):
    columns = table(spark, DIR, "documents").dtypes
    assert all(after.dtypes == columns for _, after in steps[:-1])


def test_quality_keeps_what_is_marked_good(steps):
    kept = set(ids(steps[0][1]))
    good = [r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{DIR}/labels.parquet' WHERE quality = 1").fetchall()]
    assert sum(i in kept for i in good) > 0.97 * len(good)
    assert len(kept) < steps[0][0].count()


def test_one_of_each_text_stays(steps):
    texts = [r["text"] for r in steps[1][1].collect()]
    assert len(texts) == len(set(texts))
    assert {r["text"] for r in steps[1][0].collect()} >= set(texts)


def test_no_passage_is_left_twice(steps, spark):
    before, after = steps[2]
    again = {r["doc_id"]: r["kept"] for r in substring.dedup(before).collect()}
    for r in after.collect():
        assert r["text"].split() == again[r["doc_id"]].split() and r["n_chars"] == len(r["text"])


def test_no_benchmark_passage_is_left(steps):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({i: i + 32 for i in range(65, 91)}))
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{DIR}/benchmark.parquet'").fetchall():
        w = words(t)
        windows.update(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    before, after = steps[3]
    hit = lambda t: any(tuple(w[i : i + 8]) in windows for w in [words(t)] for i in range(len(w) - 7))
    assert not any(hit(r["text"]) for r in after.collect())
    assert {r["doc_id"] for r in before.collect() if not hit(r["text"])} <= set(ids(after))


def test_tokens_of_all(steps):
    before, after = steps[4]
    assert ids(before) == ids(after)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in after.collect())


def test_awkward_rows(spark):
    rows = [(1, None, "en", "s", None), (None, "", None, None, 0), (2, "word " * 300, "en", None, 1500), (2, "word " * 300, "en", None, 1500), (3, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, table(spark, DIR, "documents").schema)
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, DIR)
            some.collect()


def test_labels_of_held_out_rows_are_not_learned(spark):
    known = table(spark, DIR, "labels")
    assert 0 < quality.learnable(known).count() < known.count()


def brute_groups(texts):
    """The texts' numbers, in groups that similarity of 0.8 or more over five-word shingles connects."""
    sets = []
    for t in texts:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 5 >= 4 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    found = {}
    for i, g in enumerate(group):
        found.setdefault(g, set()).add(i)
    return sorted(map(sorted, found.values()))


def changed(r, words, n):
    w = list(words)
    for at in r.sample(range(len(w)), n):
        w[at] = f"new{r.random()}"
    return " ".join(w)


@pytest.mark.parametrize("sample", [4000, 5])
def test_groups_of_near_copies(spark, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    r = random.Random(4)
    texts = [None, "", " ", "one", "One", "one two three four five", "one two three four five six", "a b c d", "x " * 30, "x " * 400]
    for _ in range(12):
        base = [f"w{r.randrange(300)}" for _ in range(r.randint(20, 300))]
        texts += [" ".join(base)] + [changed(r, base, round(len(base) * r.choice([0.01, 0.02, 0.025, 0.03]))) for _ in range(7)]
        texts += [" ".join(base[: round(len(base) * share)]) for share in (0.78, 0.8, 0.82, 0.9)]
    line = "this line is in every text that is made of other words "
    texts += [line * 2 + " ".join(f"v{r.randrange(300)}" for _ in range(40)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {}
    for x in near_copies.groups(docs).collect():
        found.setdefault(x["root"], set()).add(x["id"])
    assert sorted(map(sorted, found.values())) == brute_groups(texts)
    assert near_copies.groups(docs.limit(0)).count() == 0


def test_near_copies_beyond_two_bits_go(spark):
    r = random.Random(9)
    texts = []
    for _ in range(20):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        texts += [" ".join(base), changed(r, base, 2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], table(spark, DIR, "documents").schema)
    assert ids(corpus_pipeline.near_dedup(spark, docs, DIR)) == [g[0] for g in brute_groups(texts)] == list(range(0, 40, 2))


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = ("a1 a2 a3 a4 a5 a6", "b1 b2 b3 b4 b5 b6", "c1 c2 c3 c4 c5 c6")
    rows = [(1, a), (1, b), (1, b), (2, b), (None, b), (None, c), (None, c), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], table(spark, DIR, "documents").schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (1, b), (None, c), (3, "")], key=repr)


def test_rows_that_resemble_some_of_a_large_group_join_it(spark, monkeypatch):
    r, turns, some = random.Random(5), [], near_copies._some_across
    monkeypatch.setattr(near_copies, "PARTNERS", 2)
    monkeypatch.setattr(near_copies, "_some_across", lambda rows, turn: turns.append(turn) or some(rows, turn))
    base = [f"w{i}" for i in range(150)]
    texts = [changed(r, base, r.choice([1, 1, 2, 3, 4])) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {}
    for x in near_copies.groups(docs).collect():
        found.setdefault(x["root"], set()).add(x["id"])
    assert sorted(map(sorted, found.values())) == brute_groups(texts)
    assert turns


def test_shingles_are_counted_in_all_texts(spark, monkeypatch):
    """Texts that share a third of their shingles with nine others have enough that nobody else has: nothing is compared."""
    compared, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "SAMPLE", 5)
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: compared.append(pairs.where("u <> v").count()) or verified(pairs, *rest))
    texts = [" ".join([f"own{i}x{j}" for j in range(70)] + [f"of{i // 10}x{j}" for j in range(30)]) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len({x["root"] for x in near_copies.groups(docs).collect()}) == 200
    assert sum(compared) == 0
