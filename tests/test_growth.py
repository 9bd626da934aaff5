"""Steps whose cost must grow no faster than their input: the same results as the plain way, and nothing needless is shuffled."""

import re

import pytest

from sparkseek import registry
from sparkseek.operators import evaluate, rank, sparse

TEXTS = ["def getHTTPResponse my_func my_func _foo", "Plain words plain", None, "", "ÄÖ straße x1 abc123 ABC __ a_b_", "plain plain two"]


def texts(spark, values=TEXTS):
    return spark.createDataFrame([(i, f"src/a_{i}/MyFile{i}.py", t) for i, t in enumerate(values)], "chunk_id long, file_path string, content string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs_shuffled(df):
    return bool(re.search(r"hashpartitioning\(query_id#\d+L, chunk_id", plan(df)))


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


@pytest.mark.parametrize("enriched", [True, False])
def test_occurrences_are_the_counted_tokens(spark, enriched, monkeypatch):
    monkeypatch.setattr(sparse, "ROWS_OUT", 3)
    own, names = texts(spark), ("term", "chunk_id", "tf", "dl")
    found = sparse.occurrences(own, enriched)
    assert rows(found, *names) == rows(sparse.counted(sparse.tokens(own, enriched)), *names)
    assert "Exchange hashpartitioning" not in plan(found)
    twice = own.unionByName(own.where("chunk_id < 2"))
    assert rows(sparse.occurrences(twice, enriched), *names) == [(t, c, n * (2 if c < 2 else 1), d) for t, c, n, d in rows(found, *names)]


def test_rare_and_frequent_terms_weigh_alike(spark, tmp_path, monkeypatch):
    own, names = texts(spark), ("term", "chunk_id", "tf", "dl", "df", "weight")
    built = []
    for i, most in enumerate((200_000, 3, 0)):
        monkeypatch.setattr(sparse, "FREQUENT", most)
        built.append(rows(sparse.build(sparse.occurrences(own), 6, f"{tmp_path}/{i}"), *names))
    assert built[0] == built[1] == built[2] and len(built[0]) > 20


def test_scores_shuffle_postings_not_pairs(spark, tmp_path):
    index = sparse.build(sparse.occurrences(texts(spark)), 6, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "plain two"), (2, "getHTTPResponse plain plain"), (3, None)], "query_id long, query string")
    found = sparse.scores(index, asked, dl=True)
    assert not pairs_shuffled(found)
    assert all(r["dl"] > 0 for r in found.collect())
    few = spark.createDataFrame([(1,), (5,)], "chunk_id long")
    assert rows(sparse.scores(index, asked, few), "query_id", "chunk_id", "score") == [r for r in rows(found, "query_id", "chunk_id", "score") if r[1] in (1, 5)]
    assert not pairs_shuffled(sparse.scores(index, asked, few))


def test_shared_windows_are_found_where_texts_are_read(spark):
    words = "a b c d e f g h i j".split()
    asked = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[1:])), (3, "a b c"), (4, None)], "query_id long, query string")
    own = texts(spark, [" ".join(words), "x y\n" + "\t".join(words[1:9]), "a b c d e f g", None, "", " ".join(words * 3)])
    own = own.unionByName(own.where("chunk_id = 0"))
    found = evaluate.sharing(own, asked, 8)
    assert rows(found, "query_id", "chunk_id") == [(1, 0), (1, 1), (1, 5), (2, 0), (2, 1), (2, 5)] == rows(evaluate.sharing(own, asked, 8, sent=0), "query_id", "chunk_id")
    assert "window" not in plan(found)
    assert evaluate.sharing(own, asked.where("query_id = 3"), 8).count() == 0


def test_matching_lines_leave_python_in_pieces(spark):
    own = texts(spark, ["aa b\nb", "", None, "a\nAA\nab"]).coalesce(1)
    asked = spark.createDataFrame([("a",), ("b",), ("aa",), ("",)], "pattern string")
    whole, pieces = evaluate.matching_lines(own, asked), evaluate.matching_lines(own, asked, rows_out=1)
    assert rows(pieces, "pattern", "file_path", "n") == rows(whole, "pattern", "file_path", "n")
    assert sorted(r[2] for r in whole.where("pattern = 'b'").select("pattern", "file_path", "n").collect()) == [1, 2]


def test_only_chunks_that_define_a_name_are_pulled_in(spark):
    said = [("class MyService:\n    pass", "lib/myservice.cs"), ("x = MyService()", "src/myservice.py"), ("class Other:", "src/my_service.py"), ("create table b.MYSERVICE (", "src/MyServices.rb"), ("fn base::MyService<T>", "src/myse.rs"), ("fn MyService", "src/my.rs"), (None, "myservice.py")]
    own = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(said)], "chunk_id long, content string, file_path string")
    asked = spark.createDataFrame([(1, "MyService"), (2, "how does MyService or MyServiceBase work"), (3, "nothing")], "query_id long, query string")
    found = rank.named(rank.asked(asked), own)
    assert rows(found, "query_id", "chunk_id") == [(1, 0), (1, 3), (2, 0), (2, 4)]
    assert "HashAggregate" not in plan(found)


def test_texts_of_results_are_not_shuffled(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(registry.format_results(spark, "/root/testdata/sf0.001"))
        monkeypatch.setattr(sparse, "HITS_SENT", 0)
        assert "SortMergeJoin" in plan(registry.format_results(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
