"""The search engine: golden values, sources, chunkers, models, index, and queries against their SQL."""

import json
import os
import struct
import zipfile
from datetime import UTC, datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek import registry
from sparkseek.__main__ import main
from sparkseek.cache import Cache
from sparkseek.functions import files as kinds
from sparkseek.functions import text
from sparkseek.index import Index
from sparkseek.operators import chunks, dense, markup, rank, sparse
from sparkseek.sources import extract, files, models
from sparkseek.streaming import watch

WHERE = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_bm25_goldens(spark, tmp_path):
    corpus = ["def authenticate token", "def login user", "class config host", "def authenticate session token"]
    tokens = spark.createDataFrame([(i, t.split()) for i, t in enumerate(corpus)], "chunk_id long, tokens array<string>")
    index = sparse.build(tokens, 4, f"{tmp_path}/index")

    def ask(q):
        got = {r["chunk_id"]: r["score"] for r in sparse.scores(index, spark.createDataFrame([(1, q)], "query_id long, query string")).collect()}
        return [pytest.approx(got.get(i, 0), abs=1e-6) for i in range(4)]

    assert ask("authenticate") == [0.287200, 0, 0, 0.251175]
    assert ask("def") == [0.147786, 0.147786, 0, 0.129248]
    assert ask("authenticate token") == [0.574401, 0, 0, 0.502351]
    assert ask("def def") == [2 * 0.147786, pytest.approx(0.295572, abs=2e-6), 0, pytest.approx(0.258496, abs=2e-6)]
    assert ask("nonexistent") == ask("") == [0, 0, 0, 0]


def test_tokens(spark):
    assert column(spark, ["foo bar.baz()", "doSomething(x)", "class HandlerStack: my_func()", "123", "", None], text.tokenize) == [["foo", "bar", "baz"], ["dosomething", "do", "something", "x"], ["class", "handlerstack", "handler", "stack", "my_func", "my", "func"], [], [], []]


def test_enriched(spark):
    paths = ["src/auth.py", "auth.py", "a/b/c/d/e.py", "/abs/foo.py", "a/./b/c.py"]
    assert column(spark, paths, lambda p: text.enrich(F.lit("def foo()"), p)) == ["def foo() auth auth src", "def foo() auth auth ", "def foo() e e b c d", "def foo() foo foo abs", "def foo() c c a b"]
    assert column(spark, [".gitignore", "foo.tar.gz", "a/b", "..x.y", "..."], text.stem) == [".gitignore", "foo.tar", "b", "..x", "..."]


def test_alpha_and_symbols(spark):
    assert column(spark, ["MyService", "how does routing work"], lambda q: text.alpha(q, F.lit(None))) == [0.3, 0.5]
    assert column(spark, ["MyService"], lambda q: text.alpha(q, F.lit(0.7))) == [0.7]
    assert column(spark, ["Sinatra::Base", "a\\b", "p->q", "x.y", " z "], text.symbol_leaf) == ["Base", "b", "q", "y", "z"]


def test_definitions(spark):
    found = [("class MyService:\n", True), ("x = MyService()", False), ("fn MyService<T>", True), ("create table MyService (", True), ("class a.b::MyService {", True), ("subclass MyService", False), ("type MyService", True)]
    assert column(spark, [c for c, _ in found], lambda c: text.defines(c, F.lit("MyService"))) == [d for _, d in found]


def test_penalties_and_languages(spark):
    paths = ["src/a.py", "tests/a.py", "__init__.py", "compat/a.py", "examples/a.py", "a.d.ts"]
    assert column(spark, paths, kinds.penalty) == [1.0, 0.3, 0.5, 0.3, 0.3, 0.7]
    assert column(spark, ["foo.PY", "b.tsx", "Main.kt", "README.md", "foo.xyz"], kinds.language) == ["python", "typescript", "kotlin", "markdown", None]


def test_saturation_is_the_loop(spark):
    r = np.random.default_rng(4)
    rows = [(1, i, f"f{r.integers(4)}.py", float(r.integers(0, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, file_path string, score double").withColumn("ord", rank.order(0, F.col("chunk_id")))
    got = [(x["chunk_id"], x["score"]) for x in rank.rerank(df, 7).orderBy("rank").collect()]
    seen, chosen = {}, []
    for n, (_, i, path, score) in enumerate(sorted(rows, key=lambda x: (-x[3], x[1]))):
        if len(chosen) >= 7 and score <= min(c[0] for c in sorted(chosen, key=lambda c: (-c[0], c[1]))[:7]):
            break
        chosen.append((score * 0.5 ** seen.get(path, 0), n, i))
        seen[path] = seen.get(path, 0) + 1
    assert got == [(i, s) for s, _, i in sorted(chosen, key=lambda c: (-c[0], c[1]))[:7]]


def test_gains_share_one_best_score(spark):
    own = spark.createDataFrame([(1, "class MyService:\n    pass", "src/service_handler.py"), (2, "x = 1", "src/other.py"), (3, "class MyService { }", "lib/myservice.cs")], "chunk_id long, content string, file_path string")
    found = spark.createDataFrame([(1, 1, "src/service_handler.py", 0.5), (1, 2, "src/other.py", 0.4)], "query_id long, chunk_id long, file_path string, score double").withColumn("ord", rank.order(0, F.col("chunk_id")))

    def ask(query):
        asked = spark.createDataFrame([(1, query), (2, query)], "query_id long, query string")
        return {r["chunk_id"]: round(r["score"], 6) for r in rank.boost(found, asked, own).collect()}

    assert ask("service handler for MyService") == {1: round(0.5 + 0.5 * 2 / 3 + 0.5 * 3 * 0.5, 6), 2: 0.4, 3: 0.5 * 3 * 0.5 * 1.5}
    assert ask("MyService") == {1: 0.5 + 0.5 * 3, 2: 0.4, 3: 0.5 * 3 * 1.5}
    assert ask("nothing of that") == {1: 0.5, 2: 0.4}


def test_lines(spark):
    df = spark.createDataFrame([(n, "\n".join(f"l{i}" for i in range(n)) + "\n") for n in (1, 50, 95, 96)] + [(0, ""), (-1, " \n")], "n int, content string")
    got = {}
    for r in chunks.line_chunks(df).collect():
        got.setdefault(r["n"], []).append((r["start_line"], r["end_line"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 1)], 50: [(1, 50)], 95: [(1, 50), (46, 95)], 96: [(1, 50), (46, 95), (91, 96)]}
    pages = spark.createDataFrame([("alpha\n\fbeta\n\f \n\fgamma\n",)], "content string")
    assert sorted((r["page"], r["start_line"]) for r in chunks.page_chunks(pages).collect()) == [(1, 1), (2, 2), (4, 4)]


def test_resolve(spark):
    own = spark.createDataFrame([(1, "a", 1, 3), (2, "a", 3, 5), (3, "b", 1, 1)], "chunk_id long, file_path string, start_line int, end_line int")
    places = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "b", 1), (4, "a", 99), (5, "c", 1), (6, "a", 5)], "place_id long, file_path string, line int")
    assert {r["place_id"]: r["chunk_id"] for r in chunks.resolve(own, places).collect()} == {1: 1, 2: 2, 3: 3, 6: 2}


def test_dense(spark):
    v = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 5.0]), (2, [0.0, 1.0]), (3, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["chunk_id"], round(r["score"], 6)) for r in dense.search(v, q, 9).orderBy("rank").collect()] == [(0, 1.0), (1, 0.0), (2, 0.0)]
    assert dense.search(v, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        dense.search(v, q, 0)


def test_markdown_and_code():
    assert markup.markdown("# Intro\nWelcome.\n\n# Setup\nRun it.\n") == [(1, 3, ("Intro",)), (4, 5, ("Setup",))]
    assert [p for _, _, p in markup.markdown("# Real Heading\n```\n# not one\n```\n")] == [("Real Heading",)]
    assert markup.markdown("no heading\n") == [(1, 1, ())]
    big = "# Big\n" + "\n".join(["word " * 60] * 8) + "\n\n" + "\n".join(["other " * 60] * 8)
    assert len(markup.markdown(big)) >= 2
    source = "using X;\nnamespace N {\nclass A {\n" + "\n".join(f'  void M{i}() {{ var s = "}}"; /* }} */ }}' for i in range(20)) + "\n}\n}\n"
    pieces = markup.code(source, 80)
    assert len(pieces) > 5 and pieces == sorted(pieces)
    assert markup.code("// only a comment") is None
    header = "#include <a>\nint f(int x);\ntypedef int T;\nusing U = int;\nextern int g;\n\nclass A {\n  void m() { int y; }\n};\nint h();\n#define LAST 1\n"
    covered = lambda pieces: {n for a, b, _ in pieces for n in range(a, b + 1)}
    assert covered(markup.code(header, 40, top=True)) >= {1, 2, 3, 4, 5, 7, 8, 9, 10, 11}
    assert 2 not in covered(markup.code(header, 40))


def test_ignores():
    for pattern, probe, expected in [("local/", "local/", True), ("local/", "local/anything.py", False), ("generated.py", "generated.py", True), ("generated.py", "src/keep.py", False), ("out/*", "out/", False), ("out/*", "out/a.py", True), ("/a.py", "b/a.py", False), ("**/x", "a/b/x", True), ("[a].py", "a.py", False)]:
        assert files.Ignores([pattern])(probe) is expected, (pattern, probe)
    assert not files.Ignores(["out/*", "!out/keep.py"])("out/keep.py")


@pytest.fixture
def project(tmp_path):
    for name, content in {"src/auth.py": "def authenticate(token):\n    return token\n\ndef login(user):\n    pass\n", "src/utils.py": "class Config:\n    pass\n\ndef format_name(x):\n    return x\n", "README.md": "# Test project\nAbout login.\n", "node_modules/x.py": "no", "local/y.py": "no", ".gitignore": "local/\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return tmp_path


def test_walk(project, tmp_path):
    names = lambda **o: [os.path.relpath(p, project) for p in files.walk(str(project), **o)]
    assert names() == ["src/auth.py", "src/utils.py"]
    assert names(documents=True) == ["README.md", "src/auth.py", "src/utils.py"]
    assert names(extensions=[".md"]) == ["README.md"]
    assert names(newest=datetime(2000, 1, 1, tzinfo=UTC)) == []
    (project / "loop").symlink_to(project)
    (project / "away").symlink_to("/tmp")
    assert names() == ["src/auth.py", "src/utils.py"]


def test_index(spark, project, tmp_path_factory):
    index = Index.from_path(spark, str(project), encoder=models.HashEncoder(), include_text_files=True)
    assert {r["language"] for r in index.stats().collect()} == {"python", "markdown"}
    for mode in ("hybrid", "semantic", "bm25"):
        got = index.search("authenticate token", 2, mode).orderBy("rank").collect()
        assert got[0]["source"] == mode and (mode == "semantic" or "authenticate" in got[0]["content"])
    assert index.search("  ").count() == 0
    assert {r["language"] for r in index.search("login", languages=["markdown"]).collect()} == {"markdown"}
    assert index.search("login", languages=["nothing"]).count() > 0
    assert index.search("Config", 3).orderBy("rank").first()["file_path"] == "src/utils.py"
    chunk = index.resolve("src/auth.py", 1)
    assert chunk not in [r["chunk_id"] for r in index.find_related(chunk).collect()]
    assert index.resolve("src/auth.py", 99) is None
    with pytest.raises(ValueError):
        index.search("x", mode="vector")
    folder = str(tmp_path_factory.mktemp("index"))
    index.save(folder)
    again = Index.open(spark, folder, models.HashEncoder())
    assert again.search("login", 3).count() == index.search("login", 3).count()
    assert "## 1. src/auth.py:1-5  [score=" in index.format(index.search("authenticate", 1, "bm25"), "Header")
    with pytest.raises(FileNotFoundError):
        Index.from_path(spark, str(project / "none"))
    said = []
    assert main(["search", "authenticate", "x"], build=lambda p: index, out=said.append) == 0 and "src/auth.py" in said[0]
    assert main(["search", "zzzz", "x", "--mode", "bm25"], build=lambda p: index, out=said.append) == 0 and said[-1] == "No results found"
    assert main(["find-related", "src/auth.py", "99", "x"], build=lambda p: index) == 1


def test_init(tmp_path):
    target = str(tmp_path / "A.md")
    assert [main(["init", "--file", target]), main(["init", "--file", target]), main(["init", "--file", target, "--force"])] == [0, 1, 0]


def test_cache():
    built = []
    cache = Cache(lambda s, r: built.append(s) or s, most=2)
    assert [cache.get(x) for x in "aabca"] == list("aabca") and built == ["a", "b", "c", "a"]
    failing = Cache(lambda s, r: 1 / 0 if not built.append(s) and len(built) < 6 else "ok")
    with pytest.raises(ZeroDivisionError):
        failing.get("x")
    assert failing.get("x") == "ok"


def test_model(tmp_path):
    vocabulary = {"[PAD]": 0, "[UNK]": 1, "foo": 2, "bar": 3, "##s": 4, "baz": 5}
    vectors = np.zeros((6, 4), np.float32)
    vectors[1] = 0.1
    for i, k in ((2, 0), (3, 1), (4, 2), (5, 3)):
        vectors[i, k] = 1
    header = json.dumps({"embeddings": {"dtype": "F32", "shape": [6, 4], "data_offsets": [0, 96]}}).encode()
    (tmp_path / "model.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + vectors.tobytes())
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"type": "WordPiece", "vocab": vocabulary, "unk_token": "[UNK]"}, "normalizer": {"type": "BertNormalizer", "lowercase": True}}))
    (tmp_path / "config.json").write_text("{}")
    encode = models.load(str(tmp_path))
    got = encode(["", "foo", "foo bar", "foos", "FOO", "qux"])
    assert np.allclose(got, [[0] * 4, [1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.5, 0, 0.5, 0], [1, 0, 0, 0], [0.1] * 4])
    with pytest.raises(NotImplementedError):
        models.WordPiece({"model": {"type": "BPE"}})
    with pytest.raises(FileNotFoundError):
        models.load(str(tmp_path / "none"))


def test_docx(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    par = lambda t, s="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = par("Setup", "Heading1") + par("Text") + "<w:tbl><w:tr><w:tc>" + par("a") + "</w:tc><w:tc>" + par("b") + "</w:tc></w:tr></w:tbl>" + par("Odd", "Heading7")
    with zipfile.ZipFile(tmp_path / "x.DOCX", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert extract.docx(str(tmp_path / "x.DOCX")) == ("# Setup\n\nText\n\na | b\n\nOdd\n", "markdown")
    assert extract.extractor("x.DOCX") and extract.extractor("x.unknown") is None
    (tmp_path / "y.docx").write_text("no")
    with pytest.raises(ValueError):
        extract.docx(str(tmp_path / "y.docx"))


def test_bursts_in_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 10.0), ("b", 0.5), ("z", 99.0)], "path string, s double").select("path", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, ts timestamp").parquet(f"{tmp_path}/in")
    q = watch.bursts(stream, late="2 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["path"], r["n"]) for r in spark.sql("SELECT * FROM bursts").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(WHERE):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{WHERE}/{t}'")
    got, expect = registry.QUERIES[name](spark, WHERE), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(expect.columns)
    ours = sorted((tuple(map(plain, r)) for r in got.select(columns).collect()), key=repr)
    assert ours == sorted((tuple(map(plain, r)) for r in expect.project(", ".join(columns)).fetchall()), key=repr)
