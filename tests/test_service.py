"""Served tools, datasets, extraction while a tree is indexed, downloads and evaluation."""

import io
import json
import zipfile

import numpy as np
import pytest

from sparkseek.__main__ import main
from sparkseek.index import Index
from sparkseek.operators import dense, evaluate, markup
from sparkseek.service import TOOLS, Service
from sparkseek.sources import datasets, extract, files, models

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def write_docx(path, *parts):
    body = "".join(f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in parts)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "auth.py").write_text("def authenticate(token):\n    return token\n")
    (root / "guide.md").write_text("# Guide\nHow to login.\n")
    write_docx(root / "manual.docx", ("Heading1", "Setup"), ("", "Install the zebra."), ("Heading1", "Use"), ("", "Ride the zebra."))
    (root / "broken.docx").write_text("no archive")
    return root


@pytest.fixture(scope="module")
def index(spark, project):
    return Index.from_path(spark, str(project), encoder=models.HashEncoder(), include_text_files=True)


def test_documents_are_extracted_and_located(index):
    rows = index.chunks.where("file_path like '%.docx'").orderBy("chunk_id").collect()
    assert [(r["file_path"], r["heading_path"], r["language"]) for r in rows] == [("manual.docx", ["Setup"], "docx"), ("manual.docx", ["Use"], "docx")]
    assert "manual.docx:Use:" in index.format(index.search("ride zebra", 1, "bm25"), "Header")
    assert index.chunks.groupBy("chunk_id").count().where("count > 1").count() == 0


def test_unreadable_files_are_left_out(spark, tmp_path):
    listed = spark.createDataFrame([(0, str(tmp_path / "gone.py"), "gone.py", 1)], "file_id long, path string, file_path string, length long")
    assert files.read(listed).count() == 0


@pytest.mark.parametrize(
    ("text", "expected"),
    [("alpha\n\fbeta\n\fgamma\n", [(1, 1, "1"), (2, 2, "2"), (3, 3, "3")]), ("a\n\f\n\fc\n", [(1, 1, "1"), (3, 3, "3")]), ("only\n", [(1, 1, "1")]), ("", [])],
)
def test_pages(text, expected):
    lines = [x for x in text.replace("\n", "\n\x01").split("\x01") if x]
    assert [(a, b, p[0]) for a, b, p in markup.pages(lines)] == expected


def test_pages_never_cross(spark):
    text = "".join(f"line {i}\n" for i in range(200)) + "\fnext\n"
    got = markup.chunk(spark.createDataFrame([(1, "d.pdf", "pdf", text)], "file_id long, file_path string, language string, content string")).collect()
    assert [r["locator"]["page_start"] for r in got] == [1] * 5 + [2] and got[-1]["content"] == "next\n"


def test_tools(index):
    built = []
    service = Service(lambda s, r: built.append((s, r)) or index, default="here", ref="v1")
    assert "auth.py" in service.search("authenticate") and built == [("here", "v1")]
    assert service.search("zzzz qqqq", mode="bm25") == "No results found."
    assert "Related to auth.py:1" in service.find_related("auth.py", 1) or "No related chunks" in service.find_related("auth.py", 1)
    assert service.find_related("auth.py", 99).startswith("No chunk found at auth.py:99")
    for unsafe in ("ssh://x/y", "file:///x", "git+ssh://x", "git@host:x/y"):
        assert "not supported" in service.search("x", repo=unsafe)
    assert built == [("here", "v1")]
    assert Service(lambda s, r: index).search("x").startswith("No repo specified")
    assert "Failed to index" in Service(lambda s, r: 1 / 0, default="x").search("x")


def test_messages(index):
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "authenticate", "mode": "bm25"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "nothing"}},
        {"jsonrpc": "2.0", "id": 5, "method": "what"},
    ]
    out = io.StringIO()
    Service(lambda s, r: index, default="x").serve(io.StringIO("\n".join([*map(json.dumps, asked), "{broken", ""])), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in said] == [1, 2, 3, 4, 5, None]
    assert said[1]["result"]["tools"] == TOOLS and "score=" in said[2]["result"]["content"][0]["text"]
    assert said[3]["result"]["isError"] and said[4]["error"]["code"] == -32601 and said[5]["error"]["code"] == -32700


def test_datasets(spark, tmp_path):
    (tmp_path / "repos.json").write_text(json.dumps([{"name": "a", "language": "go", "url": "u", "revision": "r"}, {"name": "b", "language": "c", "url": "u", "revision": "r", "benchmark_root": "x"}]))
    (tmp_path / "annotations").mkdir()
    (tmp_path / "annotations/a.json").write_text(json.dumps([{"query": "how it works", "relevant": ["x.go", {"path": "y.go", "start_line": 3, "end_line": 9}]}, {"query": "Foo", "category": "odd", "relevant": [], "secondary": ["z.go"]}]))
    (tmp_path / "annotations/c.json").write_text(json.dumps([{"query": "unknown", "relevant": []}]))
    known = datasets.repos(spark, str(tmp_path / "repos.json"))
    got = datasets.tasks(spark, str(tmp_path / "annotations"), known).orderBy("query_id").collect()
    assert [(r["repo"], r["language"], r["category"]) for r in got] == [("a", "go", "architecture"), ("a", "go", "odd")]
    assert [tuple(t) for t in got[0]["targets"]] == [("x.go", None, None), ("y.go", 3, 9)] and got[1]["targets"][0]["path"] == "z.go"
    assert datasets.tasks(spark, str(tmp_path / "annotations"), known, languages=["c"]).count() == 0
    assert json.load(open(datasets.save_results(str(tmp_path / "out"), "hybrid", {"x": 1}))) == {"x": 1}


def test_download(tmp_path):
    for name in models.FILES:
        (tmp_path / name).write_text(name)
    base, folder = f"file://{tmp_path}", str(tmp_path / "model")
    assert main(["download-model", base, folder], out=lambda x: None) == 0
    assert models.download(base, folder) == [] and (tmp_path / "model/config.json").read_text() == "config.json"
    assert main(["download-model", f"{base}/none", folder]) == 1


def test_target_ranks(spark):
    results = spark.createDataFrame([(1, 1, "src/a.py", 1, 10), (1, 2, "/root/src/b.py", 5, 9), (1, 3, "src/b.py", 1, 50)], "query_id int, rank int, file_path string, start_line int, end_line int")
    targets = spark.createDataFrame([(1, 1, "a.py", None, None), (1, 2, "src/b.py", 10, 12), (1, 3, "b.py", 9, 9), (1, 4, "c.py", None, None)], "query_id int, target_id int, path string, first_line int, last_line int")
    assert {r["target_id"]: r["rank"] for r in evaluate.target_ranks(results, targets).collect()} == {1: 1, 2: 3, 3: 2, 4: None}


def test_means_and_reductions(spark):
    scored = spark.createDataFrame([("a", "go", "symbol", 1.0), ("a", "go", "semantic", 0.0), ("b", "go", "symbol", 0.0), ("c", "c", "symbol", 1.0)], "repo string, language string, category string, ndcg double")
    means = {(r["level"], r["name"]): r["mean"] for r in evaluate.macro_means(scored).collect()}
    assert means["repo", "a"] == 0.5 and means["language", "go"] == 0.25 and means["category", "symbol"] == pytest.approx(2 / 3) and means["all", "all"] == 0.5
    ours = spark.createDataFrame([(1, 10), (2, 50), (3, None)], "query_id int, tokens int")
    other = spark.createDataFrame([(1, 100), (2, 25), (3, 5)], "query_id int, tokens int")
    r = evaluate.reductions(ours, other).first()
    assert (r["n_paired"], r["median_ours"], r["median_other"], r["median_reduction"], r["better_share"]) == (2, 30.0, 62.5, pytest.approx(-0.05), 0.5)
    modes = spark.createDataFrame([("bm25", 0.5, 2.0), ("bm25", 1.0, 4.0)], "mode string, ndcg double, p50_ms double")
    assert tuple(evaluate.mode_summary(modes).first()) == ("bm25", 0.75, 3.0)


def test_keyword_baseline(spark):
    tree = spark.createDataFrame([("a", "Token here\ntoken parse\nnone"), ("b", "parse"), ("c", None)], "file_path string, content string")
    asked = spark.createDataFrame([(1, "how to parse token"), (2, "a b"), (3, "to")], "query_id int, query string")
    assert {(r["query_id"], r["file_path"]): r["n"] for r in evaluate.grep_keywords(tree, asked).collect()} == {(1, "a"): 3, (1, "b"): 1, (3, "a"): 2}  # a query of no keywords is searched for as it is
    assert {(r["query_id"], r["file_path"]): r["n"] for r in evaluate.grep_keywords(tree, asked, most=1).collect()} == {(1, "a"): 2, (3, "a"): 1}


def test_nearest_over_many_batches(spark):
    rng = np.random.default_rng(5)
    own = rng.integers(-2, 3, (500, 3)).astype(float)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(own)], "chunk_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, own[i].tolist()) for i in range(0, 500, 100)], "query_id long, embedding array<float>")
    unit = own / (np.linalg.norm(own, axis=1, keepdims=True) + 1e-8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)
    try:
        got = {}
        for r in dense.search(v, q, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(round(r["score"], 6))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: [round(x, 6) + 0.0 for x in sorted(unit @ unit[i], reverse=True)[:7]] for i in range(0, 500, 100)}


def test_known_documents():
    assert extract.known("a.PDF") and not extract.known("a.py")
