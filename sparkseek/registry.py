"""Registered queries over the driver's tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import files, text
from .operators import chunks as chunking
from .operators import dense, evaluate, rank, sparse
from .plans import store, views
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K = 10


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(c):
    return F.round(c, 6)


#: what this session has stored of each folder's tables
_KEPT: dict[tuple[str, str, str], str] = {}


def _store(spark: SparkSession, sf_dir: str, what: str, write: Callable[[str], DataFrame]) -> DataFrame:
    """Writes what to the shared folder, in place of an older one."""
    key, path = (spark.sparkContext.applicationId, sf_dir, what), store.scratch(spark, what)
    made = write(path)
    old, _KEPT[key] = _KEPT.get(key), path
    if old:
        store.remove(spark, old)
    return made


def _kept(spark: SparkSession, sf_dir: str, what: str, write: Callable[[str], DataFrame]) -> DataFrame:
    """What the session's first query that needs it has stored."""
    path = _KEPT.get((spark.sparkContext.applicationId, sf_dir, what))
    return spark.read.parquet(path) if path else _store(spark, sf_dir, what, write)


def _postings(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda path: sparse.build(sparse.occurrences(views.chunks(spark, sf_dir)), views.table(spark, sf_dir, "documents").count(), path)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "postings", _postings(spark, sf_dir))


# --- SQL fragments

_CAMEL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([A-Z])([0-9])', '\\1 \\2', 'g')"
_PARTS = f"(CASE WHEN contains(t, '_') THEN list_filter(string_split(lower(t), '_'), lambda p: p <> '') ELSE list_transform(string_split({_CAMEL}, ' '), lambda p: lower(p)) END)"


def _split(t: str) -> str:
    parts = _PARTS.replace("(t,", f"({t},").replace("lower(t)", f"lower({t})")
    return f"(CASE WHEN len({parts}) >= 2 THEN list_concat([lower({t})], {parts}) ELSE [lower({t})] END)"


def _tokens(s: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({s}, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda t: {_split('t')}))"


_CHUNKS = "c AS (SELECT doc_id AS chunk_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_path, coalesce(text, '') AS content, lang AS language FROM documents)"
_STEM = r"regexp_extract(file_path, '([^/]*)\.[^./]*$', 1)"
_ENRICHED = f"content || ' ' || {_STEM} || ' ' || {_STEM} || ' ' || array_to_string(list_filter(string_split(regexp_replace(file_path, '/[^/]*$', ''), '/'), lambda p: p <> ''), ' ')"
_BM25 = f"""{_CHUNKS}, k AS (SELECT chunk_id, file_path, language, {_tokens(_ENRICHED)} AS tokens FROM c),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens))::DOUBLE AS avgdl FROM k),
p AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM k) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM p JOIN d USING (term), n),
q AS (SELECT item_id::BIGINT AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT query_id, chunk_id, round(sum(times * w), 9) AS score FROM q JOIN w USING (term) GROUP BY ALL)"""
_TOP = "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b"
_UNIT = "u AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-8)) AS e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"
_COS = f"{_UNIT}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_inner_product(q.e, v.e) AS score, q.label AS ql, v.label AS vl FROM u q, u v WHERE q.vec_id % 20 = 0)"


# --- text


@register(f"SELECT token, array_to_string({_split('token')}, ',') AS parts FROM (SELECT unnest(['HandlerStack', 'my_func', 'simple', 'getHTTPResponse', 'XMLParser', 'ABC', 'abc123', '_foo', '_foo_bar']) AS token)")
def split_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = "HandlerStack my_func simple getHTTPResponse XMLParser ABC abc123 _foo _foo_bar".split()
    return spark.createDataFrame([(w,) for w in words], "token string").select("token", F.array_join(text.split_identifier(F.col("token")), ",").alias("parts"))


@register(f"WITH {_CHUNKS} SELECT chunk_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT chunk_id, {_tokens('content')} AS t FROM c)")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sparse.tokens(views.chunks(spark, sf_dir), enriched=False)
    return t.select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@register(f"WITH {_CHUNKS} SELECT count(*)::BIGINT AS n_chunks, count(DISTINCT file_path)::BIGINT AS n_files, sum(len({_tokens('content')}))::BIGINT AS n_tokens FROM c")
def token_budget_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.chunks(spark, sf_dir).select("file_path", F.size(text.tokenize(F.col("content"))).alias("n"))
    return rows.agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.sum("n").alias("n_tokens"))


@register(f"WITH {_CHUNKS} SELECT chunk_id, md5({_ENRICHED}) AS digest FROM c")
def enrich_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).select("chunk_id", F.md5(text.enrich(F.col("content"), F.col("file_path"))).alias("digest"))


@register(r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN contains(url, '/') THEN regexp_extract(regexp_replace(url, '/[^/]*$', ''), '([^/]*)$', 1) ELSE '' END AS parent FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", text.name(F.col("url")).alias("name"), text.parent_name(F.col("url")).alias("parent"))


_WORDS = "list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: lower(w))"


@register(f"""WITH w AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark)
SELECT item_id, count(DISTINCT w)::BIGINT AS n, md5(string_agg(DISTINCT w, ' ' ORDER BY w)) AS words FROM w WHERE length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in text.STOPWORDS)}) GROUP BY item_id""")
def keywords_nl(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.sort_array(text.keywords(F.col("text")))
    return views.table(spark, sf_dir, "benchmark").select("item_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("words")).where("n > 0")


_ASKED = ["MyService", "session", "how does MyService work", "Sinatra::Base", "_private", "snake_case", "a.b.c", "HTTP", "what is it", "obj->field"]


@register(f"""SELECT query, regexp_matches(query, '{text.SYMBOL}') AS symbol, CASE WHEN regexp_matches(query, '{text.SYMBOL}') THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS alpha,
CASE WHEN NOT contains(query, ' ') THEN 'symbol' WHEN starts_with(lower(query), 'how ') THEN 'architecture' ELSE 'semantic' END AS category FROM (SELECT unnest({_ASKED!r}) AS query)""")
def classify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([(x,) for x in _ASKED], "query string")
    return q.select("query", text.is_symbol(F.col("query")).alias("symbol"), text.alpha(F.col("query"), F.lit(None)).alias("alpha"), evaluate.category(F.col("query")).alias("category"))


@register(r"SELECT page_id, regexp_matches(url, '^(https?://|ssh://|git://|git\+ssh://|file://)|^[\w.-]+@[\w.-]+:([^/]|$)') AS git, regexp_matches(url, '^(ssh://|file://|git\+ssh://)|^[\w.-]+@[\w.-]+:([^/]|$)') AS unsafe FROM pages")
def source_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", text.is_git_url(F.col("url")).alias("git"), text.is_unsafe_source(F.col("url")).alias("unsafe"))


_PATHS = ["src/a.py", "src/test_a.py", "tests/b.go", "pkg/__init__.py", "compat/x.rb", "examples/demo.ts", "types/index.d.ts", "docs/readme.md", "Main.KT", "a/.git/config.json", "Makefile", "legacy/tests/old_test.c"]
_FACTOR = "(CASE WHEN {} THEN {}::DOUBLE ELSE 1.0::DOUBLE END)"
_PENALTY = " * ".join(_FACTOR.format(c, x) for c, x in ((f"regexp_matches(p, '{files.TEST_FILE}') OR regexp_matches(p, '{files.TEST_DIR}')", files.STRONG), ("regexp_extract(p, '([^/]*)$', 1) IN ('__init__.py', 'package-info.java')", files.MODERATE), (f"regexp_matches(p, '{files.COMPAT_DIR}')", files.STRONG), (f"regexp_matches(p, '{files.EXAMPLES_DIR}')", files.STRONG), (r"regexp_matches(p, '\.d\.ts$')", files.MILD)))
_LANGUAGES = "CASE lower(regexp_extract(p, '(\\.[^./]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (files.CODE | files.DOCUMENTS).items()) + " END"


@register(f"SELECT p AS file_path, {_LANGUAGES} AS language, round({_PENALTY}, 6) AS penalty, len(list_intersect(string_split(regexp_replace(p, '[^/]*$', ''), '/'), {files.IGNORED!r})) > 0 AS ignored FROM (SELECT unnest({_PATHS!r}) AS p)")
def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return spark.createDataFrame([(x,) for x in _PATHS], "file_path string").select(p, files.language(p).alias("language"), r6(files.penalty(p)).alias("penalty"), files.in_ignored_folder(p).alias("ignored"))


# --- chunks

_LINES = r"list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_WINDOWS = f"l AS (SELECT doc_id, {_LINES} AS l FROM documents), s AS (SELECT doc_id, l, unnest(range(0, (greatest(0, ceil((len(l) - 50) / 45.0)) * 45 + 1)::BIGINT, 45)) AS s FROM l WHERE len(l) > 0), x AS (SELECT doc_id, s + 1 AS start_line, least(s + 50, len(l)) AS end_line, array_to_string(l[s + 1 : s + 50], '') AS content FROM s)"


@register(rf"WITH {_WINDOWS} SELECT doc_id, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, md5(content) AS digest FROM x WHERE regexp_matches(content, '[^\s]')")
def chunk_lines_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.line_chunks(views.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", "start_line", "end_line", F.md5("content").alias("digest"))


@register(rf"WITH {_WINDOWS}, k AS (SELECT * FROM x WHERE regexp_matches(content, '[^\s]')) SELECT doc_id AS place_id, min_by(start_line, (CASE WHEN end_line = 47 THEN 1 ELSE 0 END) * 1000000 + start_line)::INTEGER AS start_line FROM k WHERE start_line <= 47 AND 47 <= end_line GROUP BY doc_id")
def resolve_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text", "doc_id")
    own = chunking.line_chunks(docs, "text").withColumn("chunk_id", F.col("start_line"))
    places = docs.select(F.col("doc_id").alias("place_id"), "file_path", F.lit(47).alias("line"))
    return chunking.resolve(own, places).select("place_id", F.col("chunk_id").alias("start_line"))


# --- lexical


@register(f"WITH {_BM25} SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, n")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.chunks(spark, sf_dir)
    return sparse.term_stats(sparse.occurrences(own), own.agg(F.count("*").alias("n"))).select("term", "df", r6("idf").alias("idf"))


@register(f"WITH {_BM25} SELECT term, chunk_id, tf::BIGINT AS tf FROM p")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.postings(sparse.occurrences(views.chunks(spark, sf_dir)))


@register(f"WITH {_BM25} SELECT chunk_id, len(tokens)::BIGINT AS dl FROM k")
def bm25_doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.lengths(sparse.tokens(views.chunks(spark, sf_dir)))


@register(f"WITH {_BM25} SELECT count(*)::BIGINT AS n_postings, count(DISTINCT term)::BIGINT AS n_terms, round(sum(w), 2) AS weight FROM w")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _store(spark, sf_dir, "postings", _postings(spark, sf_dir))
    return made.agg(F.count("*").alias("n_postings"), F.countDistinct("term").alias("n_terms"), F.round(F.sum("weight"), 2).alias("weight"))


@register(f"WITH {_BM25}, t AS ({_TOP}) SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM t WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse.search(_index(spark, sf_dir), views.queries(spark, sf_dir), K)
    return found.select("query_id", "chunk_id", r6("score").alias("score"), "rank")


@register(f"WITH {_BM25}, t AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b JOIN (SELECT chunk_id, language FROM c) USING (chunk_id) WHERE language = 'fr') SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM t WHERE rank <= {K}")
def bm25_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = views.chunks(spark, sf_dir).where("language = 'fr'")
    found = sparse.search(_index(spark, sf_dir), views.queries(spark, sf_dir), K, allowed)
    return found.select("query_id", "chunk_id", r6("score").alias("score"), "rank")


# --- dense


@register(f"WITH {_UNIT} SELECT vec_id AS chunk_id, round(list_inner_product(e, e), 6) AS norm, round(e[1], 6) AS head FROM u")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vectors(spark, sf_dir).select("chunk_id", dense.unit(F.col("embedding")).alias("u"))
    return v.select("chunk_id", r6(dense.dot(F.col("u"), F.col("u"))).alias("norm"), r6(F.get("u", F.lit(0))).alias("head"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.vectors(spark, sf_dir).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "label", F.col("chunk_id").alias("self_id"))


def _knn(where: str = "") -> str:
    return f"WITH {_COS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s {where}) SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM t WHERE rank <= {K}"


@register(_knn())
def cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.search(views.vectors(spark, sf_dir), _asked(spark, sf_dir), K)
    return found.select("query_id", "chunk_id", r6("score").alias("score"), "rank")


@register(_knn("WHERE vl = 3"))
def cosine_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.search(views.vectors(spark, sf_dir).where("label = 3"), _asked(spark, sf_dir), K)
    return found.select("query_id", "chunk_id", r6("score").alias("score"), "rank")


@register(_knn("WHERE query_id <> chunk_id AND ql = vl"))
def find_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.related(views.vectors(spark, sf_dir), _asked(spark, sf_dir), K, same="label")
    return found.select("query_id", "chunk_id", r6("score").alias("score"), "rank")


# --- fusion and ranking

OVER = 5 * K
_HITS = f"""{_BM25}, lx AS (SELECT * FROM ({_TOP}) WHERE rank <= {OVER}), {_UNIT},
vs AS (SELECT i.item_id::BIGINT AS query_id, v.vec_id AS chunk_id, list_inner_product(q.e, v.e) AS score FROM benchmark i JOIN u q ON q.vec_id = i.item_id, u v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs) WHERE rank <= {OVER}),
fu AS (SELECT query_id, chunk_id, 0.5 * coalesce(1.0::DOUBLE / (60 + sm.rank), 0) + 0.5 * coalesce(1.0::DOUBLE / (60 + lx.rank), 0) AS score, CASE WHEN sm.rank IS NOT NULL THEN sm.rank ELSE 100000 + lx.rank END AS ord FROM sm FULL JOIN lx USING (query_id, chunk_id)),
fp AS (SELECT fu.*, file_path FROM fu JOIN c USING (chunk_id))"""
_COHERE = """co AS (SELECT query_id, chunk_id, file_path, ord, score + CASE WHEN n = 1 AND m <> 0 THEN 0.2 * m * f / x ELSE 0 END AS score FROM (
SELECT *, max(score) OVER (PARTITION BY query_id) AS m, max(f) OVER (PARTITION BY query_id) AS x FROM (
SELECT *, sum(score) OVER (PARTITION BY query_id, file_path) AS f, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, ord) AS n FROM fp)))"""


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    own, asked = views.chunks(spark, sf_dir), views.queries(spark, sf_dir)
    lexical = sparse.search(_index(spark, sf_dir), asked, OVER)
    vectors = views.vectors(spark, sf_dir).join(own.select("chunk_id"), "chunk_id", "left_semi")
    points = views.vectors(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "embedding").join(asked.select("query_id"), "query_id", "left_semi")
    return dense.search(vectors, points, OVER), lexical, asked.withColumn("alpha", F.lit(0.5)), own


@register(f"WITH {_HITS} SELECT query_id, chunk_id, round(score, 9) AS score FROM fu")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic, lexical, asked, _ = _fused(spark, sf_dir)
    return rank.fuse(semantic, lexical, asked).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


_TURNS = "t AS (SELECT conv_id * 1000 + turn AS chunk_id, 'conv/' || conv_id || '.md' AS file_path, (length(coalesce(text, '')) % 97)::DOUBLE AS score, 1::BIGINT AS query_id, conv_id * 1000 + turn AS ord FROM conversations)"


def _turn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.turns(spark, sf_dir)
    return t.select(F.lit(1).cast("long").alias("query_id"), "chunk_id", "file_path", (F.length("content") % 97).cast("double").alias("score"), rank.order(0, F.col("chunk_id")).alias("ord"))


@register(f"WITH {_TURNS}, {_COHERE.replace('FROM fp', 'FROM t')} SELECT chunk_id, round(score, 6) AS score FROM co")
def file_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.coherence(_turn_scores(spark, sf_dir)).select("chunk_id", r6("score").alias("score"))


@register(f"WITH {_TURNS}, s AS (SELECT *, score * power(0.5, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, ord) - 1) AS eff FROM t) SELECT chunk_id, round(eff, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY eff DESC, score DESC, ord) AS rank FROM s) WHERE rank <= 50")
def file_saturation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rerank(_turn_scores(spark, sf_dir), 50).select("chunk_id", r6("score").alias("score"), "rank")


# gains of queries over chunks kc(chunk_id, file_path, content), for candidates co and queries qs(query_id, query, alpha)
_WORDS_OF = f"list_distinct(list_filter(list_transform(regexp_extract_all(query, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({text.STOPWORDS!r}, w)))"
_LEAF = r"CASE WHEN contains(query, '::') THEN string_split(query, '::')[-1] WHEN contains(query, '\') THEN string_split(query, '\')[-1] WHEN contains(query, '->') THEN string_split(query, '->')[-1] WHEN contains(query, '.') THEN string_split(query, '.')[-1] ELSE trim(query) END"
_QUOTED = r"'\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*' || n || '(?:\s|[<({:\[;]|$)'"
_DEFINES = f"len(list_filter(names, lambda n: regexp_matches(content, '(?m)(?:^|\\s)(?:{'|'.join(text.DEFINES)})' || {_QUOTED}) OR regexp_matches(content, '(?mi)(?:^|\\s)(?:{'|'.join(text.SQL_DEFINES)})' || {_QUOTED}))) > 0"
_HOME = "len(list_filter(names, lambda n: lower(n) IN (ls, replace(ls, '_', ''), regexp_replace(ls, 's+$', ''), regexp_replace(replace(ls, '_', ''), 's+$', '')))) > 0"
_NEAR = "len(list_filter(words, lambda w: len(list_filter(parts, lambda x: w = x OR (least(length(w), length(x)) >= 3 AND (starts_with(w, x) OR starts_with(x, w))))) > 0))"
_BOOST = f"""ks AS (SELECT chunk_id, file_path, content, {_STEM} AS stem, lower({_STEM}) AS ls, regexp_extract(regexp_replace(file_path, '/[^/]*$', ''), '([^/]*)$', 1) AS parent FROM kc),
kp AS (SELECT *, list_distinct(list_concat({_split('stem')}, {_split('parent')})) AS parts FROM ks),
qa AS (SELECT *, CASE WHEN sym THEN [] ELSE {_WORDS_OF} END AS words, CASE WHEN sym THEN list_distinct([{_LEAF}, trim(query)]) ELSE list_distinct(regexp_extract_all(query, '{text.EMBEDDED}')) END AS names, CASE WHEN sym THEN 3.0::DOUBLE ELSE 1.5::DOUBLE END AS unit, lower({_LEAF}) AS leaf FROM (SELECT *, regexp_matches(trim(query), '{text.SYMBOL}') AS sym FROM qs)),
mx AS (SELECT query_id, max(score) AS m FROM co GROUP BY query_id),
al AS (SELECT query_id, chunk_id, score, ord FROM co UNION ALL
SELECT query_id, chunk_id, NULL, 1000000000 + chunk_id FROM qa, kp WHERE CASE WHEN sym THEN leaf IN (ls, replace(ls, '_', ''), regexp_replace(ls, 's+$', ''), regexp_replace(replace(ls, '_', ''), 's+$', ''))
ELSE len(list_filter(names, lambda n: ls = lower(n) OR replace(ls, '_', '') = lower(n) OR (length(ls) >= 4 AND starts_with(lower(n), ls)) OR (length(replace(ls, '_', '')) >= 4 AND starts_with(lower(n), replace(ls, '_', ''))))) > 0 END AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM co)),
tr AS (SELECT query_id, chunk_id, file_path, alpha, ord, score, m, CASE WHEN {_DEFINES} THEN unit * m * CASE WHEN {_HOME} THEN 1.5 ELSE 1.0 END ELSE 0 END AS tier, CASE WHEN len(words) > 0 THEN {_NEAR} / len(words) ELSE 0 END AS ratio FROM al JOIN qa USING (query_id) JOIN kp USING (chunk_id) JOIN mx USING (query_id)),
bo AS (SELECT query_id, chunk_id, file_path, alpha, ord, CASE WHEN score IS NULL THEN tier ELSE score + tier + CASE WHEN ratio >= 0.1 THEN m * ratio ELSE 0 END END AS score FROM tr WHERE score IS NOT NULL OR tier > 0)"""
_RERANK = f"""pe AS (SELECT * REPLACE (score * CASE WHEN alpha < 1 THEN {_PENALTY} ELSE 1 END AS score) FROM (SELECT *, file_path AS p FROM bo)),
ef AS (SELECT *, score * power(0.5, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, ord) - 1) AS eff FROM pe),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, score DESC, ord) AS rank FROM ef)
SELECT query_id, chunk_id, round(eff, 9) AS score, rank::INTEGER AS rank FROM rk WHERE rank <= {K}"""

# parts as code, a part in forty asking; candidates are taken from the parts beside it by arithmetic
_NAME = "list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '')"
_CODE = rf"""pn AS (SELECT p_partkey::BIGINT AS k, p_name, lower(p_type) AS kind, {_NAME} AS camel, {_NAME} || p_partkey % 50 AS name, replace(p_name, ' ', '_') || '_' || p_partkey % 50 AS snake FROM part),
kc AS (SELECT k AS chunk_id, ['src/' || snake || '.py', 'src/' || kind || '/' || lower(name) || 's.rb', 'tests/test_' || snake || '.py', 'src/' || kind || '/util_' || k % 50 || '.py', 'examples/' || lower(name) || '.ts', 'types/' || lower(name) || '.d.ts', 'lib/' || lower(camel) || '.cs'][k % 7 + 1] AS file_path,
['class ' || name || ':' || chr(10) || '    pass', 'x = ' || name || '()', 'create table ' || name || ' (id int)', 'fn  base::' || name || '<T>'][k % 4 + 1] AS content FROM pn),
qs AS (SELECT *, CASE WHEN regexp_matches(query, '{text.SYMBOL}') THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS alpha FROM (SELECT k AS query_id, [name, 'Base::' || name, 'how does ' || name || ' work with ' || kind, p_name || ' of the ' || kind || ' tests'][(k // 40) % 4 + 1] AS query FROM pn WHERE k % 40 = 0)),
pr AS (SELECT query_id, chunk_id FROM qs JOIN kc ON chunk_id // 200 = query_id // 200),
sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id * 37 + query_id * 11) % 101 DESC, chunk_id) AS rank FROM pr WHERE (chunk_id * 13 + query_id) % 5 = 0) WHERE rank <= 20),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id * 53 + query_id * 5) % 97 DESC, chunk_id) AS rank FROM pr WHERE (chunk_id * 7 + query_id) % 3 = 0) WHERE rank <= 20),
fu AS (SELECT query_id, chunk_id, alpha * coalesce(1.0::DOUBLE / (60 + sm.rank), 0) + (1 - alpha) * coalesce(1.0::DOUBLE / (60 + lx.rank), 0) AS score, CASE WHEN sm.rank IS NOT NULL THEN sm.rank ELSE 100000 + lx.rank END AS ord FROM sm FULL JOIN lx USING (query_id, chunk_id) JOIN qs USING (query_id)),
fp AS (SELECT fu.*, file_path FROM fu JOIN kc USING (chunk_id)), {_COHERE}"""


def _code_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Semantic hits, lexical hits, queries and chunks."""
    own = views.code(spark, sf_dir)
    asked = own.where("query is not null").select(F.col("chunk_id").alias("query_id"), "query", text.alpha(F.col("query"), F.lit(None)).alias("alpha"))
    q, c = F.col("query_id"), F.col("chunk_id")
    pairs = asked.select(q, F.floor(q / 200).alias("near")).join(own.select(c, F.floor(c / 200).alias("near")), "near")
    semantic = sparse.top_k(pairs.where((c * 13 + q) % 5 == 0).select(q, c, ((c * 37 + q * 11) % 101).alias("score")), 20)
    lexical = sparse.top_k(pairs.where((c * 7 + q) % 3 == 0).select(q, c, ((c * 53 + q * 5) % 97).alias("score")), 20)
    return semantic, lexical, asked, own.drop("query")


def _code_boosts(spark: SparkSession, sf_dir: str, symbol: bool) -> DataFrame:
    semantic, lexical, asked, own = _code_hits(spark, sf_dir)
    fused = rank.coherence(rank.fuse(semantic, lexical, asked).join(own.select("chunk_id", "file_path"), "chunk_id"))
    kept = asked.where(text.is_symbol(F.col("query")) == symbol)
    return rank.boost(fused, kept, own).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@register(f"WITH {_CODE}, {_BOOST} SELECT query_id, chunk_id, round(score, 9) AS score FROM bo WHERE query_id IN (SELECT query_id FROM qa WHERE sym)")
def symbol_definition_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_boosts(spark, sf_dir, True)


@register(f"WITH {_CODE}, {_BOOST} SELECT query_id, chunk_id, round(score, 9) AS score FROM bo WHERE query_id IN (SELECT query_id FROM qa WHERE NOT sym)")
def embedded_symbol_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_boosts(spark, sf_dir, False)


@register(f"WITH {_CODE}, {_BOOST}, {_RERANK}")
def hybrid_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.hybrid(*_code_hits(spark, sf_dir), K).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


_ASKED_OF = "kc AS (SELECT chunk_id, file_path, content FROM c), qs AS (SELECT item_id::BIGINT AS query_id, text AS query, 0.5::DOUBLE AS alpha FROM benchmark)"


@register(f"WITH {_HITS}, {_COHERE}, {_ASKED_OF}, {_BOOST}, {_RERANK}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.hybrid(*_fused(spark, sf_dir), K)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _ablation(alpha: float) -> str:
    halves = "0.5 * coalesce(1.0::DOUBLE / (60 + sm.rank), 0) + 0.5 * coalesce"
    sql = ORACLES["hybrid_search"].replace("0.5::DOUBLE AS alpha FROM benchmark", f"{alpha}::DOUBLE AS alpha FROM benchmark")
    return sql.replace(halves, halves.replace("0.5 * coalesce(1.0", f"{alpha}::DOUBLE * coalesce(1.0").replace("+ 0.5", f"+ {1 - alpha}::DOUBLE"))


@register(_ablation(0.0))
def ablation_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic, lexical, asked, own = _fused(spark, sf_dir)
    return rank.hybrid(semantic, lexical, asked.withColumn("alpha", F.lit(0.0)), own, K).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@register(_ablation(1.0))
def ablation_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic, lexical, asked, own = _fused(spark, sf_dir)
    return rank.hybrid(semantic, lexical, asked.withColumn("alpha", F.lit(1.0)), own, K).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


# --- evaluation: a document is relevant to a benchmark passage if it has any eight consecutive words of it

RUN = 8
_RUNS = r"SELECT {0} AS id, array_to_string(w[i : i + 7], ' ') AS r FROM (SELECT {0}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {0}, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {1}) WHERE len(w) >= 8)"
_RELEVANT = f"r AS (SELECT DISTINCT b.id::BIGINT AS query_id, d.id AS chunk_id FROM ({_RUNS.format('item_id', 'benchmark')}) b JOIN ({_RUNS.format('doc_id', 'documents')}) d USING (r))"


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda: evaluate.sharing(views.chunks(spark, sf_dir), views.queries(spark, sf_dir), RUN)
    return _kept(spark, sf_dir, "relevant", lambda path: store.written(found(), path))


@register(f"WITH {_CHUNKS}, {_RELEVANT} SELECT query_id, chunk_id FROM r")
def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevant(spark, sf_dir)


@register(f"WITH {_BM25}, {_RELEVANT}, t AS (SELECT * FROM ({_TOP}) WHERE rank <= {K}), g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM t JOIN r USING (query_id, chunk_id) GROUP BY query_id), m AS (SELECT query_id, count(*) AS n FROM r GROUP BY query_id) SELECT query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least({K}, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM m LEFT JOIN g USING (query_id)")
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = _relevant(spark, sf_dir)
    hits = sparse.search(_index(spark, sf_dir), views.queries(spark, sf_dir), K).join(relevant, ["query_id", "chunk_id"])
    return evaluate.ndcg(hits, relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant")), K).select("query_id", r6("ndcg").alias("ndcg"))


_CURVE = f"""{_BM25}, {_RELEVANT}, t AS (SELECT query_id, chunk_id, rank, len(tokens) AS tok, r.chunk_id IS NOT NULL AS hit FROM ({_TOP}) JOIN k USING (chunk_id) LEFT JOIN r USING (query_id, chunk_id) WHERE rank <= 50),
pt AS (SELECT query_id, rank, sum(tok) OVER z AS cum, sum(hit::INTEGER) OVER z AS cov FROM t WINDOW z AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)), m AS (SELECT query_id, count(*) AS n FROM r GROUP BY query_id)"""


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    relevant = _relevant(spark, sf_dir)
    index = _index(spark, sf_dir)
    found = sparse.search(index, views.queries(spark, sf_dir), 50, dl=True).withColumnRenamed("dl", "tokens")
    marked = found.join(relevant.withColumn("target_id", F.col("chunk_id")), ["query_id", "chunk_id"], "left")
    return evaluate.curves(marked), relevant.groupBy("query_id").agg(F.count("*").alias("n_targets"))


@register(f"WITH {_CURVE}, e AS (SELECT budget, m.query_id, n, max(CASE WHEN cum <= budget THEN cov END) AS c FROM m, (SELECT unnest({list(evaluate.BUDGETS)!r}) AS budget) LEFT JOIN pt ON pt.query_id = m.query_id GROUP BY ALL) SELECT budget, round(avg(coalesce(c, 0) / n), 6) AS recall FROM e GROUP BY budget")
def recall_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_at_budgets(*_points(spark, sf_dir)).select("budget", r6("recall").alias("recall"))


@register(f"WITH {_CURVE} SELECT m.query_id, coalesce(min(CASE WHEN cov > 0 THEN cum END), 32000)::BIGINT AS tokens FROM m LEFT JOIN pt ON pt.query_id = m.query_id GROUP BY m.query_id")
def tokens_to_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tokens_to_first_hit(*_points(spark, sf_dir))


_GREP = """m AS (SELECT pattern, file_path, count(*) AS n FROM l JOIN (SELECT DISTINCT pattern FROM p) ON contains(l, pattern) GROUP BY ALL),
t AS (SELECT pattern, file_path, n, coalesce(sum(n) OVER (PARTITION BY pattern ORDER BY file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m)
SELECT query_id, file_path, sum(least(n, 500 - b))::BIGINT AS n FROM p JOIN t USING (pattern) WHERE b < 500 GROUP BY ALL"""
_LINE = "l AS (SELECT file_path, unnest(string_split(lower(content), chr(10))) AS l FROM c)"


@register(f"WITH {_CHUNKS}, {_LINE}, p AS (SELECT item_id::BIGINT AS query_id, lower(text) AS pattern FROM benchmark WHERE text IS NOT NULL), {_GREP}")
def grep_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.grep(views.chunks(spark, sf_dir), views.queries(spark, sf_dir).withColumnRenamed("query", "pattern"))


@register("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda x: r6(F.expr(f"percentile(value, {x})"))
    return views.table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


_GREP_WORDS = f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(q, ''), '[a-zA-Z][a-zA-Z0-9]*'), lambda w: lower(w)), lambda w: length(w) >= 3 AND NOT list_contains({sorted({*text.STOPWORDS, *text.GREP_STOPWORDS})!r}, w)))"


@register(f"SELECT item_id, len(w)::BIGINT AS n, md5(array_to_string(list_sort(w), ' ')) AS words FROM (SELECT item_id, {_GREP_WORDS} AS w FROM (SELECT item_id, text AS q FROM benchmark))")
def keywords_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.sort_array(text.grep_keywords(F.col("text")))
    return views.table(spark, sf_dir, "benchmark").select("item_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("words"))


@register(f"""WITH {_CHUNKS}, {_LINE}, q AS (SELECT item_id::BIGINT AS query_id, text AS q FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT query_id, unnest(CASE WHEN len({_GREP_WORDS}) > 0 THEN {_GREP_WORDS} ELSE [lower(q)] END) AS pattern FROM q), {_GREP}""")
def grep_keyword_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.grep_keywords(views.chunks(spark, sf_dir), views.queries(spark, sf_dir))


@register(f"WITH {_BM25}, {_RELEVANT}, t AS (SELECT * FROM ({_TOP}) WHERE rank <= {K}) SELECT query_id, chunk_id AS target_id, rank::INTEGER AS rank FROM r LEFT JOIN t USING (query_id, chunk_id)")
def target_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.chunks(spark, sf_dir)
    found = sparse.search(_index(spark, sf_dir), views.queries(spark, sf_dir), K).join(own.select("chunk_id", "file_path"), "chunk_id").withColumns({"start_line": F.lit(1), "end_line": F.lit(1)})
    none = F.lit(None).cast("int")
    wanted = _relevant(spark, sf_dir).select("query_id", F.col("chunk_id").alias("target_id"), F.concat(F.lit("doc_"), F.col("chunk_id"), F.lit(".txt")).alias("path"), none.alias("first_line"), none.alias("last_line"))
    return evaluate.target_ranks(found, wanted)


_SCORED = "s AS (SELECT source AS repo, lang AS language, CASE WHEN n_chars < 500 THEN 'symbol' ELSE 'semantic' END AS category, (n_chars % 100) / 100.0::DOUBLE AS ndcg FROM documents)"


@register(f"""WITH {_SCORED}, r AS (SELECT repo, language, avg(ndcg) AS m FROM s GROUP BY ALL), c AS (SELECT repo, category, avg(ndcg) AS m FROM s GROUP BY ALL)
SELECT level, name, round(avg(m), 6) AS mean FROM (SELECT 'repo' AS level, repo AS name, m FROM r UNION ALL SELECT 'language', language, m FROM r UNION ALL SELECT 'category', category, m FROM c UNION ALL SELECT 'all', 'all', m FROM r) GROUP BY ALL""")
def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    scored = views.table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("language"), F.when(n < 500, "symbol").otherwise("semantic").alias("category"), ((n % 100) / 100.0).alias("ndcg"))
    return evaluate.macro_means(scored).select("level", "name", r6("mean").alias("mean"))


@register("SELECT event_type AS mode, round(avg(value), 6) AS ndcg, round(avg(value * 2), 6) AS p50 FROM events GROUP BY event_type")
def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("ndcg"), (F.col("value") * 2).alias("p50_ms"))
    return evaluate.mode_summary(e).select("mode", r6("ndcg").alias("ndcg"), r6("p50").alias("p50"))


@register("""WITH p AS (SELECT nullif(n_chars % 97, 0) AS a, n_chars % 101 AS b FROM documents), k AS (SELECT a, b, a / b AS s FROM p WHERE a IS NOT NULL AND b > 0)
SELECT count(*)::BIGINT AS n_paired, median(a)::DOUBLE AS median_ours, median(b)::DOUBLE AS median_other, round(1 - median(s), 6) AS median_reduction, round(1 - avg(s), 6) AS mean_reduction, round(avg((a < b)::INTEGER), 6) AS better_share FROM k""")
def token_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "n_chars")
    ours, other = d.select("query_id", F.nullif(F.col("n_chars") % 97, F.lit(0)).alias("tokens")), d.select("query_id", (F.col("n_chars") % 101).alias("tokens"))
    return evaluate.reductions(ours, other).select("n_paired", "median_ours", "median_other", *[r6(c).alias(c) for c in ("median_reduction", "mean_reduction", "better_share")])


# --- index and formatting


@register("SELECT lang AS language, count(*)::BIGINT AS n_chunks, count(DISTINCT source || '/' || doc_id)::BIGINT AS n_files FROM documents GROUP BY lang")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"))


@register(rf"""WITH {_BM25}, t AS (SELECT * FROM ({_TOP}) WHERE rank <= 3), f AS (SELECT query_id, rank, '## ' || rank || '. ' || file_path || ':1-1  [score=' || printf('%.3f', score) || ']' || chr(10) || '```' || chr(10) || regexp_replace(content, '^\s+|\s+$', '', 'g') || chr(10) || '```' || chr(10) AS x FROM t JOIN c USING (chunk_id))
SELECT query_id, md5('Results' || chr(10) || chr(10) || string_agg(x, chr(10) ORDER BY rank)) AS digest FROM f GROUP BY query_id""")
def format_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.render import rendered

    own = views.chunks(spark, sf_dir).withColumns({"start_line": F.lit(1), "end_line": F.lit(1)})
    asked = views.queries(spark, sf_dir)
    hits = sparse.search(_index(spark, sf_dir), asked, 3)
    found = own.join(F.broadcast(hits) if 3 * asked.count() <= sparse.HITS_SENT else hits, "chunk_id")  # texts stay where they are read
    return rendered(found, "Results").select("query_id", F.md5("rendered").alias("digest"))


# --- change events


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first_change, floor(epoch(max(ts)))::BIGINT AS last_change, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts")
    out = watch.bursts(e, "1 hour")
    return out.select(F.col("path").alias("user_id"), F.unix_timestamp("first_change").alias("first_change"), F.unix_timestamp("last_change").alias("last_change"), "n")


@register("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY event_type")
def exclude_newer_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    cut = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("cut"))
    return e.join(F.broadcast(cut)).where("ts <= cut").groupBy("event_type").agg(F.count("*").alias("n"))
