"""Evaluation of rankings: NDCG, target ranks, recall within a token budget, and a grep baseline."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grep_keywords as grep_words
from ..plans.views import WORD, windows

MOST_MATCHES = 500
BUDGETS = (500, 1000, 2000, 4000, 8000, 16000, 32000)
CAP = 32000
WINDOWS_SENT = 200_000  # windows of queries that are sent to every executor at most; more are joined by a shuffle
ROWS_OUT = 50_000  # rows that a task holds in Python before they go on


def category(query: Column) -> Column:
    return F.when(~F.contains(query, F.lit(" ")), "symbol").when(F.startswith(F.lower(query), F.lit("how ")), "architecture").otherwise("semantic")


def path_matches(a: Column, b: Column) -> Column:
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def overlaps(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Whether lines start-end touch first-last; a target without lines is its whole file."""
    return first.isNull() | ~((end < first) | (start > last))


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) for every query of `relevant` (query_id, n_relevant); ranked has the ranks of relevant results."""
    gain = ranked.where(F.col("rank") <= k).select("query_id", "rank").distinct().groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return relevant.join(gain, "query_id", "left").select("query_id", F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / best).otherwise(0.0).alias("ndcg"))


def curves(results: DataFrame) -> DataFrame:
    """Running sums of tokens and covered targets; results: query_id, rank, tokens, target_id (null: none)."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("query_id", "target_id").orderBy("rank")) == 1
    once = results.withColumn("_c", (F.col("target_id").isNotNull() & first).cast("int"))
    return once.select("query_id", "rank", F.sum("tokens").over(w).alias("cum_tokens"), F.sum("_c").over(w).alias("covered"))


def recall_at_budgets(points: DataFrame, targets: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(budget, recall): mean over queries with targets (query_id, n_targets) of the share covered within the budget."""
    each = targets.where("n_targets > 0").select("query_id", "n_targets", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"))
    reached = each.join(points, "query_id", "left").groupBy("query_id", "budget").agg(F.max("n_targets").alias("n"), F.max(F.when(F.col("cum_tokens") <= F.col("budget"), F.col("covered"))).alias("c"))
    return reached.groupBy("budget").agg(F.avg(F.coalesce("c", F.lit(0)) / F.col("n")).alias("recall"))


def tokens_to_first_hit(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, tokens): what is read until a target is covered; a query without a hit costs the cap."""
    hit = points.where("covered > 0").groupBy("query_id").agg(F.min("cum_tokens").alias("t"))
    return targets.where("n_targets > 0").join(hit, "query_id", "left").select("query_id", F.coalesce("t", F.lit(CAP)).cast("long").alias("tokens"))


def sharing(texts: DataFrame, queries: DataFrame, n: int, sent: int = WINDOWS_SENT) -> DataFrame:
    """(query_id, chunk_id), once each, of texts (chunk_id, content) that have any n consecutive words of a query (query_id, query).

    Windows of a bounded set of queries are looked up where the texts are read, after their first two words; nothing but hits is shuffled.
    """
    asked = windows(queries, "query_id", "query", n)
    if n < 2 or asked.count() > sent:
        return windows(texts, "chunk_id", "content", n).join(asked, "window").select("query_id", "chunk_id").distinct()
    known: dict[str, list[int]] = defaultdict(list)
    for r in asked.toLocalIterator():
        known[r["window"]].append(r["query_id"])
    shared = texts.sparkSession.sparkContext.broadcast((dict(known), {tuple(w.split(" ", 2)[:2]) for w in known}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, starts), words_of = shared.value, re.compile(WORD).findall
        made = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["query_id", "chunk_id"])
        for batch in batches:
            out: list[tuple[int, int]] = []
            for chunk, content in zip(batch.column("chunk_id").to_pylist(), batch.column("content"), strict=True):
                words = words_of(content.as_py() or "")
                at = [i for i, two in enumerate(zip(words, words[1:], strict=False)) if two in starts]
                out += [(q, chunk) for q in {q for i in at for q in known.get(" ".join(words[i : i + n]), ())}]
                if len(out) >= ROWS_OUT:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return texts.select("chunk_id", "content").mapInArrow(run, "query_id long, chunk_id long").distinct()


def matching_lines(files: DataFrame, patterns: DataFrame, text: str = "content", block: int = 50_000, rows_out: int = ROWS_OUT) -> DataFrame:
    """(pattern, file_path, n) of the lines that contain each pattern (column pattern, lower-case) anywhere, in any case.

    Patterns are a query set; in blocks, one automaton holds them all, and every text runs through it once where it is read.
    """
    spark = files.sparkSession
    own = files.select("file_path", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows, found = patterns.select("pattern").distinct().toLocalIterator(), None
    while part := [r["pattern"] for _, r in zip(range(block), rows)]:  # noqa: B905
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine, everywhere = ahocorasick.Automaton(), ""
            for p in filter(None, shared.value):
                machine.add_word(p, p)
            machine.make_automaton()
            search = machine.iter if len(machine) else lambda line: ()
            everywhere_too = everywhere in shared.value

            def made(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["pattern", "file_path", "n"])

            for batch in batches:
                out: list[tuple[str, str, int]] = []
                for path, content in zip(batch.column("file_path"), batch.column("text"), strict=True):
                    lines, count = content.as_py().split("\n"), Counter()
                    for line in lines:
                        count.update({p for _, p in search(line)})
                    if everywhere_too:
                        count[everywhere] = len(lines)
                    name = path.as_py()
                    out += [(p, name, n) for p, n in count.items()]
                    if len(out) >= rows_out:
                        yield made(out)
                        out = []
                if out:
                    yield made(out)

        hits = own.mapInArrow(run, "pattern string, file_path string, n long")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], "pattern string, file_path string, n long")


def _first(matches: DataFrame, most: int) -> DataFrame:
    """The first `most` matching lines of each pattern in order of path; every file has one at least, so `most` files hold them."""
    files = matches.groupBy("pattern", "file_path").agg(F.sum("n").alias("n"))
    path = Window.partitionBy("pattern").orderBy("file_path")
    few = files.withColumn("_r", F.row_number().over(path)).where(F.col("_r") <= most)
    before = F.coalesce(F.sum("n").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("_b", before).where(F.col("_b") < most).select("pattern", "file_path", F.least(F.col("n"), most - F.col("_b")).alias("n"))


def grep(files: DataFrame, patterns: DataFrame, most: int = MOST_MATCHES, text: str = "content") -> DataFrame:
    """(query_id, file_path, n) of lines that contain the whole pattern in any case, `most` of them in order of path; patterns: query_id, pattern."""
    asked = patterns.select("query_id", F.lower("pattern").alias("pattern")).where("pattern is not null")
    return asked.join(_first(matching_lines(files, asked, text), most), "pattern").groupBy("query_id", "file_path").agg(F.sum("n").alias("n"))


def target_ranks(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_id, rank): the first result that covers each target; null if none does.

    results: query_id, rank, file_path, start_line, end_line; targets: query_id, target_id, path, first_line, last_line
    (null: the whole file).
    """
    same = (results["query_id"] == targets["query_id"]) & path_matches(F.replace(results["file_path"], F.lit("\\"), F.lit("/")), F.replace(targets["path"], F.lit("\\"), F.lit("/")))
    covered = same & overlaps(results["start_line"], results["end_line"], targets["first_line"], targets["last_line"])
    return targets.join(results, covered, "left").groupBy(targets["query_id"], "target_id").agg(F.min("rank").alias("rank"))


def macro_means(scored: DataFrame, value: str = "ndcg") -> DataFrame:
    """(level, name, mean): by repository, by language and overall as means of repositories' means, by category as means of repositories' means of it.

    scored: repo, language, category and the value, a row a query.
    """
    by_repo = scored.groupBy("repo", "language").agg(F.avg(value).alias("m"))
    by_category = scored.groupBy("repo", "category").agg(F.avg(value).alias("m"))
    level = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.avg("m").alias("mean")).select(F.lit(kind).alias("level"), "name", "mean")
    parts = [level(by_repo, "repo", F.col("repo")), level(by_repo, "language", F.col("language")), level(by_category, "category", F.col("category")), level(by_repo, "all", F.lit("all"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mode_summary(scored: DataFrame) -> DataFrame:
    """(mode, ndcg, p50) of results in several modes: mean NDCG and mean median latency; scored: mode, ndcg, p50_ms."""
    return scored.groupBy("mode").agg(F.avg("ndcg").alias("ndcg"), F.avg("p50_ms").alias("p50"))


def reductions(ours: DataFrame, other: DataFrame) -> DataFrame:
    """One row: how many fewer tokens until the first hit, over queries where both hit; both: query_id, tokens (null: no hit)."""
    pairs = ours.select("query_id", F.col("tokens").alias("a")).join(other.select("query_id", F.col("tokens").alias("b")), "query_id").where("a is not null and b > 0")
    share = F.col("a") / F.col("b")
    return pairs.agg(
        F.count("*").alias("n_paired"), F.percentile("a", 0.5).alias("median_ours"), F.percentile("b", 0.5).alias("median_other"),
        (1 - F.percentile(share, 0.5)).alias("median_reduction"), (1 - F.avg(share)).alias("mean_reduction"), F.avg((F.col("a") < F.col("b")).cast("double")).alias("better_share"),
    )


def grep_keywords(files: DataFrame, queries: DataFrame, most: int = MOST_MATCHES, text: str = "content") -> DataFrame:
    """(query_id, file_path, n) of the keyword baseline: matching lines of each keyword, `most` of them in order of path, added up.

    A query without keywords is searched for as a whole. queries: query_id, query; a bounded set.
    """
    words = grep_words(F.col("query"))
    asked = queries.where("query is not null").select("query_id", F.explode(F.when(F.size(words) > 0, words).otherwise(F.array(F.lower("query")))).alias("pattern"))
    return asked.join(_first(matching_lines(files, asked, text), most), "pattern").groupBy("query_id", "file_path").agg(F.sum("n").alias("n"))
