"""Fusion and re-ranking of candidates as window expressions.

Candidates are rows of query_id, chunk_id, file_path, score and ord, the order in which they were found (semantic hits
by rank, then further lexical hits by rank, then chunks that a symbol pulled in), which breaks ties. Each step reads its
candidates once, so that what found them runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files, text

RRF, COHERENCE, DEFINITION, EMBEDDED, STEM, RATIO, DECAY = 60, 0.2, 3.0, 0.5, 1.0, 0.10, 0.5
OWN_FILE = 1.5
LEAST_STEM = 4  # characters of a stem that an embedded symbol may begin with


def rrf(hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, rrf): 1 / (60 + rank)."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = hits.select("query_id", "chunk_id", F.row_number().over(w).alias("rank"))
    return ranked.withColumn("rrf", 1.0 / (RRF + F.col("rank")))


def order(first: int, by: Column) -> Column:
    return F.struct(F.lit(first).alias("a"), by.cast("long").alias("b"))


def fuse(semantic: DataFrame, lexical: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, ord) of both rankings' hits; queries has query_id and alpha, the semantic weight."""
    none = F.lit(None).cast("int")
    s = rrf(semantic).select("query_id", "chunk_id", F.col("rank").alias("sr"), none.alias("br"))
    b = rrf(lexical).select("query_id", "chunk_id", none.alias("sr"), F.col("rank").alias("br"))
    both = s.unionByName(b).groupBy("query_id", "chunk_id").agg(F.max("sr").alias("sr"), F.max("br").alias("br")).join(queries.select("query_id", "alpha"), "query_id")
    part = lambda rank: F.coalesce(1.0 / (RRF + F.col(rank)), F.lit(0.0))
    score = F.col("alpha") * part("sr") + (1 - F.col("alpha")) * part("br")
    return both.select("query_id", "chunk_id", score.alias("score"), F.when(F.col("sr").isNotNull(), order(0, F.col("sr"))).otherwise(order(1, F.col("br"))).alias("ord"))


def coherence(candidates: DataFrame) -> DataFrame:
    """The best chunk of each file gains a fifth of the query's best score, by the file's share of the largest file sum."""
    file = Window.partitionBy("query_id", "file_path")
    query = Window.partitionBy("query_id")
    summed = candidates.select("*", F.sum("score").over(file).alias("_f"), F.row_number().over(file.orderBy(F.col("score").desc(), "ord")).alias("_n"))
    scaled = summed.select("*", F.max("score").over(query).alias("_m"), F.max("_f").over(query).alias("_x"))
    gain = F.when((F.col("_n") == 1) & (F.col("_m") != 0), COHERENCE * F.col("_m") * F.col("_f") / F.col("_x")).otherwise(0.0)
    return scaled.withColumn("score", F.col("score") + gain).drop("_f", "_n", "_m", "_x")


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, symbol, words, names, unit, leaf): keywords, and the names whose definition counts, and how much."""
    q, symbol = F.col("query"), text.is_symbol(F.col("query"))
    full = F.array_distinct(F.array(text.symbol_leaf(q), text.trimmed(q)))
    return queries.select(
        "query_id", symbol.alias("symbol"), F.when(symbol, F.array().cast("array<string>")).otherwise(text.keywords(q)).alias("words"),
        F.when(symbol, full).otherwise(text.embedded_symbols(q)).alias("names"), F.when(symbol, DEFINITION).otherwise(DEFINITION * EMBEDDED).alias("unit"), F.lower(text.symbol_leaf(q)).alias("leaf"),
    )


def named(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, file_path) of chunks that define a symbol of the query in files whose stem is one; queries as given by asked.

    Stems are found by an equi-join on the few forms that match, and of chunks that define anything. A pair goes on only if the
    chunk defines a name of the query, so what many files of one stem and many queries of one name make isn't kept.
    """
    stem = F.lower(text.stem(F.col("file_path")))
    plain = F.replace(stem, F.lit("_"), F.lit(""))
    singular = lambda s: F.regexp_replace(s, "s+$", "")
    own = chunks.where(F.col("content").rlike(text.DEFINITION))
    forms = own.select("chunk_id", "file_path", "content", stem.alias("_stem"), plain.alias("_plain"), F.explode(F.array_distinct(F.array(stem, plain, singular(stem), singular(plain)))).alias("key"))
    low = F.transform("names", lambda n: F.lower(n))
    # an embedded symbol also matches stems that begin it
    starts = F.flatten(F.transform(low, lambda n: F.concat(F.array(n), F.transform(F.sequence(F.lit(LEAST_STEM), F.greatest(F.lit(LEAST_STEM), F.length(n))), lambda i: F.substring(n, F.lit(1), i)))))
    keys = queries.where(F.size("names") > 0).select("query_id", "symbol", "names", F.explode(F.array_distinct(F.when(F.col("symbol"), F.array("leaf")).otherwise(starts))).alias("key"))
    # once for each pair: a symbol has one key, another query's keys can equal the stem and its plain form
    begun = F.exists("names", lambda n: (F.lower(n) == F.col("_stem")) | ((F.length("_stem") >= LEAST_STEM) & F.startswith(F.lower(n), F.col("_stem"))))
    once = F.col("symbol") | (F.col("key") == F.col("_stem")) | ((F.col("key") == F.col("_plain")) & ~begun)
    said = F.exists("names", lambda n: F.contains(F.lower("content"), F.lower(n)) & text.defines(F.col("content"), n))
    return forms.join(keys, "key").where(once & said).select("query_id", "chunk_id", "file_path")


def boost(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates with the gains of their queries; chunks that define a symbol of the query in a file of its name come in.

    Every gain is a share of the query's best score before any of them. Symbols: what defines them gains, more so in a file of
    their name. Other queries: the share of their keywords that a path has, and symbols within the query.
    """
    q = asked(queries)
    pulled = named(q, chunks).select("query_id", "chunk_id", "file_path", F.lit(None).cast("double").alias("score"), order(2, F.col("chunk_id")).alias("ord"))
    both = candidates.select("query_id", "chunk_id", "file_path", "score", "ord").unionByName(pulled)
    # what paths say is made here, below the windows: within the lambdas it would be made again for every word
    both = both.withColumns({"_stem": F.lower(text.stem(F.col("file_path"))), "_parts": text.path_parts(F.col("file_path"))})
    query, one = Window.partitionBy("query_id"), Window.partitionBy("query_id", "chunk_id")
    rows = both.select("*", F.max("score").over(query).alias("_m"), F.max("score").over(one).isNotNull().alias("_c")).where("_m is not null and (score is not null or not _c)")
    rows = rows.join(q, "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")

    at_home = F.exists("names", lambda n: text.stem_matches(F.col("_stem"), F.lower(n)))
    defined = F.exists("names", lambda n: text.defines(F.col("content"), n))
    tier = F.when(defined, F.col("unit") * F.col("_m") * F.when(at_home, OWN_FILE).otherwise(1.0)).otherwise(0.0)
    ratio = text.keyword_matches(F.col("words"), F.col("_parts")) / F.size("words")
    path = F.when((F.size("words") > 0) & (ratio >= RATIO), F.col("_m") * STEM * ratio).otherwise(0.0)
    score = F.when(F.col("score").isNotNull(), F.col("score") + path + tier).otherwise(tier)
    return rows.withColumn("score", score).where("_c or score > 0").select("query_id", "chunk_id", "file_path", "score", "ord")


def rerank(candidates: DataFrame, k: int, penalise: Column | None = None) -> DataFrame:
    """The k best of each query after path penalties and saturation: a file's n-th chunk counts half of the one before.

    Visiting chunks by penalised score and halving for each earlier chunk of the file is row_number over the file.
    """
    factor = files.penalty(F.col("file_path"))
    factor = factor if penalise is None else F.when(penalise, factor).otherwise(1.0)
    rows = candidates.withColumn("_p", F.col("score") * factor)
    file = Window.partitionBy("query_id", "file_path").orderBy(F.col("_p").desc(), "ord")
    rows = rows.withColumn("score", F.col("_p") * F.pow(F.lit(DECAY), F.row_number().over(file) - 1))
    query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_p").desc(), "ord")
    return rows.withColumn("rank", F.row_number().over(query)).where(F.col("rank") <= k).drop("_p")


def hybrid(semantic: DataFrame, lexical: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, file_path, score, rank) from both rankings; queries: query_id, query, alpha in [0, 1]."""
    fused = fuse(semantic, lexical, queries).join(chunks.select("chunk_id", "file_path"), "chunk_id")
    marked = boost(coherence(fused), queries, chunks).join(queries.select("query_id", (F.col("alpha") < 1.0).alias("_q")), "query_id")
    return rerank(marked, k, F.col("_q")).select("query_id", "chunk_id", "file_path", "score", "rank")
