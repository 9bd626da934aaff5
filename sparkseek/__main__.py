"""Command line: search, find-related, savings, init, download-model, serve."""

from __future__ import annotations

import argparse
import os
import sys

AGENT = """# Code search

Run `python -m sparkseek search "<what you look for>" <path>` to find code by meaning or by symbol, and
`python -m sparkseek find-related <file> <line> <path>` for code like that at a line.
"""


def _index(path: str, ref: str | None = None):
    from pyspark.sql import SparkSession

    from .functions.text import GIT_URL
    from .index import Index
    from .sources import models

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    encoder = models.load() if os.environ.get("SPARKSEEK_MODEL") else None
    import re

    return Index.from_git(spark, path, ref, encoder=encoder) if re.match(GIT_URL, path) else Index.from_path(spark, path, encoder=encoder)


def main(args: list[str] | None = None, build=_index, out=print) -> int:
    parser = argparse.ArgumentParser(prog="sparkseek")
    verbs = parser.add_subparsers(dest="verb", required=True)
    search = verbs.add_parser("search")
    search.add_argument("query")
    search.add_argument("path", nargs="?", default=".")
    search.add_argument("-k", "--top-k", type=int, default=5)
    search.add_argument("--mode", default=None, choices=("hybrid", "semantic", "bm25"))
    related = verbs.add_parser("find-related")
    related.add_argument("file")
    related.add_argument("line", type=int)
    related.add_argument("path", nargs="?", default=".")
    related.add_argument("-k", "--top-k", type=int, default=5)
    savings = verbs.add_parser("savings")
    savings.add_argument("path", nargs="?", default=".")
    init = verbs.add_parser("init")
    init.add_argument("--force", action="store_true")
    init.add_argument("--file", default="AGENTS.md")
    download = verbs.add_parser("download-model")
    download.add_argument("url", help="where tokenizer.json, model.safetensors and config.json are")
    download.add_argument("folder")
    serve = verbs.add_parser("serve")
    serve.add_argument("path", nargs="?")
    serve.add_argument("--ref")
    a = parser.parse_args(args)
    if a.verb == "download-model":
        from .sources import models

        try:
            out(f"{len(models.download(a.url, a.folder))} files fetched to {a.folder}")
        except OSError as e:
            print(f"Download failed: {e}", file=sys.stderr)
            return 1
        return 0
    if a.verb == "serve":
        from .service import Service

        Service(build, a.path, a.ref).serve()
        return 0
    if a.verb == "init":
        if os.path.exists(a.file) and not a.force:
            print(f"{a.file} already exists", file=sys.stderr)
            return 1
        with open(a.file, "w", encoding="utf-8") as f:
            f.write(AGENT)
        return 0
    index = build(a.path)
    if a.verb == "savings":
        from pyspark.sql import functions as F

        from .functions.text import tokenize

        row = index.chunks.agg(F.count("*").alias("c"), F.countDistinct("file_path").alias("f"), F.sum(F.size(tokenize(F.col("content")))).alias("t")).first()
        out(f"{row['f']} files, {row['c']} chunks, {row['t']} tokens")
        return 0
    if a.verb == "search":
        results = index.search(a.query, a.top_k, a.mode or ("hybrid" if index.encoder else "bm25"))
        header = f"Results for {a.query!r}"
        none = "No results found"
    else:
        chunk = index.resolve(a.file, a.line)
        if chunk is None:
            print(f"No chunk found at {a.file}:{a.line}", file=sys.stderr)
            return 1
        results, header, none = index.find_related(chunk, a.top_k), f"Related to {a.file}:{a.line}", "No related chunks found"
    out(index.format(results, header) if results.limit(1).count() else none)
    return 0


if __name__ == "__main__":
    sys.exit(main())
