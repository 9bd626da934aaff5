"""Source trees: the walk on the driver, the contents on the executors."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import CODE, DOCUMENTS, IGNORED
from . import extract

MOST_BYTES = 1_000_000


class Ignores:
    """Rules of a root .gitignore; the last that matches decides. Brackets are literal."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in (x.rstrip() for x in lines):
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            body = line[keep:]
            folder = body.endswith("/")
            body = body.removesuffix("/")
            rooted = "/" in body
            self.rules.append((re.compile(("" if rooted else "(?:.*/)?") + self._glob(body.removeprefix("/"))), keep, folder))

    @staticmethod
    def _glob(body: str) -> str:
        signs = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        return "".join(signs.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body))

    def __call__(self, path: str) -> bool:
        """Whether a path relative to the root is ignored; a folder's ends with a slash."""
        folder, path = path.endswith("/"), path.strip("/")
        verdicts = [not keep for rule, keep, only in self.rules if (folder or not only) and rule.fullmatch(path)]
        return verdicts[-1] if verdicts else False


def walk(root: str, extensions: list[str] | None = None, documents: bool = False, ignore: tuple[str, ...] = (), newest: datetime | None = None) -> Iterator[str]:
    """Files under root in sorted order, a folder's own before those of its folders.

    Ignored folders aren't entered. Links to folders are followed if they lead inside the root, each real folder once.
    """
    top = os.path.realpath(root)
    wanted = {e.lower() for e in extensions} if extensions else {*CODE, *(DOCUMENTS if documents else ())}
    rules_file = os.path.join(top, ".gitignore")
    rules = Ignores(open(rules_file, encoding="utf-8", errors="replace").read().splitlines() if os.path.isfile(rules_file) else [])
    skipped = {*IGNORED, *ignore}
    stack, seen = [root], set()
    while stack:
        folder = stack.pop()
        real = os.path.realpath(folder)
        if real in seen:
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        inner = []
        for e in entries:
            own = os.path.relpath(e.path, root).replace(os.sep, "/")
            if e.is_dir():
                away = os.path.realpath(e.path)
                if e.name not in skipped and not rules(own + "/") and (away == top or away.startswith(top + os.sep)):
                    inner.append(e.path)
            elif os.path.splitext(e.name)[1].lower() in wanted and not rules(own):
                if newest is None or datetime.fromtimestamp(e.stat().st_mtime, UTC) <= newest:
                    yield e.path
        stack += reversed(inner)


def listing(spark: SparkSession, root: str, **options) -> DataFrame:
    """(file_id, path, file_path, length) of the files of the walk up to a million bytes."""
    rows = [(p, os.path.relpath(p, root).replace(os.sep, "/"), os.path.getsize(p)) for p in walk(root, **options)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows) if r[2] <= MOST_BYTES], "file_id long, path string, file_path string, length long")


def read(files: DataFrame) -> DataFrame:
    """files with content and kind, read on the executors; files that can't be opened for want of permission, or have gone, are left out.

    Their folder must be shared: a task that doesn't even see the folder of a file raises.

    Text is read leniently. Documents with an extractor give its text, and kind says how it is cut; those whose backend
    isn't there or fails are left out.
    """

    def content(path: str) -> tuple[str | None, str | None]:
        try:
            if extract.known(path):
                backend = extract.extractor(path)
                return backend(path) if backend else (None, None)
            with open(path, "rb") as f:
                return f.read().decode("utf-8-sig", "replace"), None
        except FileNotFoundError:
            if not os.path.isdir(os.path.dirname(path)):
                raise
            return None, None
        except (PermissionError, IsADirectoryError, ValueError, subprocess.SubprocessError):
            return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [content(p) for p in batch["path"]]
            yield batch.assign(content=[t for t, _ in found], kind=[k for _, k in found])

    schema = files.withColumns({"content": F.lit(None).cast("string"), "kind": F.lit(None).cast("string")}).schema
    return files.mapInPandas(run, schema).where("content is not null")


@contextmanager
def cloned(url: str, ref: str | None = None, timeout: int = 60, within: str | None = None) -> Iterator[str]:
    """A shallow clone in a folder that is deleted afterwards; within: a folder that the executors see too."""
    folder = tempfile.mkdtemp(dir=within)
    try:
        command = ["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, folder]
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout)
        if done.returncode:
            raise RuntimeError(f"git clone failed: {done.stderr.strip()}")
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)
