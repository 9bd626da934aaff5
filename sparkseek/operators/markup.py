"""Chunkers that follow a file's structure: markdown sections, and the members of C-like code.

Both yield (start_line, end_line, heading path) of lines counted from 1; they run inside Arrow batches.
Code members are found by matching braces outside strings and comments, without a full parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET, LINES, OVERLAP = 1500, 50, 5
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(```+|~~~+)")
Piece = tuple[int, int, tuple[str, ...]]


def windows(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Overlapping line windows of start-end."""
    while True:
        yield start, min(end, start + LINES - 1)
        if start + LINES - 1 >= end:
            return
        start += LINES - OVERLAP


def _cost(lines: list[str], start: int, end: int) -> int:
    return sum(len(x.encode("utf-16-le")) // 2 + 1 for x in lines[start - 1 : end])


def sections(lines: list[str]) -> Iterator[Piece]:
    """The runs of lines under one heading; # inside a fence is no heading."""
    path: list[tuple[int, str]] = []
    fence, start = None, 1
    for n, line in enumerate(lines, 1):
        if m := FENCE.match(line):
            if fence is None:
                fence = m[1][0]
            elif m[1][0] == fence:
                fence = None
        elif fence is None and (m := HEADING.match(line)):
            if n > start:
                yield start, n - 1, tuple(t for _, t in path)
            path = [(d, t) for d, t in path if d < len(m[1])] + [(len(m[1]), (m[2] or "").strip())]
            start = n
    if lines:
        yield start, len(lines), tuple(t for _, t in path)


def _paragraphs(lines: list[str], start: int, end: int) -> Iterator[tuple[int, int]]:
    first = None
    for n in range(start, end + 1):
        blank = not lines[n - 1].strip()
        if not blank and first is None:
            first = n
        if first is not None and (blank or n == end):
            yield first, n - 1 if blank else n
            first = None


def markdown(text: str) -> list[Piece]:
    """Sections; neighbours with one path merge within the budget; larger ones go by paragraphs, larger paragraphs by windows."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
    merged: list[Piece] = []
    for a, b, path in sections(lines):
        if merged and merged[-1][2] == path and _cost(lines, merged[-1][0], b) <= BUDGET:
            merged[-1] = merged[-1][0], b, path
        else:
            merged.append((a, b, path))
    out: list[Piece] = []
    for a, b, path in merged:
        if _cost(lines, a, b) <= BUDGET:
            out.append((a, b, path))
            continue
        now: list[int] = []
        for x, y in _paragraphs(lines, a, b):
            size = _cost(lines, x, y)
            if now and now[2] + size <= BUDGET:
                now = [now[0], y, now[2] + size]
                continue
            if now:
                out.append((now[0], now[1], path))
                now = []
            if size <= BUDGET:
                now = [x, y, size]
            else:
                out += [(s, e, path) for s, e in windows(x, y)]
        if now:
            out.append((now[0], now[1], path))
    return [(a, b, p) for a, b, p in out if any(x.strip() for x in lines[a - 1 : b])]


_QUIET = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)


def _members(code: str, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, body start, body end) of the statements and blocks directly in code[start:end]."""
    depth, at, body, i = 0, start, -1, start
    while i < end:
        c = code[i]
        if c == "{":
            depth += 1
            body = i + 1 if depth == 1 else body
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                stop = i + 1
                while stop < end and code[stop] in " \t;":
                    stop += 1
                yield at, stop, body, i
                at, i = stop, stop - 1
        elif c == ";" and not depth:
            yield at, i + 1, -1, -1
            at = i + 1
        i += 1


def code(text: str, budget: int = BUDGET, top: bool = False) -> list[Piece] | None:
    """Members up to the budget, neighbours merged within it; containers that exceed it are entered. None without any block.

    top: statements and directives of the file itself are members too (prototypes, aliases, globals, what follows the last block).
    """
    quiet = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    found: list[tuple[int, int]] = []
    work = [(0, len(text))]
    while work:
        a, b = work.pop()
        members = list(_members(quiet, a, b))
        rest = members[-1][1] if members else 0
        if top and not a and quiet[rest:].strip():
            members.append((rest, len(text), -1, -1))
        for x, y, inner, stop in members:
            x += len(quiet[x:y]) - len(quiet[x:y].lstrip())
            if inner < 0 and (top and not a or a and not re.match(r"\s*(?:using|#|namespace|import)", quiet[x:y])):
                found.append((x, y))
            elif inner >= 0:
                if y - x > budget and any(s >= 0 for _, _, s, _ in _members(quiet, inner, stop)):
                    work.append((inner, stop))
                else:
                    found.append((x, y))
    if not found:
        return None
    merged: list[tuple[int, int]] = []
    for x, y in sorted(found):
        if merged and y - merged[-1][0] <= budget:
            merged[-1] = merged[-1][0], y
        else:
            merged.append((x, y))
    line = lambda i: text.count("\n", 0, i) + 1
    return [(line(x), line(max(x, y - 1)), ()) for x, y in merged]


def pages(lines: list[str]) -> list[Piece]:
    """Line windows within pages, a form feed beginning a new one; the path holds the page's number."""
    out: list[Piece] = []
    page, first = 1, 1
    for n, line in enumerate([*lines, "\f"], 1):
        if turns := line.count("\f"):
            # a line that begins with the form feed belongs to the next page
            last = n - 1 if line.lstrip(" \t").startswith("\f") else n
            if first <= last and any(x.strip() for x in lines[first - 1 : last]):
                out += [(a, b, (str(page),)) for a, b in windows(first, last)]
            page, first = page + turns, last + 1
    return out


LOCATOR = "struct<kind:string,page_start:int,page_end:int,slide:int,sheet_name:string,cell_range:string,heading_path:array<string>>"
SCHEMA = f"start_line int, end_line int, content string, heading_path array<string>, locator {LOCATOR}"


def _locator(language: str | None, path: tuple[str, ...]) -> dict | None:
    if not path:
        return None
    paged = language == "pdf"
    page = int(path[0]) if paged else None
    return {"kind": "pages" if paged else "heading", "page_start": page, "page_end": page, "slide": None, "sheet_name": None, "cell_range": None, "heading_path": None if paged else list(path)}


def pieces_of(text: str, lines: list[str], kind: str | None) -> list[Piece]:
    """By structure where there is one, else by line windows."""
    found = pages(lines) if kind == "pdf" else markdown(text) if kind == "markdown" else code(text, top=kind == "cpp") if kind in ("csharp", "cpp") else None
    return found if found is not None else [(a, b, ()) for a, b in windows(1, len(lines))] if lines else []


def chunk(files: DataFrame) -> DataFrame:
    """Chunks of files (file_id, file_path, language, content; kind, if there, says how to cut instead of language)."""
    own = "file_id long, file_path string, language string"
    names = ["file_id", "file_path", "language", "start_line", "end_line", "content", "heading_path", "locator"]
    rows_of = files.withColumn("kind", F.coalesce("kind", "language") if "kind" in files.columns else F.col("language"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                text = f.content or ""
                lines = re.findall(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+", text)
                for a, b, path in pieces_of(text, lines, f.kind):
                    part = "".join(lines[a - 1 : b])
                    part = part.replace("\f", "") if f.kind == "pdf" else part
                    if part.strip():
                        rows.append((f.file_id, f.file_path, f.language, a, b, part, [] if f.kind == "pdf" else list(path), _locator(f.kind, path)))
            yield pd.DataFrame(rows, columns=names)

    return rows_of.select("file_id", "file_path", "language", "kind", "content").mapInPandas(run, f"{own}, {SCHEMA}")
