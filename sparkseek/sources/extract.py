"""Text of binary documents, by the first backend that is there."""

from __future__ import annotations

import functools
import os
import shutil
import subprocess
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
Extractor = Callable[[str], tuple[str, str]]


def _level(style: str) -> int:
    if style.startswith("Heading") and style[7:].isdigit() and 1 <= int(style[7:]) <= 6:
        return int(style[7:])
    return {"Title": 1, "Subtitle": 2}.get(style, 0)


def _inline(node: ElementTree.Element) -> str:
    marks = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}
    return "".join((x.text or "") if x.tag == W + "t" else marks.get(x.tag, "") for x in node.iter())


def docx(path: str) -> tuple[str, str]:
    """(markdown, "markdown") of a DOCX file: heading styles become #, tables are read row by row."""
    try:
        with zipfile.ZipFile(path) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"not a DOCX file: {path}") from e
    out = []
    for block in body if body is not None else ():
        if block.tag == W + "p":
            style = block.find(f"{W}pPr/{W}pStyle")
            level = _level(style.get(W + "val", "") if style is not None else "")
            if text := _inline(block).strip():
                out.append("#" * level + " " * bool(level) + text)
        elif block.tag == W + "tbl":
            out += [" | ".join(_inline(c).strip() for c in row.iter(W + "tc")) for row in block.iter(W + "tr")]
    return "\n\n".join(out) + "\n" * bool(out), "markdown"


@functools.cache
def _there(tool: str) -> bool:
    return shutil.which(tool) is not None


def _run(*command: str) -> str:
    done = subprocess.run(command, capture_output=True, timeout=60)
    if done.returncode:
        raise ValueError(f"{command[0]} failed: {done.stderr.decode(errors='replace')[:500]}")
    return done.stdout.decode("utf-8", "replace")


def pdf(path: str) -> tuple[str, str]:
    """(text with form feeds between pages, "pdf")."""
    return _run("pdftotext", "-layout", "-enc", "UTF-8", path, "-").removesuffix("\f"), "pdf"


def markitdown(path: str) -> tuple[str, str]:
    return _run("markitdown", path), "markdown"


BACKENDS: dict[str, list[tuple[Callable[[], bool], Extractor]]] = {
    ".pdf": [(lambda: _there("pdftotext"), pdf), (lambda: _there("markitdown"), markitdown)],
    ".docx": [(lambda: _there("markitdown"), markitdown), (lambda: True, docx)],
    ".xlsx": [(lambda: _there("markitdown"), markitdown)],
    ".pptx": [(lambda: _there("markitdown"), markitdown)],
}


def known(path: str) -> bool:
    """Whether the file's extension has backends, there or not."""
    return os.path.splitext(path)[1].lower() in BACKENDS


def extractor(path: str) -> Extractor | None:
    """The first available backend for the file's extension, in any case; None if there is none."""
    return next((f for there, f in BACKENDS.get(os.path.splitext(path)[1].lower(), ()) if there()), None)
