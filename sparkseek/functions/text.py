"""Text and path functions as Column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the engine's query language.
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
SYMBOL = r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$"
EMBEDDED = r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b"
STOPWORDS = "a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with".split()
GREP_STOPWORDS = """but its can not no nor so yet both either neither than then
will would could should may might been being had did will
they all any each few more most other some such only own same too very just
about after also before between during into through under up down over""".split()
DEFINES = (
    "class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "object",
    "abstract class", "data class", "fn", "fun", "package", "namespace", "protocol", "record", "typedef",
)
SQL_DEFINES = ("CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION")
DEFINITION = r"(?i)(?:" + "|".join((*DEFINES, *SQL_DEFINES)) + r")\s"  # what any definition has
GIT_URL = r"^(https?://|ssh://|git://|git\+ssh://|file://)|^[\w.-]+@[\w.-]+:(?!/)"
UNSAFE_URL = r"^(ssh://|file://|git\+ssh://)|^[\w.-]+@[\w.-]+:(?!/)"


def _pattern(text: str) -> Column:
    return F.lit(text)


def split_identifier(token: Column) -> Column:
    """[lower] + parts of a snake_case or camelCase identifier; [lower] alone if it has one part."""
    low = F.lower(token)
    snake = F.filter(F.split(low, "_"), lambda p: p != "")
    camel = F.transform(F.regexp_extract_all(token, _pattern(CAMEL), F.lit(0)), lambda p: F.lower(p))
    parts = F.when(F.contains(token, F.lit("_")), snake).otherwise(camel)
    # most tokens are plain words: the first test spares them the rest
    return F.when(token.rlike("^[A-Z]?[a-z]+$"), F.array(low)).when(F.size(parts) >= 2, F.concat(F.array(low), parts)).otherwise(F.array(low))


def tokenize(text: Column) -> Column:
    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), _pattern(TOKEN), F.lit(0)), split_identifier))


def counter() -> Callable[[str], Counter[str]]:
    """What counts the tokens of a text in Python: those of tokenize, in any order."""
    words, camel = re.compile(TOKEN).findall, re.compile(CAMEL).findall

    @lru_cache(100_000)
    def split(token: str) -> tuple[str, ...]:
        low = token.lower()
        parts = [p for p in low.split("_") if p] if "_" in token else [p.lower() for p in camel(token)]
        return (low, *parts) if len(parts) >= 2 else (low,)

    def count(text: str) -> Counter[str]:
        found = Counter(words(text))
        for token in [t for t in found if not (t.isalpha() and t.islower())]:
            n = found.pop(token)
            for part in split(token):
                found[part] += n
        return found

    return count


def keywords(query: Column) -> Column:
    """Distinct lower-case words over two characters that aren't stop words, in order."""
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), _pattern(TOKEN), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def grep_keywords(query: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), _pattern("[a-zA-Z][a-zA-Z0-9]*"), F.lit(0))
    stop = sorted({*STOPWORDS, *GREP_STOPWORDS})
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: (F.length(w) >= 3) & ~w.isin(stop)))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_symbol(query: Column) -> Column:
    return trimmed(query).rlike(SYMBOL)


def alpha(query: Column, given: Column) -> Column:
    """Weight of the semantic ranking: as given, else 0.3 for a symbol and 0.5 for other queries."""
    return F.coalesce(given.cast("double"), F.when(is_symbol(query), 0.3).otherwise(0.5))


def symbol_leaf(query: Column) -> Column:
    """What follows the last separator, of the first kind of separator that the query has."""
    out = trimmed(query)
    for separator in reversed(("::", "\\", "->", ".")):
        out = F.when(F.contains(query, F.lit(separator)), F.substring_index(query, separator, -1)).otherwise(out)
    return out


def embedded_symbols(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, _pattern(EMBEDDED), F.lit(0)))


def stem_matches(stem: Column, name: Column) -> Column:
    plain = F.replace(stem, F.lit("_"), F.lit(""))
    singular = lambda s: F.regexp_replace(s, "s+$", "")
    return (stem == name) | (plain == name) | (singular(stem) == name) | (singular(plain) == name)


def keyword_matches(words: Column, parts: Column) -> Column:
    """How many words equal a part, or start with or begin one, with three characters in common at least."""
    near = lambda w, p: (w == p) | ((F.least(F.length(w), F.length(p)) >= 3) & (F.startswith(w, p) | F.startswith(p, w)))
    return F.size(F.filter(words, lambda w: F.exists(parts, lambda p: near(w, p))))


def definition(name: Column) -> tuple[Column, Column]:
    """Patterns of a definition of the name: general, and SQL's (any case)."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    end = F.concat(F.lit(r")\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*"), quoted, F.lit(r"(?:\s|[<({:\[;]|$)"))
    return F.concat(F.lit(r"(?md)(?:^|(?<=\s))(?:" + "|".join(DEFINES)), end), F.concat(F.lit(r"(?mdi)(?:^|(?<=\s))(?:" + "|".join(SQL_DEFINES)), end)


def defines(content: Column, name: Column) -> Column:
    general, sql = definition(name)
    return F.rlike(content, general) | F.rlike(content, sql)


def is_git_url(text: Column) -> Column:
    return text.rlike(GIT_URL)


def is_unsafe_source(text: Column) -> Column:
    return text.rlike(UNSAFE_URL)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; leading dots begin no suffix."""
    n = name(path)
    return F.when(n.rlike(r"^\.*$"), n).otherwise(F.regexp_replace(n, r"^(\.*[^.].*)\.[^.]*$", "$1"))


def parent_name(path: Column) -> Column:
    p = slashes(path)
    return F.when(F.contains(p, F.lit("/")), F.substring_index(F.regexp_replace(p, "/[^/]*$", ""), "/", -1)).otherwise("")


def path_parts(path: Column) -> Column:
    parent = parent_name(path)
    return F.array_distinct(F.concat(split_identifier(stem(path)), F.when(parent.isin("", ".", "/", ".."), F.array().cast("array<string>")).otherwise(split_identifier(parent))))


def enrich(content: Column, path: Column) -> Column:
    """Content, then the stem twice, then the last three folders."""
    folders = F.filter(F.split(F.regexp_replace(slashes(path), "[^/]*$", ""), "/"), lambda p: ~p.isin("", "."))
    last = F.slice(folders, F.greatest(F.size(folders) - 2, F.lit(1)), F.lit(3))
    return F.concat(content, F.lit(" "), stem(path), F.lit(" "), stem(path), F.lit(" "), F.array_join(last, " "))


def location(path: Column, start: Column, end: Column, locator: Column | None = None) -> Column:
    """path:start-end, or the place that a locator names."""
    lines = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    if locator is None:
        return F.concat(path, F.lit(":"), lines)
    first, last = locator["page_start"], locator["page_end"]
    kind = locator["kind"]
    place = (
        F.when(kind == "pages", F.when(first == last, F.concat(F.lit("p"), first.cast("string"))).otherwise(F.concat(F.lit("p"), first.cast("string"), F.lit("-"), last.cast("string"))))
        .when(kind == "slide", F.concat(F.lit("slide"), locator["slide"].cast("string")))
        .when(kind == "sheet", F.concat(locator["sheet_name"], F.lit("!"), locator["cell_range"]))
        .when((kind == "heading") & (F.size(locator["heading_path"]) > 0), F.concat(F.array_join(locator["heading_path"], "/"), F.lit(":"), lines))
        .otherwise(lines)
    )
    return F.concat(path, F.lit(":"), place)
