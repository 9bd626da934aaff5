"""What paths say about files: language, category, and how much their chunks count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import name, slashes

# Extensions by language, ignored folders, and path patterns.
CODE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift",
    ".scala": "scala", ".sbt": "scala", ".ex": "elixir", ".exs": "elixir", ".dart": "dart", ".lua": "lua", ".sql": "sql", ".sh": "bash", ".bash": "bash", ".zig": "zig", ".hs": "haskell",
}
DOCUMENTS = {".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx"}
IGNORED = ".git .hg .svn __pycache__ node_modules .venv venv .tox .mypy_cache .pytest_cache .ruff_cache .cache .sparkseek dist build .eggs .next".split()
TEST_FILE = r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb|[^/]*\.test\.[jt]sx?|[^/]*\.spec\.[jt]sx?|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift|[^/]*Tests?\.cs|test_[^/]*\.cpp|[^/]*_test\.cpp|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala|[^/]*Suite\.scala|[^/]*Test\.scala|[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.\w+)$"
TEST_DIR = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIR = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLES_DIR = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
REEXPORTS = ("__init__.py", "package-info.java")
STRONG, MODERATE, MILD = 0.3, 0.5, 0.7


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (CODE | DOCUMENTS).items() for x in pair])
    return F.try_element_at(known, extension(path))


def selected(path: Column, extensions: list[str] | None = None, documents: bool = False) -> Column:
    """Whether a file is indexed: by the extensions given, else code, and documents if asked for."""
    return extension(path).isin([*(extensions or [*CODE, *(DOCUMENTS if documents else ())])])


def in_ignored_folder(path: Column, more: list[str] = ()) -> Column:
    folders = F.split(F.regexp_replace(slashes(path), "[^/]*$", ""), "/")
    return F.arrays_overlap(folders, F.array(*[F.lit(x) for x in [*IGNORED, *more]]))


def penalty(path: Column) -> Column:
    """Product of the factors for tests, re-exports, compatibility code, examples and type stubs."""
    p = slashes(path)
    factor = lambda when, x: F.when(when, x).otherwise(1.0)
    return factor(p.rlike(TEST_FILE) | p.rlike(TEST_DIR), STRONG) * factor(name(path).isin(*REEXPORTS), MODERATE) * factor(p.rlike(COMPAT_DIR), STRONG) * factor(p.rlike(EXAMPLES_DIR), STRONG) * factor(p.rlike(r"\.d\.ts$"), MILD)
