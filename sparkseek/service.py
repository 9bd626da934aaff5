"""The search tools for editors: strings in, strings out, and a loop that serves them as JSON-RPC lines (MCP) over stdio."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from typing import Any, TextIO

from .cache import Cache
from .functions.text import UNSAFE_URL
from .index import MODES

PROTOCOL = "2025-06-18"
_REPO = {"type": "string", "description": "Local path or https git URL; the default source if left out."}
_MANY = {"type": "integer", "minimum": 1, "default": 5}
TOOLS = [
    {
        "name": "search",
        "description": "Find code by meaning or by symbol in a folder or git repository, which is indexed on first use.",
        "inputSchema": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "repo": _REPO, "mode": {"type": "string", "enum": list(MODES), "default": MODES[0]}, "top_k": _MANY}},
    },
    {
        "name": "find_related",
        "description": "Find code like that at a line of an indexed file.",
        "inputSchema": {"type": "object", "required": ["file_path", "line"], "properties": {"file_path": {"type": "string"}, "line": {"type": "integer"}, "repo": _REPO, "top_k": _MANY}},
    },
]


class Service:
    """Tools over cached indexes; a default source keeps its ref."""

    def __init__(self, build: Callable[[str, str | None], Any], default: str | None = None, ref: str | None = None, most: int = 10):
        self.cache, self.default, self.ref = Cache(build, most), default, ref

    def _with(self, repo: str | None, answer: Callable[[Any], str]) -> str:
        source = repo or self.default
        if not source:
            return "No repo specified and there is no default source: pass a local path or an https git URL as `repo`."
        if re.match(UNSAFE_URL, source):
            return "This git transport is not supported here; use an https URL."
        try:
            index = self.cache.get(source, self.ref if source == self.default else None)
        except Exception as e:  # the caller is told; a later call may succeed
            return f"Failed to index {source!r}: {e}"
        return answer(index)

    def search(self, query: str, repo: str | None = None, mode: str = MODES[0], top_k: int = 5) -> str:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")

        def answer(index: Any) -> str:
            return _shown(index, index.search(query, top_k, mode), f"Results for {query!r} ({mode})", "No results found.")

        return self._with(repo, answer)

    def find_related(self, file_path: str, line: int, repo: str | None = None, top_k: int = 5) -> str:
        def answer(index: Any) -> str:
            chunk = index.resolve(file_path, line)
            if chunk is None:
                return f"No chunk found at {file_path}:{line}; the file must be indexed and have that line."
            return _shown(index, index.find_related(chunk, top_k), f"Related to {file_path}:{line}", f"No related chunks found for {file_path}:{line}.")

        return self._with(repo, answer)

    def call(self, name: str, arguments: dict[str, Any]) -> str:
        tool = {"search": self.search, "find_related": self.find_related}.get(name)
        if tool is None:
            raise ValueError(f"unknown tool: {name}")
        return tool(**arguments)

    def answer(self, request: dict[str, Any]) -> dict[str, Any] | None:
        """The response to one JSON-RPC request; None to a notification."""
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkseek", "version": "0.1.0"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": TOOLS}}
        if method != "tools/call":
            return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}
        try:
            text, failed = self.call(params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:
            text, failed = f"{type(e).__name__}: {e}", True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}

    def serve(self, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
        """Answers one JSON-RPC message a line until the input ends."""
        for line in filter(str.strip, lines):
            try:
                said = self.answer(json.loads(line))
            except (json.JSONDecodeError, AttributeError) as e:
                said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if said is not None:
                print(json.dumps(said), file=out, flush=True)


def _shown(index: Any, results: Any, header: str, none: str) -> str:
    rows = results.cache()  # asked twice: whether there are any, then rendered
    try:
        return index.format(rows, header) if rows.limit(1).count() else none
    finally:
        rows.unpersist()
