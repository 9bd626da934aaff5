"""Least recently used indexes, each built once however many ask for it at a time."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any


class Cache:
    def __init__(self, build: Callable[[str, str | None], Any], most: int = 10):
        self.build, self.most, self.lock = build, most, threading.Lock()
        self.kept: OrderedDict[str, Future] = OrderedDict()

    @staticmethod
    def key(source: str, ref: str | None = None) -> str:
        return f"{source}@{ref}" if ref else source

    def get(self, source: str, ref: str | None = None) -> Any:
        """The index of a source; a build that failed isn't kept."""
        key, mine = self.key(source, ref), False
        with self.lock:
            future = self.kept.get(key)
            if future is None:
                future, mine = Future(), True
                self.kept[key] = future
            self.kept.move_to_end(key)
            gone = [self.kept.popitem(last=False)[1] for _ in range(len(self.kept) - self.most)]
        for old in gone:
            old.add_done_callback(self._close)
        if mine:
            try:
                future.set_result(self.build(source, ref))
            except BaseException as e:
                self.invalidate(source, ref)
                future.set_exception(e)
        return future.result()

    @staticmethod
    def _close(future: Future) -> None:
        """Lets an index that is no longer kept remove its files."""
        if not future.exception() and hasattr(future.result(), "close"):
            future.result().close()

    def invalidate(self, source: str, ref: str | None = None) -> None:
        with self.lock:
            self.kept.pop(self.key(source, ref), None)
