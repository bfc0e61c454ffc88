"""A cache of answers in the driver: least recently used entries go first, and all go stale after some time."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class ResultCache:
    """Keys hold the snapshot they were answered from, so a sync makes earlier answers unreachable."""

    def __init__(self, entries: int = 10_000, ttl: float = 86_400, clock: Callable[[], float] = time.monotonic):
        self.entries, self.ttl, self.clock = entries, ttl, clock
        self._kept: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable) -> Any | None:
        found = self._kept.get(key)
        if found is None or self.clock() - found[0] > self.ttl:
            self._kept.pop(key, None)
            self.misses += 1
            return None
        self._kept.move_to_end(key)
        self.hits += 1
        return found[1]

    def set(self, key: Hashable, value: Any) -> None:
        self._kept[key] = (self.clock(), value)
        self._kept.move_to_end(key)
        while len(self._kept) > self.entries:
            self._kept.popitem(last=False)

    def delete(self, key: Hashable) -> None:
        self._kept.pop(key, None)

    def clear(self) -> None:
        self._kept.clear()

    def ping(self) -> bool:
        """Whether an entry that is put in comes back; hits, misses and other entries stay as they are."""
        probe, kept = object(), self._kept.copy() if len(self._kept) >= self.entries else None
        hits, misses = self.hits, self.misses
        self.set(probe, probe)
        found = self.get(probe) is probe
        self.delete(probe)
        if kept is not None:
            self._kept = kept
        self.hits, self.misses = hits, misses
        return found

    def stats(self) -> dict:
        return {"connected": self.ping(), "hits": self.hits, "misses": self.misses}
