"""Tables that are read more than once: kept at a level, counted, let go."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Levels by name.  What does not fit in memory goes to disk: results never depend on it.
LEVELS = {
    "memory": StorageLevel.MEMORY_AND_DISK,
    "memory_replicated": StorageLevel.MEMORY_AND_DISK_2,
    "disk": StorageLevel.DISK_ONLY,
    "off_heap": StorageLevel.OFF_HEAP,
}


@dataclass
class Cache:
    """Named tables, persisted when asked for a second time: a table read once is not worth keeping."""

    level: str = "memory"
    after: int = 2
    held: dict[str, DataFrame] = field(default_factory=dict)
    asked: dict[str, int] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    def get(self, name: str, make: Callable[[], DataFrame], level: str | None = None) -> DataFrame:
        self.asked[name] = self.asked.get(name, 0) + 1
        if name in self.held:
            self.hits += 1
            return self.held[name]
        self.misses += 1
        df = make()
        if self.asked[name] >= self.after:
            df = self.held[name] = df.persist(LEVELS[level or self.level])
        return df

    def drop(self, name: str) -> bool:
        df = self.held.pop(name, None)
        if df is not None:
            df.unpersist()
        return df is not None

    def clear(self) -> None:
        for name in list(self.held):
            self.drop(name)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"held": sorted(self.held), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}
