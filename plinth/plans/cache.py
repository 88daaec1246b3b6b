"""A bounded memory of decoded chunks on the driver, the least recently used going first."""

from __future__ import annotations

from collections import OrderedDict


class DecodeCache:
    """Chunks have at most ``chunk_size`` values each, so ``capacity`` of them bound the memory."""

    def __init__(self, capacity: int = 128):
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self._chunks: OrderedDict[tuple[str, int], list] = OrderedDict()

    def get(self, name: str, chunk_id: int) -> list | None:
        found = self._chunks.get((name, chunk_id))
        if found is None:
            self.misses += 1
            return None
        self.hits += 1
        self._chunks.move_to_end((name, chunk_id))
        return list(found)

    def put(self, name: str, chunk_id: int, values: list) -> None:
        self._chunks[name, chunk_id] = list(values)
        self._chunks.move_to_end((name, chunk_id))
        while len(self._chunks) > self.capacity:
            self._chunks.popitem(last=False)

    def clear(self) -> None:
        self._chunks.clear()

    def stats(self) -> dict:
        total = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "size": len(self._chunks), "hit_rate": self.hits / total if total else 0.0}
