"""Encode each distinct unit of a text once, and spell every text from the stored results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


_kept: dict = {}


def kept_in_worker(key, make: Callable[[], object]):
    """The object made before under this key in this Python worker, else a new one; only the last one stays."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget_kept() -> None:
    """Give back the memory of what an earlier stage left in this worker."""
    _kept.clear()


class Store:
    """What was made of units, by their bytes: one or more columns of values, of any number for each unit."""

    def __init__(self, kinds: tuple = (np.int32,), limit: int = 9_000_000):
        self.kinds, self.limit = kinds, limit
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.held = 0
        self.start = [np.empty(0, np.int64) for _ in self.kinds]
        self.size = [np.empty(0, np.int64) for _ in self.kinds]
        self.flat = [np.empty(0, k) for k in self.kinds]

    def trim(self) -> None:
        """Forget everything if more than `limit` bytes of units are held, so memory is bounded; slots given before are void."""
        if self.held > self.limit:
            self._clear()

    def slots(self, units: pa.Array, make: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """The slot of each unit.  make(units) gives, for those not met before, each column's values one after another and their number for each unit."""
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [u for u in distinct if u not in self.slot]
        if new:
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
            self.held += sum(map(len, new))
            for k, (values, sizes) in enumerate(make(new)):
                self.start[k] = np.concatenate([self.start[k], len(self.flat[k]) + np.cumsum(sizes) - sizes])
                self.size[k] = np.concatenate([self.size[k], sizes])
                self.flat[k] = np.concatenate([self.flat[k], values.astype(self.kinds[k])])
        return np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def spell(self, slots: np.ndarray, column: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All values of the units in these slots in order, and each unit's number of them."""
        size = self.size[column][slots]
        return self.flat[column][ranges(self.start[column][slots], size)], size


def spans_array(buf: np.ndarray, edges: np.ndarray) -> pa.Array:
    """buf[edges[0]:edges[1]], buf[edges[1]:edges[2]], ... as binary values."""
    kind, width = (pa.binary(), np.int32) if len(buf) < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, width)), pa.py_buffer(np.ascontiguousarray(buf))])


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those of the next."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
