"""What was computed for a piece of text, once, and gathered for all texts that hold the piece."""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np

from seqloom.llm import common

#: Bytes, about, that one memory holds; beyond that it forgets all of it. An entry is ENTRY_BYTES and its text.
REMEMBERED_BYTES, ENTRY_BYTES = 48 << 20, 200


class _Slots(dict):
    """Piece to its number; a new piece gets the next one and waits in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = slot = len(self)
        self.new.append(key)
        return slot


class Remembered:
    """Arrays of numbers by piece of text. `make` gets the pieces that were not met before, and gives their arrays one behind the
    other and the length of each.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind, limit: int = REMEMBERED_BYTES) -> None:
        self.make, self.kind, self.limit = make, kind, limit
        self.forget()

    def forget(self) -> None:
        """Let go of all pieces."""
        self.slots = _Slots()
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used, self.held = np.zeros(1 << 14, self.kind), 0, 0

    def _remember(self) -> None:
        keys, self.slots.new = self.slots.new, []
        made, more = self.make(keys)
        n, total = len(self.slots), len(made)
        while len(self.starts) < n:
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while len(self.flat) < self.used + total:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = made
        self.starts[n - len(keys) : n] = self.used + np.cumsum(more) - more
        self.lengths[n - len(keys) : n] = more
        self.used += total
        self.held += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + self.flat.itemsize * total

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; holds until the next call."""
        if self.held > self.limit:
            self.forget()
        gc.disable()  # what is remembered holds no cycles, and looking for some takes longer than the lookups
        try:
            at = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
            if self.slots.new:
                self._remember()
        finally:
            gc.enable()
        return at

    def arrays(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these pieces one behind the other, and the length of each."""
        lengths = self.lengths[numbers]
        return self.flat[common.ragged(self.starts[numbers], lengths)], lengths

    def gather(self, pieces: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of all pieces one behind the other, and the ends (from 0 on) of stretches of `counts` pieces."""
        values, lengths = self.arrays(self.numbers(pieces))
        return values, np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
