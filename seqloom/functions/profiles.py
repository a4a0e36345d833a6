"""Profiles of aligned members as arrays of counters, and the correction that one gives a member."""

from __future__ import annotations

import numpy as np

from seqloom.functions.alignment import placed, slots

GAP = "-"


def insertions(member: str, center: str) -> list[tuple[int, str]]:
    """(slot, characters) where a gapped member has more than one character before a base of its gapped center."""
    return [(k, s) for k, s in enumerate(slots(member, center)[0]) if k % 2 == 0 and len(s) > 1]


def in_columns(member: str, center: str, widest: dict[int, str], known: dict[tuple[str, str], str]) -> np.ndarray:
    """A gapped member's characters in its partition's columns. widest: of each slot that has longer insertions the longest.

    A slot is one column, or as many as its longest insertion has characters and a free one on either side. known: what was placed before.
    """
    parts = slots(member, center)[0]
    for slot, longest in widest.items():
        pair = parts[slot], longest
        if pair not in known:
            known[pair] = placed(pair[0], f"{GAP}{longest}{GAP}")
        parts[slot] = known[pair]
    return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)


class Profile:
    """How many reads have which character in which column."""

    def __init__(self, characters: list[int] | None = None, counts: np.ndarray | None = None) -> None:
        self.counts = {} if characters is None else dict(zip(characters, counts.reshape(len(characters), -1), strict=True))

    def add(self, columns: np.ndarray, degree: int) -> None:
        """Count one member."""
        for c in np.unique(columns).tolist():
            if c not in self.counts:
                self.counts[c] = np.zeros(len(columns), np.int64)
            self.counts[c] += degree * (columns == c)

    def merge(self, other: Profile) -> None:
        """Count what another profile has."""
        for c, n in other.counts.items():
            self.counts[c] = self.counts[c] + n if c in self.counts else n

    def packed(self) -> tuple[list[int], bytes]:
        """Characters, and their counters one behind the other."""
        characters = sorted(self.counts)
        return characters, b"".join(self.counts[c].astype("<i8").tobytes() for c in characters)

    @staticmethod
    def unpacked(characters: list[int], raw: bytes) -> Profile:
        """What `packed` gave."""
        return Profile(characters, np.frombuffer(raw, "<i8"))

    def settle(self) -> None:
        """Majorities, and how many errors of each kind the unambiguous columns have."""
        self.characters = np.array(sorted(self.counts), np.uint32)
        self.table = np.stack([self.counts[c] for c in sorted(self.counts)])
        best = self.table.max(axis=0)
        self.top = self.characters[(self.table == best).argmax(axis=0)]  # the lesser, of several
        self.ambiguous = (self.table == best).sum(axis=0) > 1
        gap = self.characters[:, None] == ord(GAP)
        minor = np.where((self.characters[:, None] != self.top) & ~self.ambiguous, self.table, 0)
        on_gap = self.top == ord(GAP)
        self.kinds = [int(minor[:, on_gap].sum()), int((minor * gap)[:, ~on_gap].sum()), int((minor * ~gap)[:, ~on_gap].sum())]

    def corrected(self, columns: np.ndarray, degree: int) -> str:
        """The member with the less frequent half of its minority characters, ties included, replaced; without gaps.

        A frequency is the share of a character among all errors of its kind. Members of a degree over 1 stay as they are.
        """
        if degree <= 1:
            at = np.flatnonzero((columns != self.top) & ~self.ambiguous)
            if len(at):
                n = self.table[np.searchsorted(self.characters, columns[at]), at]
                kind = np.where(self.top[at] == ord(GAP), 0, np.where(columns[at] == ord(GAP), 1, 2))
                share = n / np.maximum(np.array(self.kinds)[kind], 1)
                half = np.sort(share)[-(-len(at) // 2) - 1]
                columns = columns.copy()
                columns[at[share <= half]] = self.top[at[share <= half]]
        return columns[columns != ord(GAP)].astype("<u4").tobytes().decode("utf-32-le")
