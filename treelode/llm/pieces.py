"""Ids of the pieces that a worker has met, so that each is encoded once while it is remembered."""
from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The runs of the given rows, one after the other."""
    size = sizes[rows]
    shift = starts[rows] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(rows) else starts[:0]
    return values[np.repeat(shift, size) + np.arange(size.sum())]


class PieceTable:
    """Remembers the ids of about `most` pieces; when there are more, the less frequent half makes room.

    `learn` gives the ids of new pieces, one after the other, and how many each has.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most, self.numbers = learn, most, Numbers()
        self.ids, self.starts, self.sizes, self.used = np.empty(0, np.int32), *np.empty((3, 0), np.int64)

    def ids_of(self, rows: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of pieces, one after the other, and how many each row has."""
        if len(self.numbers) > self.most:
            self._make_room()
        known = len(self.numbers)
        found = [np.fromiter(map(self.numbers.__getitem__, row), np.int64, len(row)) for row in rows]
        if len(self.numbers) > known:
            self._append(*self.learn([*self.numbers][known:]))
        every = np.concatenate(found) if found else np.empty(0, np.int64)
        self.used += np.bincount(every, minlength=len(self.used))
        ends = np.concatenate(([0], np.cumsum(self.sizes[every])))
        stops = np.cumsum([0, *map(len, found)])
        return ragged(self.ids, self.starts, self.sizes, every), np.diff(ends[stops])

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        self.used = np.concatenate((self.used, np.zeros(len(sizes), np.int64)))

    def _make_room(self) -> None:
        kept = np.sort(np.argsort(-self.used, kind="stable")[:self.most // 2])
        pieces = [*self.numbers]
        self.numbers = Numbers({pieces[old]: new for new, old in enumerate(kept.tolist())})
        self.ids = ragged(self.ids, self.starts, self.sizes, kept)
        self.sizes, self.used = self.sizes[kept], self.used[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
