"""Texts cut where a byte-level pre-tokenizer cuts in any case, and ids remembered per piece.

The pattern of the byte-level tokenizers attaches one blank to the word behind it.  A cut before a
blank between two characters that are not white space therefore never changes the result, so a
text's ids are the ids of its pieces in order, and most pieces have been seen before.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np

#: Pieces remembered per Python worker; beyond, the less used half is forgotten.
REMEMBERED = 400_000

_OPEN = re.compile(r"\s (?:\s|\Z)")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def cut(text: str) -> tuple[str, list[str]]:
    """The first piece, and the others without the blank that each begins with."""
    if _OPEN.search(text) is None:
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _CUT.split(text)
    return first, [p[1:] for p in rest]


class PieceIds:
    """ids of texts, piece by piece; ``encode`` gives the ids of new pieces in order, and their numbers."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: str | None = None):
        #: Texts that hold this string are encoded whole: the tokenizer treats it by itself.
        self.encode, self.whole = encode, whole
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.size, self.uses = (np.zeros(1024, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _forget(self) -> None:
        n = len(self.place)
        keep = np.sort(np.argpartition(-self.uses[:n], n // 2)[: n // 2])
        names, uses = list(self.place), self.uses[keep] // 2
        ids, sizes = self._gathered(keep), self.size[keep]
        self._clear()
        self._add([names[i] for i in keep.tolist()], ids, sizes)
        self.uses[: len(keep)] = uses

    def _gathered(self, index: np.ndarray) -> np.ndarray:
        size = self.size[index]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    @staticmethod
    def _grown(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        out = np.zeros(max(n, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.place), len(self.place) + len(pieces)
        self.start, self.size, self.uses = (self._grown(x, n) for x in (self.start, self.size, self.uses))
        self.flat = self._grown(self.flat, self.used + len(ids))
        self.start[at:n] = self.used + np.cumsum(sizes) - sizes
        self.size[at:n] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(pieces, range(at, n), strict=True))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text)."""
        if len(self.place) > REMEMBERED:
            self._forget()
        # Pieces that begin with a blank are known without it, which saves a copy of each; no such
        # rest begins with a blank, so a blank marks the others.
        keys: list[str] = []
        counts = []
        for text in texts:
            before = len(keys)
            if text and self.whole and self.whole in text:
                keys.append(" " + text)
            elif text:
                first, rest = cut(text)
                if first:
                    keys.append(" " + first)
                keys += rest
            counts.append(len(keys) - before)
        index = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        if len(missing := np.flatnonzero(index < 0)):
            new = [keys[i] for i in missing.tolist()]
            distinct = list(dict.fromkeys(new))
            self._add(distinct, *self.encode([k[1:] if k[:1] == " " else " " + k for k in distinct]))
            index[missing] = [self.place[p] for p in new]
        self.uses += np.bincount(index, minlength=len(self.uses))
        ends = np.concatenate(([0], np.cumsum(self.size[index])))
        bounds = ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        return self._gathered(index), np.diff(bounds)
