"""What a worker remembers of word forms, as NumPy columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Word forms remembered at most; the memory is emptied when it is full.
REMEMBERED = 1 << 18


class Lexicon:
    """Looks words up in columns that ``describe`` fills once per word form.

    ``more`` makes further columns, of types ``more_types``, from those of the new word forms.
    """

    def __init__(self, describe: Callable[[bytes], tuple], types: list, limit: int = REMEMBERED, more: Callable | None = None, more_types=()):
        self.describe, self.types, self.limit, self.more = describe, [*types, *more_types], limit, more
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.columns = [np.zeros(0, t) for t in self.types]

    def look_up(self, words: list[bytes]) -> list[np.ndarray]:
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > self.limit:
            self._forget()
            new = set(words)
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            found = [np.array(f, t) for f, t in zip(zip(*map(self.describe, new), strict=True), self.types, strict=False)]
            found += self.more(*found) if self.more else []
            self.columns = [np.append(c, f) for c, f in zip(self.columns, found, strict=True)]
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return [c[at] for c in self.columns]
