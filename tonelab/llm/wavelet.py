"""Wavelet matrix over a small alphabet, in NumPy, with ranks of many places at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """``rank`` counts symbols in a prefix of a sequence, after one pass per bit of the alphabet.

    Each level holds one bit of every symbol, the highest first, in the order that a stable
    partition by the levels above has left; a directory counts ones by words of 64 bits. That is
    ``bits`` bits a symbol and as much again for the directory.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size, self.levels = bits, len(symbols), []
        for level in reversed(range(bits)):
            ones = (symbols >> level & 1).astype(bool)
            packed = np.zeros((len(ones) // 64 + 1) * 8, np.uint8)
            packed[: (len(ones) + 7) // 8] = np.packbits(ones, bitorder="little")
            words = packed.view("<u8")
            upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words)[:-1], dtype=np.int64)])
            self.levels.append((words, upto, len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(level: tuple, at: np.ndarray) -> np.ndarray:
        words, upto, _ = level
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return upto[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: int, at: np.ndarray, bits: int | None = None) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``; with ``bits``: begin with those bits."""
        bits = self.bits if bits is None else bits
        start, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for i, level in enumerate(self.levels[:bits]):
            if symbol >> (bits - 1 - i) & 1:
                start, at = level[2] + self._ones(level, start), level[2] + self._ones(level, at)
            else:
                start, at = start - self._ones(level, start), at - self._ones(level, at)
        return at - start
