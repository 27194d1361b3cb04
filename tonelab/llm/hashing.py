"""64-bit hashes of the words of many texts at once, without a dictionary of words.

The hash of a word is a polynomial over a random number per byte, modulo 2^64. It is read off a running
sum over all bytes, so the work is a few NumPy passes over blocks that fit a processor's cache.
Upper case A-Z counts as lower case; words are runs without ASCII white space. Different words
may meet with the chance of 64-bit numbers; words of over 1,000 letters made of two letters in
a certain self-similar order meet by rule.
"""

from __future__ import annotations

import numpy as np

#: Bytes taken at once.
BLOCK = 1 << 15
_MASK = (1 << 64) - 1
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(step: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(BLOCK, step, np.uint64)))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]
_LETTER[_BLANK] = 0
_UP, _DOWN = _powers(_STEP), _powers(_BACK)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text (null: none)."""
    data = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]) or b" ", np.uint8)
    carry, up, down, before = np.uint64(0), 1, 1, True
    heads, head_sums, tail_sums, scales = [], [], [], []
    for at in range(0, len(data), BLOCK):
        d = data[at : at + BLOCK]
        blank = _BLANK[d]
        turn = np.flatnonzero(np.append(before, blank[:-1]) != blank)
        opens = ~blank[turn]
        first, last = turn[opens], turn[~opens]
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(_LETTER[d] * _UP[: len(d)], out=sums[1:])
        sums = carry + np.uint64(up) * sums
        heads.append(first + at)
        head_sums.append(sums[first])
        tail_sums.append(sums[last])
        scales.append(np.uint64(down) * _DOWN[first])
        carry, before = sums[-1], blank[-1]
        up, down = up * pow(_STEP, BLOCK, 1 << 64) & _MASK, down * pow(_BACK, BLOCK, 1 << 64) & _MASK
    heads, head_sums, tail_sums, scales = map(np.concatenate, (heads, head_sums, tail_sums, scales))
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    sizes = np.diff(np.searchsorted(heads, ends), prepend=0)
    return mixed((tail_sums - head_sums) * scales), sizes


def spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes, as of ``words``, of the stretches of bytes from ``first`` to before ``last``: in order, apart, without white space, none empty."""
    carry, up, down = np.uint64(0), 1, 1
    out, tails = np.empty(len(first), np.uint64), np.empty(len(first), np.uint64)
    scales = np.empty(len(first), np.uint64)
    for at in range(0, len(data), BLOCK):
        d = data[at : at + BLOCK]
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(_LETTER[d] * _UP[: len(d)], out=sums[1:])
        sums = carry + np.uint64(up) * sums
        a = slice(*np.searchsorted(first, [at, at + len(d)]))
        z = slice(*np.searchsorted(last, [at, at + len(d)], "right"))
        out[a], scales[a] = sums[first[a] - at], np.uint64(down) * _DOWN[first[a] - at]
        tails[z] = sums[last[z] - at]
        carry = sums[-1]
        up, down = up * pow(_STEP, BLOCK, 1 << 64) & _MASK, down * pow(_BACK, BLOCK, 1 << 64) & _MASK
    return mixed((tails - out) * scales)
