"""Word tokens, bounded and padded token lists. All take already cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token bounds for sources and for targets of each task family.
MAX_SOURCE_TOKENS = 256
MAX_TARGET_TOKENS = {"label": 4, "label_short": 2, "free_text": 64}


def words(clean: Column, pieces: int = -1) -> Column:
    """Lower-cased words of the whole text; ``['']`` for the empty text.

    Cleaned text has no blank at either end, so splitting on runs of blanks
    leaves no empty word, and no filter over the array is needed. With
    ``pieces`` splitting stops there and the last piece is the uncut rest.
    """
    return F.split(F.lower(clean), " +", pieces)


def bounded_tokens(clean: Column, limit: int = MAX_SOURCE_TOKENS) -> Column:
    """The first ``limit`` words."""
    none = F.array().cast("array<string>")
    return F.when(clean == "", none).otherwise(F.slice(words(clean, limit + 1), 1, limit))


def pad_tokens(tokens: Column, length: int, pad: str = "<pad>") -> Column:
    """Cut or fill a token list to exactly ``length`` entries."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), length)), 1, length)


def token_mask(tokens: Column, length: int) -> Column:
    """1 for a real token, 0 for padding."""
    kept = F.least(F.size(tokens), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))
