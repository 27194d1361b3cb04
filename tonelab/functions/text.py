"""Cleaning of text and label columns.

Everything here is a built-in expression, so it stays in generated code. The
strip uses ``trim`` with a character set instead of a regular expression: it is
linear in the text and about four times faster on long documents.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.strip() removes.
WHITESPACE_CODE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009,
    0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODE_POINTS))

# Label spellings that mean "no label was given".
MISSING_LABELS = ("", "nan", "none")


def strip(c: Column) -> Column:
    """Remove all Unicode white space from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Cast to string, turn each newline into one space, strip both ends."""
    return strip(F.replace(c.cast("string"), F.lit("\n"), F.lit(" ")))


def stripped_text(c: Column) -> Column:
    """Cast to string and strip; newlines inside stay (prompts replace them later)."""
    return strip(c.cast("string"))


def normalise_label(c: Column) -> Column:
    """Cast to string, strip, lower-case."""
    return F.lower(strip(c.cast("string")))


def missing_to_off(c: Column) -> Column:
    """Replace a missing (already normalised) label by ``off``."""
    return F.when(c.isNull() | c.isin(*MISSING_LABELS), F.lit("off")).otherwise(c)


def target_text(c: Column) -> Column:
    """Target of a text-to-text example: same normal form as a label."""
    return normalise_label(c)
