"""Label of a generated text, with the fallback policy for unrecognised text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelab.functions.labels import THREE_CLASS, TWO_CLASS, LabelDomain
from tonelab.functions.text import strip

PREFIX_LENGTH = 3


@dataclass(frozen=True)
class FallbackPolicy:
    """Which label unrecognised text gets.

    ``text`` is the label text written out; ``label_id`` is the id used when that
    text is not in the domain.
    """

    domain: LabelDomain
    text: str
    label_id: int


# The three policies in use.
FALLBACKS = {
    "three_class": FallbackPolicy(THREE_CLASS, "off", 1),
    # "off" is outside this domain, so unrecognised text ends up positive (id 1).
    "remove_off": FallbackPolicy(TWO_CLASS, "off", 1),
    "two_class": FallbackPolicy(TWO_CLASS, "negative", 0),
}


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))), r"[^\p{L}]", "")


def text_to_label(c: Column, policy: FallbackPolicy = FALLBACKS["three_class"]) -> Column:
    """Generated text -> label text, by the first three letters of each label."""
    letters = letters_only(c)
    expr = None
    for name in policy.domain.names:
        hit = letters.startswith(name[:PREFIX_LENGTH])
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr.otherwise(F.lit(policy.text))


def text_to_id(c: Column, policy: FallbackPolicy = FALLBACKS["three_class"]) -> Column:
    """Generated text -> label id."""
    return F.coalesce(policy.domain.encode(text_to_label(c, policy)), F.lit(policy.label_id))
