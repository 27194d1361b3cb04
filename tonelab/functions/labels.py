"""Label domains and the label <-> id lookups.

A domain is a fixed, ordered list of two or three names, so the lookups are
CASE expressions: no join, no index fitted on the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelDomain:
    """Ordered label names; the position of a name is its id."""

    names: tuple[str, ...]

    @property
    def ids(self) -> tuple[int, ...]:
        return tuple(range(len(self.names)))

    @property
    def display_names(self) -> tuple[str, ...]:
        return tuple(n.capitalize() for n in self.names)

    def id_of(self, name: str) -> int:
        return self.names.index(name)

    def contains(self, c: Column) -> Column:
        return c.isin(*self.names)

    def encode(self, c: Column) -> Column:
        """Label name -> id; null outside the domain."""
        return _lookup(c, [(n, F.lit(i)) for i, n in enumerate(self.names)])

    def decode(self, c: Column) -> Column:
        """Id -> display name; null outside the domain."""
        return _lookup(c, [(i, F.lit(n)) for i, n in enumerate(self.display_names)])


def _lookup(c: Column, pairs: list[tuple[object, Column]]) -> Column:
    (first, value), *rest = pairs
    expr = F.when(c == F.lit(first), value)
    for key, value in rest:
        expr = expr.when(c == F.lit(key), value)
    return expr


# The two label domains.
THREE_CLASS = LabelDomain(("negative", "off", "positive"))
TWO_CLASS = LabelDomain(("negative", "positive"))
