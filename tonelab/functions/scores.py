"""Score vectors: softmax, argmax, one column per class, cross-entropy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelab.functions.labels import LabelDomain


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A column used inside a lambda is evaluated for every element; as a lambda
    argument it is evaluated once. Without this softmax is cubic in the length.
    """
    return F.get(F.transform(F.array(value), body), 0)


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by its maximum so it cannot overflow."""

    def shifted(top: Column) -> Column:
        return F.transform(logits, lambda x: F.exp(x.cast("double") - top))

    def normalised(terms: Column) -> Column:
        total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
        return _bind(total, lambda t: F.transform(terms, lambda x: x / t))

    return _bind(F.array_max(logits).cast("double"), lambda top: _bind(shifted(top), normalised))


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def probability_columns(probabilities: Column, domain: LabelDomain) -> dict[str, Column]:
    """``prob_<label>`` columns of a probability array."""
    return {f"prob_{name}": probabilities[i] for i, name in enumerate(domain.names)}


def cross_entropy(logits: str, label: str, classes: int) -> Column:
    """Negative log probability of the gold label; columns by name.

    The sum is written out over the fixed classes: no lambda, so it stays in
    generated code.
    """
    top = f"array_max({logits})"
    total = " + ".join(f"exp({logits}[{i}] - {top})" for i in range(classes))
    return F.expr(f"ln({total}) + {top} - {logits}[{label}]")
