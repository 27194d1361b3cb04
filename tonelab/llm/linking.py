"""Spanning links inside blocks of rows, as NumPy code that runs in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


def spanning(linked: np.ndarray) -> np.ndarray:
    """For a symmetric block matrix of links: the least index each row is connected to."""
    n = len(linked)
    label = np.arange(n)
    while True:
        nearest = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        nearest = np.minimum(nearest, nearest[nearest])
        if (nearest == label).all():
            return label
        label = nearest


def spanning_two(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix of links between two blocks: labels of rows and columns; equal: connected.

    Rows start with their own index; a column without links gets the number of rows.
    """
    n = len(linked)
    rows = np.arange(n)
    while True:
        cols = np.where(linked, rows[:, None], n).min(axis=0)
        again = np.minimum(rows, np.where(linked, cols[None, :], n).min(axis=1))
        if (again == rows).all():
            return rows, cols
        rows = again


def runs(batches: Iterator, keys: list[str], use: Callable) -> Iterator:
    """Call ``use(columns, starts, ends)`` on whole runs of equal keys in sorted batches.

    ``batches`` yields dicts of NumPy columns; a run may go on in the next batch.
    """
    rest: dict | None = None
    for batch in batches:
        if rest is not None:
            batch = {k: np.concatenate([rest[k], batch[k]]) for k in batch}
        n = len(batch[keys[0]])
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= batch[k][1:] != batch[k][:-1]
        starts = np.concatenate([[0], np.flatnonzero(new)])
        if len(starts) > 1:
            yield use(batch, starts[:-1], starts[1:])
        rest = {k: v[starts[-1] :] for k, v in batch.items()}
    if rest is not None and len(rest[keys[0]]):
        yield use(rest, np.array([0]), np.array([len(rest[keys[0]])]))
