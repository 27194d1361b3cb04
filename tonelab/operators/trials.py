"""Seeded draws of hyperparameter settings.

A draw is a hash of seed, search, trial and parameter name, so a setting depends
on nothing else: not on the order of rows, partitions or other parameters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_DIGITS = 8
DRAW_DIGITS = 12


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def at(self, u):
        return F.round(F.exp(F.lit(math.log(self.low)) + u * math.log(self.high / self.low)), DRAW_DIGITS)

    def value(self, u: float):
        return round(math.exp(math.log(self.low) + u * math.log(self.high / self.low)), DRAW_DIGITS)


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def at(self, u):
        return F.round(F.lit(self.low) + u * (self.high - self.low), DRAW_DIGITS)

    def value(self, u: float):
        return round(self.low + u * (self.high - self.low), DRAW_DIGITS)


@dataclass(frozen=True)
class IntRange:
    """Whole numbers from ``low`` to ``high``, both included."""

    low: int
    high: int

    def at(self, u):
        return (F.floor(u * (self.high - self.low + 1)) + self.low).cast("int")

    def value(self, u: float):
        return self.low + math.floor(u * (self.high - self.low + 1))


@dataclass(frozen=True)
class Choice:
    options: tuple

    def at(self, u):
        return F.get(F.array(*[F.lit(o) for o in self.options]), F.floor(u * len(self.options)).cast("int"))

    def value(self, u: float):
        return self.options[math.floor(u * len(self.options))]


Space = Mapping[str, LogUniform | Uniform | IntRange | Choice]

# The two search spaces and their numbers of trials.
CLASSIFIER_SPACE: Space = {
    "learning_rate": LogUniform(1e-5, 5e-5),
    "per_device_train_batch_size": Choice((8, 16, 32)),
    "num_train_epochs": Choice((2, 3, 4)),
    "weight_decay": Uniform(0.0, 0.1),
}
CLASSIFIER_TRIALS = 3
TEXT_SPACE: Space = {
    "learning_rate": LogUniform(1e-5, 5e-4),
    "num_train_epochs": IntRange(2, 6),
    "per_device_train_batch_size": Choice((8, 16)),
}
TEXT_TRIALS = 5

# Search space of the count model. Texts are always read whole.
COUNT_MODEL_SPACE: Space = {
    "smoothing": LogUniform(0.01, 10.0),
    "prior_weight": Uniform(0.0, 1.0),
}


def unit_draw(name: str, seed: int, search: Column, trial: Column) -> Column:
    """Uniform number in [0, 1) from the first hex digits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), search.cast("string"), trial.cast("string"), F.lit(name)))
    whole = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")
    return whole / F.lit(float(16**HEX_DIGITS))


def trial_table(searches: DataFrame, search: str, space: Space, n_trials: int, seed: int = 42) -> DataFrame:
    """``n_trials`` settings for each row of ``searches``, one typed column per parameter."""
    numbered = searches.select(search, F.explode(F.sequence(F.lit(1), F.lit(n_trials))).alias("trial"))
    draws = {name: p.at(unit_draw(name, seed, F.col(search), F.col("trial"))) for name, p in space.items()}
    return numbered.withColumns(draws)


def draw_settings(search: str, space: Space, n_trials: int, seed: int = 42) -> Sequence[dict]:
    """The same settings as plain values, for a search that is set up on the driver."""
    rows = []
    for trial in range(1, n_trials + 1):
        row: dict = {"trial": trial}
        for name, p in space.items():
            digest = hashlib.md5(f"{seed}|{search}|{trial}|{name}".encode()).hexdigest()
            row[name] = p.value(int(digest[:HEX_DIGITS], 16) / 16**HEX_DIGITS)
        rows.append(row)
    return rows
