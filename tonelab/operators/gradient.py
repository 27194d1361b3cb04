"""A linear classifier on hashed words, trained by mini-batches; all trials in one job an epoch.

Rows are dealt to shards of about ``SHARD`` rows by the hash that orders the split. In an epoch
every shard starts from the same weights and goes through its rows in batches, in the order of that
hash, once for each trial that is still live, with the trial's own learning rate, batch size and
decay. At the end of the epoch the shards' weights are averaged by their rows. An epoch is
therefore one job however many trials there are, and a trial that has stopped is
not part of it.

Averages are sums of fixed-point integers, so they do not depend on which task held a shard
or on a retry. The weights are trials x classes x ``width`` numbers, whatever the table: they go
to the tasks and come back whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.sources.scratch import materialize

SHARD = 1024
#: A weight times its share of the rows is kept to 2^-50.
FIXED_POINT = float(1 << 50)
#: A loss is kept to 10^-9.
LOSS_POINT = 1e9
#: Rates are drawn for steps of adapted size; a plain step on vectors of length one is as long with this factor.
STEP = 1e5
#: Word forms whose place a worker remembers.
REMEMBERED = 1 << 17
#: Rows that a task works on at once; a batch of Arrow holds up to 10,000.
SLICE = 512


@dataclass(frozen=True)
class Trial:
    """Settings of one training run; ``decay`` shrinks all weights at every step."""

    number: int
    learning_rate: float
    batch: int
    epochs: int
    decay: float


def bucket(word: str, width: int) -> int:
    """Place of a word from 1 to ``width`` - 1; place 0 is the constant."""
    return 1 + int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % (width - 1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into stretches of at most ``SLICE`` rows: what is built from one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def with_features(df: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``df`` with ``i`` and ``x`` in the place of ``text``: ascending places of its words, and their counts over the
    length of the vector of counts. The whole cleaned text is read. An empty or null text has the constant alone."""
    others = [c for c in df.columns if c != text]

    def places(batch: pa.Array) -> tuple[pa.Array, pa.Array]:
        cuts, places, values = [0], [], []
        for t in batch:
            words = (t.as_py() or "").split(" ")
            if len(known) + len(words) > REMEMBERED:
                known.clear()
            for w in words:
                if w and w not in known:
                    known[w] = bucket(w, width)
            i, n = np.unique(np.array([known[w] for w in words if w], np.int32), return_counts=True)
            places += [np.zeros(1, np.int32), i]
            values += [np.ones(1), n / np.sqrt(float((n * n).sum()) or 1.0)]
            cuts.append(cuts[-1] + len(i) + 1)
        ends = pa.array(cuts, pa.int32())
        flat = [np.concatenate(parts) if parts else np.zeros(0) for parts in (places, values)]
        return tuple(pa.ListArray.from_arrays(ends, pa.array(f, t)) for f, t in zip(flat, (pa.int32(), pa.float64()), strict=True))

    known: dict[str, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            i, x = places(b.column(text))
            kept = [b.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, i, x], names=[*others, "i", "x"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "i array<int>", "x array<double>"])
    return df.withColumn(text, F.lower(text)).select(*others, text).mapInArrow(run, schema)


def shards(rows: DataFrame, n_rows: int, order: str, key: str, label: str = "label", size: int = SHARD) -> DataFrame:
    """One row per shard: ``n`` and ``rows``, its rows in the order of the hash ``order`` (hexadecimal) and the key.

    A hash spreads rows evenly, so a shard holds about ``size`` rows of at most ``width`` places each.
    """
    n = max(1, -(-n_rows // size))
    share = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint") * n
    row = F.struct(F.col(order).alias("h"), F.col(key).cast("string").alias("k"), F.col(label).cast("int").alias("label"), "i", "x")
    dealt = rows.groupBy(F.shiftright(share, 32).alias("shard")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return dealt.select("shard", F.size("rows").cast("bigint").alias("n"), F.transform("rows", lambda r: F.struct(r["label"], r["i"], r["x"])).alias("rows"))


@dataclass
class Vectors:
    """Rows as one sparse matrix: row r has the places ``i`` and values ``x`` from ``cuts[r]`` to ``cuts[r + 1]``."""

    label: np.ndarray
    cuts: np.ndarray
    i: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, label: pa.Array, i: pa.Array, x: pa.Array) -> Vectors:
        cuts = np.append(0, np.cumsum(i.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        return cls(label.to_numpy(zero_copy_only=False), cuts, i.flatten().to_numpy(), x.flatten().to_numpy())

    def logits(self, weights: np.ndarray, a: int, z: int) -> np.ndarray:
        """Rows a to z: zero for the first class, then one column per weight vector."""
        at = slice(self.cuts[a], self.cuts[z])
        parts = weights[:, self.i[at]] * self.x[at]
        return np.concatenate([np.zeros((1, z - a)), np.add.reduceat(parts, self.cuts[a:z] - self.cuts[a], axis=1)]).T


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(rows: Vectors, weights: np.ndarray, t: Trial) -> np.ndarray:
    """Weights after one pass over the rows: per batch, shrink them and take a step down the mean gradient.

    Shrinking is a factor in front of all weights, so a step touches the batch's places only.
    """
    w, scale, rate = weights.copy(), 1.0, t.learning_rate * STEP
    classes = np.arange(1, len(w) + 1)
    for a in range(0, len(rows.label), t.batch):
        z = min(a + t.batch, len(rows.label))
        wrong = _probabilities(rows.logits(w, a, z) * scale)[:, 1:] - (rows.label[a:z, None] == classes)
        at = slice(rows.cuts[a], rows.cuts[z])
        size = np.diff(rows.cuts[a : z + 1])
        scale *= 1 - rate * t.decay / STEP
        for c in range(len(w)):
            np.add.at(w[c], rows.i[at], -rate / (z - a) / scale * np.repeat(wrong[:, c], size) * rows.x[at])
    return w * scale


WEIGHTS = "trial int, label int, i int, w double"


def epoch(dealt: DataFrame, n_rows: int, live: Sequence[Trial], weights: Mapping[int, np.ndarray]) -> DataFrame:
    """``trial, label, i, w``: the live trials' weights after one more epoch, one row per weight."""
    shared = dealt.sparkSession.sparkContext.broadcast({t.number: weights[t.number] for t in live})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t.number: np.zeros(shared.value[t.number].shape, np.int64) for t in live}
        for b in batches:
            for shard, n in zip(b.column("rows"), b.column("n").to_pylist(), strict=True):
                held = shard.values
                rows = Vectors.of(held.field("label"), held.field("i"), held.field("x"))
                for t in live:
                    moved = descend(rows, shared.value[t.number], t)
                    sums[t.number] += np.rint(moved * (n / n_rows * FIXED_POINT)).astype(np.int64)
        for number, s in sums.items():
            for c, row in enumerate(s):
                columns = [np.full(len(row), number, np.int32), np.full(len(row), c + 1, np.int32), np.arange(len(row), dtype=np.int32), row]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["trial", "label", "i", "s"])

    summed = dealt.mapInArrow(run, "trial int, label int, i int, s bigint").groupBy("trial", "label", "i").agg(F.sum("s").alias("s"))
    return summed.select("trial", "label", "i", (F.col("s") / FIXED_POINT).alias("w"))


def to_arrays(weights: DataFrame, classes: int, width: int) -> dict[int, np.ndarray]:
    """Weights per trial on the driver: trials x (classes - 1) x ``width`` numbers."""
    found = weights.toArrow()
    number, label, i, w = (found.column(c).to_numpy() for c in ("trial", "label", "i", "w"))
    out = {int(t): np.zeros((classes - 1, width)) for t in np.unique(number)}
    for t, held in out.items():
        own = number == t
        held[label[own] - 1, i[own]] = w[own]
    return out


def scored(rows: DataFrame, weights: Mapping[int, np.ndarray], columns: Sequence[str]) -> DataFrame:
    """``columns, trial, logits`` for rows with ``i`` and ``x``: one row per row and trial. Nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(weights))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = Vectors.of(pa.nulls(b.num_rows, pa.int32()), b.column("i"), b.column("x"))
            for number, w in sorted(shared.value.items()):
                z = held.logits(w, 0, b.num_rows)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
                trial = pa.array(np.full(b.num_rows, number, np.int32))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), trial, flat], names=[*columns, "trial", "logits"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "trial int", "logits array<double>"])
    return rows.select(*dict.fromkeys([*columns, "i", "x"])).mapInArrow(run, schema)


def pairs(scores: DataFrame, predicted: Column, loss: Column, by: Sequence[str] = ("trial",)) -> DataFrame:
    """Pair counts and summed loss per trial, for ``metrics.overall``; the loss does not depend on the order of the rows."""
    fixed = F.round(loss * LOSS_POINT).cast("bigint")
    counted = scores.groupBy(*by, F.col("label").alias("y_true"), predicted.alias("y_pred")).agg(
        F.count("*").alias("n"), F.sum(fixed).alias("loss")
    )
    return counted.withColumn("loss", F.col("loss") / LOSS_POINT)


def prepared(rows: DataFrame, width: int, columns: Sequence[str]) -> DataFrame:
    """The rows as vectors, written once: the text is read no more."""
    return materialize(with_features(rows.select(*columns, "text"), width), "vectors")
