"""Search by training: all drawn trials are trained together, logged, stopped and restored.

After each epoch the weights and the validation metrics of the trials that are live are
appended to two tables, keyed by trial and epoch. A trial leaves the next job when it has had its epochs, or
when its metric has not become better for ``patience`` epochs. At the end the best
epoch of the best trial is read back from the weight table; nothing is fitted again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.functions.labels import LabelDomain
from tonelab.functions.scores import argmax, cross_entropy
from tonelab.operators import gradient, metrics, runs, stratified
from tonelab.operators.gradient import Trial
from tonelab.operators.trials import CLASSIFIER_SPACE, CLASSIFIER_TRIALS, Space, draw_settings
from tonelab.plans.experiment import HASH, KEY, require_keys
from tonelab.sources.scratch import materialize, remove, scope, scratch_path

WIDTH = 1 << 18
PATIENCE = 2
LOG = ("loss", "accuracy", "f1_macro")


@dataclass(frozen=True)
class Training:
    """``vectors``: the rows with their ``role``; ``log``: ``trial, epoch`` and metrics; ``weights``: ``trial, epoch, label, i, w``."""

    vectors: DataFrame
    domain: LabelDomain
    width: int
    trials: tuple[Trial, ...]
    log: DataFrame
    weights: DataFrame
    metric: str
    higher: bool
    folder: str

    def close(self) -> None:
        """Remove vectors, log and weights."""
        remove(self.vectors.sparkSession, self.folder)

    def best_epochs(self) -> DataFrame:
        """Best epoch of each trial: ``trial, epoch`` and the metric."""
        return runs.best_epoch(self.log, ["trial"], self.metric, higher=self.higher)

    def best(self) -> tuple[int, int] | None:
        """Trial and epoch with the best metric; the lowest trial number on ties. A handful of rows."""
        found = runs.best_trial(self.best_epochs().withColumn("all", F.lit(1)), ["all"], self.metric, ["epoch"], maximise=self.higher).first()
        return (found["trial"], found["epoch"]) if found else None

    def restored(self, trial: int, epoch: int) -> dict[int, np.ndarray]:
        """The weights of one epoch, from the weight table."""
        kept = self.weights.where((F.col("trial") == trial) & (F.col("epoch") == epoch))
        return gradient.to_arrays(kept, len(self.domain.names), self.width)

    def predict(self, role: str = "test", columns: Sequence[str] = (KEY, "label")) -> DataFrame:
        """``columns, trial, epoch, logits, pred_id`` of a part, by the best epoch of the best trial."""
        trial, epoch = self.best() or (None, None)
        weights = self.restored(trial, epoch) if trial is not None else {}
        scores = gradient.scored(self.vectors.where(F.col("role") == role), weights, columns)
        return scores.withColumns({"epoch": F.lit(epoch).cast("int"), "pred_id": argmax(F.col("logits"))})

    def test_metrics(self) -> DataFrame:
        """Loss and overall metrics on the test part, for the restored weights."""
        loss = cross_entropy("logits", "label", len(self.domain.names))
        counted = gradient.pairs(self.predict(), F.col("pred_id"), loss, by=("trial", "epoch"))
        return metrics.overall(counted, ["trial", "epoch"], means=["loss"])

    def results(self) -> DataFrame:
        """One row per trial: settings, epochs trained, best epoch with its metrics, and whether it was chosen."""
        spark = self.log.sparkSession
        rows = [(t.number, t.learning_rate, t.batch, t.epochs, t.decay) for t in self.trials]
        schema = "trial int, learning_rate double, per_device_train_batch_size int, num_train_epochs int, weight_decay double"
        settings = spark.createDataFrame(rows, schema)
        last = self.log.groupBy("trial").agg(F.max("epoch").alias("epochs_trained"))
        best = self.best_epochs().select("trial", "epoch").join(self.log, ["trial", "epoch"]).withColumnRenamed("epoch", "best_epoch")
        chosen = self.best()
        mark = F.col("trial") == F.lit(chosen[0] if chosen else None)
        return settings.join(last, "trial", "left").join(best, "trial", "left").withColumn("chosen", F.coalesce(mark, F.lit(False)))


def train(
    prepared: DataFrame, domain: LabelDomain, trials: Sequence[Trial], *, layout: stratified.Layout | None = None, width: int = WIDTH,
    patience: int | None = PATIENCE, metric: str = "f1_macro", higher: bool = True, shard: int = gradient.SHARD, seed: int = 42,
) -> Training:
    """Train all ``trials`` on the train part of ``prepared`` (``row_key, text, label``), 64/16/20 by default.

    Texts are hashed to ``width`` places once, whole, and written; no epoch reads a text. Null and
    NaN metrics are never better. Without training rows the weights stay zero.
    """
    with scope(prepared.sparkSession, "training") as folder:
        spark, classes = prepared.sparkSession, len(domain.names)
        rows = prepared.withColumn(HASH, F.expr(stratified.order_hash(KEY, seed)))
        vectors = gradient.prepared(rows, width, [KEY, HASH, "label"])
        require_keys(vectors)
        cuts = stratified.fit_cuts(vectors, {"split": layout or stratified.nested()}, domain.ids, hash_column=HASH)
        vectors = cuts.assign(vectors, {"split": "role"})
        n_train = cuts.size("split", "train")
        dealt = materialize(gradient.shards(vectors.where("role = 'train'"), n_train, HASH, KEY, size=shard), "shards")
        held = vectors.where("role = 'val'")
        log, table = scratch_path(spark, "epoch-log"), scratch_path(spark, "epoch-weights")
        weights = {t.number: np.zeros((classes - 1, width)) for t in trials}
        live, best = list(trials), {t.number: (None, 0) for t in trials}
        loss = cross_entropy("logits", "label", classes)
        done = 0
        while live:
            done += 1
            gradient.epoch(dealt, n_train, live, weights).write.parquet(f"{table}/epoch={done}")
            weights = gradient.to_arrays(spark.read.parquet(f"{table}/epoch={done}"), classes, width)
            weights = {t.number: weights.get(t.number, np.zeros((classes - 1, width))) for t in live}
            counted = gradient.pairs(gradient.scored(held, weights, ["label"]), argmax(F.col("logits")), loss)
            metrics.overall(counted, ["trial"], means=["loss"]).select("trial", *LOG).coalesce(1).write.parquet(f"{log}/epoch={done}")
            reached = {r["trial"]: r[metric] for r in spark.read.parquet(f"{log}/epoch={done}").collect()}  # one row a trial
            for t in live:
                value = reached.get(t.number)
                value = None if value is None or np.isnan(value) else (value if higher else -value)
                top, _ = best[t.number]
                if value is not None and (top is None or value > top):
                    best[t.number] = (value, done)
            live = [t for t in live if done < t.epochs and (patience is None or done - best[t.number][1] < patience)]
        read = lambda path, schema: spark.read.schema(f"{schema}, epoch int").parquet(path)
        logged = read(log, "trial int, " + ", ".join(f"{c} double" for c in LOG))
        return Training(vectors, domain, width, tuple(trials), logged, read(table, gradient.WEIGHTS), metric, higher, folder)


def draw_trials(n_trials: int = CLASSIFIER_TRIALS, space: Space = CLASSIFIER_SPACE, search: str = "classifier", seed: int = 42) -> list[Trial]:
    """Trials with drawn learning rate, batch size, epochs and decay."""
    names = {"learning_rate": "learning_rate", "per_device_train_batch_size": "batch", "num_train_epochs": "epochs", "weight_decay": "decay"}
    drawn = draw_settings(search, space, n_trials, seed)
    return [Trial(number=row["trial"], **{to: row.get(name, 0.0) for name, to in names.items()}) for row in drawn]


def search_classifier(prepared: DataFrame, domain: LabelDomain, n_trials: int = CLASSIFIER_TRIALS, *, seed: int = 42, **options) -> Training:
    """Draw settings, train all of them, keep the best epoch of the best one. ``options``: those of ``train``."""
    return train(prepared, domain, draw_trials(n_trials, seed=seed), seed=seed, **options)
