"""The trainer against plain NumPy: shards, batches, averages, epochs that are stopped and restored."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonelab.functions.labels import THREE_CLASS, TWO_CLASS
from tonelab.operators import gradient, runs
from tonelab.operators.gradient import Trial
from tonelab.plans import training

WIDTH = 64
TRIALS = (Trial(1, 3e-5, 4, 3, 0.1), Trial(2, 5e-5, 7, 2, 0.0))


def reviews(n, classes, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        c = int(rng.integers(classes))
        own = [words[(int(w) + 9 * c) % 30] for w in rng.integers(0, 14, rng.integers(0, 20))]
        out.append((f"k{i}", "  ".join(own).strip(), c))
    return out


def vector(text):
    """Dense vector by the rules: constant, counts over their length."""
    counts = collections.Counter(1 + int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (WIDTH - 1) for w in text.lower().split(" ") if w)
    x = np.zeros(WIDTH)
    for i, n in counts.items():
        x[i] = n / np.sqrt(sum(m * m for m in counts.values()))
    x[0] = 1
    return x


def brute(rows, classes, trial, shard):
    """Weights after each epoch. ``rows``: (key, text, label) of the train part."""
    n_shards = max(1, -(-len(rows) // shard))
    dealt = collections.defaultdict(list)
    for key, text, label in rows:
        h = hashlib.md5(f"42|{key}".encode()).hexdigest()
        dealt[int(h[:8], 16) * n_shards >> 32].append((h, vector(text), label))
    w, out = np.zeros((classes - 1, WIDTH)), []
    for _ in range(trial.epochs):
        total = np.zeros_like(w)
        for own in dealt.values():
            own = sorted(own, key=lambda r: r[0])
            v = w.copy()
            for a in range(0, len(own), trial.batch):
                part, g = own[a : a + trial.batch], np.zeros_like(v)
                for _, x, label in part:
                    z = np.append(0, v @ x)
                    p = np.exp(z) / np.exp(z).sum()
                    for c in range(1, classes):
                        g[c - 1] += (p[c] - (label == c)) * x / len(part)
                v = v * (1 - trial.learning_rate * trial.decay) - trial.learning_rate * gradient.STEP * g
            total += v * len(own) / len(rows)
        w = total
        out.append(w)
    return out


@pytest.mark.parametrize("domain, shard", [(TWO_CLASS, 1000), (TWO_CLASS, 20), (THREE_CLASS, 32)])
def test_weights_and_log(spark, domain, shard):
    classes, rows = len(domain.names), reviews(150, len(domain.names))
    table = spark.createDataFrame(rows, "row_key string, text string, label int").repartition(5)
    t = training.train(table, domain, TRIALS, width=WIDTH, patience=None, shard=shard)
    role = {r["row_key"]: r["role"] for r in t.vectors.select("row_key", "role").collect()}
    assert collections.Counter(role.values()) == {"train": 96, "val": 24, "test": 30}
    train, val = ([r for r in rows if role[r[0]] == part] for part in ("train", "val"))
    log = {(r["trial"], r["epoch"]): r for r in t.log.collect()}
    assert set(log) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)}
    for trial in TRIALS:
        for e, want in enumerate(brute(train, classes, trial, shard), 1):
            assert t.restored(trial.number, e)[trial.number] == pytest.approx(want, abs=1e-9)
            z = np.array([np.append(0, want @ vector(text)) for _, text, _ in val])
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            label = np.array([r[2] for r in val])
            assert log[trial.number, e]["accuracy"] == pytest.approx(np.mean(z.argmax(axis=1) == label))
            assert log[trial.number, e]["loss"] == pytest.approx(-np.log(p[np.arange(len(val)), label]).mean(), abs=1e-8)
    found = {r["row_key"]: r for r in t.predict().collect()}
    number, epoch = t.best()
    best = brute(train, classes, next(x for x in TRIALS if x.number == number), shard)[epoch - 1]
    assert set(found) == {k for k, r in role.items() if r == "test"}
    for key, text, _ in rows:
        if key in found:
            assert found[key]["logits"] == pytest.approx(np.append(0, best @ vector(text)), abs=1e-8)


def test_layout_does_not_matter(spark):
    table = spark.createDataFrame(reviews(120, 2), "row_key string, text string, label int")
    logs = [sorted(training.train(d, TWO_CLASS, TRIALS, width=WIDTH, shard=16).log.collect()) for d in (table.coalesce(1), table.repartition(7))]
    assert logs[0] == logs[1]


def test_stopped_trials_leave_the_job(spark):
    """Stop epochs equal those of the whole log; a stopped trial has no weights and no log rows afterwards."""
    table = spark.createDataFrame(reviews(200, 2), "row_key string, text string, label int")
    trials = [Trial(1, 1e-9, 8, 6, 0.0), Trial(2, 4e-5, 8, 6, 0.0), Trial(3, 4e-5, 8, 2, 0.0)]
    whole = training.train(table, TWO_CLASS, trials, width=WIDTH, patience=None)
    short = training.train(table, TWO_CLASS, trials, width=WIDTH, patience=2)
    stops = {r["trial"]: (r["stop_epoch"], r["last_epoch"]) for r in runs.early_stop(whole.log, ["trial"], "f1_macro", patience=2).collect()}
    last = {t: stop or end for t, (stop, end) in stops.items()}
    assert stops[1][0] == 3 and last[3] == 2  # steps too small to change a prediction
    want = {(t, e) for t, end in last.items() for e in range(1, end + 1)}
    assert {(r["trial"], r["epoch"]) for r in short.log.collect()} == want
    assert {(r["trial"], r["epoch"]) for r in short.weights.select("trial", "epoch").distinct().collect()} == want
    both = whole.log.join(short.log, ["trial", "epoch"]).where(whole.log.f1_macro != short.log.f1_macro)
    assert both.count() == 0
    assert short.results().where("chosen").count() == 1


def test_no_text_is_moved_or_read_by_an_epoch(spark):
    table = spark.createDataFrame(reviews(60, 2), "row_key string, text string, label int")
    t = training.train(table, TWO_CLASS, TRIALS, width=WIDTH)
    assert "text" not in t.vectors.columns
    plan = t.predict()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_odd_tables(spark):
    schema = "row_key string, text string, label int"
    empty = training.train(spark.createDataFrame([], schema), TWO_CLASS, TRIALS, width=WIDTH)
    assert empty.predict().count() == 0 and empty.results().where("chosen").count() == 0
    odd = [(f"k{i}", t, i % 2) for i, t in enumerate(["", None, "a", "a  b", "É é " * 400, "ß"] * 5)]
    t = training.train(spark.createDataFrame(odd, schema), TWO_CLASS, TRIALS, width=WIDTH)
    assert t.predict().count() == 6
    alone = t.vectors.where(F.size("i") == 1).select("row_key").collect()
    assert len(alone) == 10  # null and empty texts have the constant alone
    with pytest.raises(ValueError):
        training.train(spark.createDataFrame([("k", "a", 0), ("k", "b", 1)], schema), TWO_CLASS, TRIALS, width=WIDTH)


def test_tasks_work_on_few_rows_at_once(spark):
    """A batch of many rows is cut; vectors and logits of the stretches are those of the rows alone."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(2 * gradient.SLICE + 3))})
    cut = list(gradient.slices([batch, batch.slice(0, 0)]))
    assert [b.num_rows for b in cut] == [gradient.SLICE, gradient.SLICE, 3] and [n for b in cut for n in b.column(0).to_pylist()] == batch.column(0).to_pylist()
    rows = spark.createDataFrame(reviews(1200, 2), "row_key string, text string, label int").coalesce(1)
    vectors = gradient.with_features(rows, WIDTH)
    found = {r["row_key"]: r for r in vectors.collect()}
    weights = {1: np.arange(WIDTH, dtype=float)[None] / WIDTH}
    logits = {r["row_key"]: r["logits"][1] for r in gradient.scored(vectors, weights, ["row_key"]).collect()}
    assert len(found) == len(logits) == 1200
    for key, text, _ in reviews(1200, 2):
        dense = np.zeros(WIDTH)
        dense[found[key]["i"]] = found[key]["x"]
        assert np.allclose(dense, vector(text)) and np.isclose(logits[key], dense @ weights[1][0])
