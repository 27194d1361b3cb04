"""Run logs: best epoch, early stop, trials, summaries."""

import random

import pytest
from pyspark.sql import functions as F

from tonelab.operators import compare, runs, trials

LOG = "run string, epoch int, f1 double"


def test_best_epoch_and_ties(spark):
    log = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, None), ("b", 2, 0.1)], LOG)
    best = {r["run"]: (r["epoch"], r["f1"]) for r in runs.best_epoch(log, ["run"], "f1").collect()}
    assert best == {"a": (2, 0.7), "b": (2, 0.1)}
    worst = {r["run"]: (r["epoch"], r["f1"]) for r in runs.best_epoch(log, ["run"], "f1", higher=False).collect()}
    assert worst == {"a": (1, 0.5), "b": (2, 0.1)}


def plain_stop(values, patience):
    best, waited = None, 0
    for epoch, v in enumerate(values, start=1):
        if best is None or v > best:
            best, waited = v, 0
        else:
            waited += 1
        if waited >= patience:
            return epoch
    return None


@pytest.mark.parametrize("chunk", [1, 3, 1024])
@pytest.mark.parametrize("patience", [1, 2, 4])
def test_early_stop_equals_the_plain_loop(spark, chunk, patience):
    draw = random.Random(7)
    series = {f"r{i}": [draw.randint(0, 12) / 10 for _ in range(draw.randint(1, 30))] for i in range(20)}
    series["rising"] = [i / 100 for i in range(40)]
    series["flat"] = [0.5] * 6
    rows = [(k, e, v) for k, vs in series.items() for e, v in enumerate(vs, start=1)]
    log = spark.createDataFrame(rows, LOG)
    out = runs.early_stop(log, ["run"], "f1", patience=patience, chunk_epochs=chunk)
    got = {r["run"]: (r["stop_epoch"], r["last_epoch"]) for r in out.collect()}
    assert got == {k: (plain_stop(vs, patience), len(vs)) for k, vs in series.items()}


@pytest.mark.parametrize("epochs", [[1, 2, 4], [1, 2, 2, 3], [1, 2, 2, 4], [1, None, 2], [1, 2, 5, 6], [None]])
@pytest.mark.parametrize("chunk", [2, 1024])
def test_early_stop_refuses_gaps_and_repeats(spark, epochs, chunk):
    log = spark.createDataFrame([("bad", e, 0.1) for e in epochs] + [("good", e, 0.1) for e in (4, 5, 6, 7)], LOG)
    with pytest.raises(Exception, match="must follow each other"):
        runs.early_stop(log, ["run"], "f1", chunk_epochs=chunk).collect()
    good = runs.early_stop(log.where("run = 'good'"), ["run"], "f1", chunk_epochs=chunk).first()
    assert (good["stop_epoch"], good["last_epoch"]) == (6, 7)
    assert runs.early_stop(log.limit(0), ["run"], "f1").count() == 0


def test_early_stop_shuffles_the_log_once(spark, tmp_path):
    spark.createDataFrame([("a", 1, 0.5), (None, 1, 0.5)], LOG).write.parquet(f"{tmp_path}/log")
    out = runs.early_stop(spark.read.parquet(f"{tmp_path}/log"), ["run"], "f1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The rows once; the chunks' maxima, combined by tasks, twice; the chunks once.
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 4
    assert {r["run"]: r["last_epoch"] for r in out.collect()} == {"a": 1, None: 1}


def test_epoch_numbers_over_chunks(spark):
    rows = [("a", d, d * 10 + i) for d in (1, 2, 5) for i in (3, 1, 2)] + [(None, 1, 7)]
    log = spark.createDataFrame(rows, "run string, day int, ts int")
    out = runs.number_epochs(log, ["run"], "day", ["ts"])
    a = [r["ts"] for r in out.filter("run = 'a'").orderBy("epoch").collect()]
    assert a == sorted(ts for run, _, ts in rows if run == "a")
    assert sorted(r["epoch"] for r in out.filter("run = 'a'").collect()) == list(range(1, 10))
    assert out.filter("run IS NULL").first()["epoch"] == 1


def test_best_trial(spark):
    rows = [("s", 1, 0.4, 8), ("s", 2, 0.9, 16), ("s", 3, 0.9, 32), ("t", 1, None, 8)]
    df = spark.createDataFrame(rows, "search string, trial int, objective double, batch int")
    up = runs.best_trial(df, ["search"], "objective", ["batch"]).collect()
    assert [tuple(r) for r in up] == [("s", 2, 0.9, 16)]
    down = runs.best_trial(df, ["search"], "objective", ["batch"], maximise=False).collect()
    assert [tuple(r) for r in down] == [("s", 1, 0.4, 8)]


def test_trial_table_stays_in_its_space(spark):
    searches = spark.range(50).select(F.concat(F.lit("s"), "id").alias("search"))
    drawn = trials.trial_table(searches, "search", trials.CLASSIFIER_SPACE, 3)
    assert dict(drawn.dtypes) == {
        "search": "string",
        "trial": "int",
        "learning_rate": "double",
        "per_device_train_batch_size": "int",
        "num_train_epochs": "int",
        "weight_decay": "double",
    }
    rows = drawn.collect()
    assert len(rows) == 150
    assert all(1e-5 <= r["learning_rate"] <= 5e-5 and 0 <= r["weight_decay"] <= 0.1 for r in rows)
    assert {r["per_device_train_batch_size"] for r in rows} == {8, 16, 32}
    assert {r["num_train_epochs"] for r in rows} == {2, 3, 4}
    texts = trials.trial_table(searches, "search", trials.TEXT_SPACE, 5).collect()
    assert {r["num_train_epochs"] for r in texts} == {2, 3, 4, 5, 6}


def test_settings_on_the_driver_equal_the_table(spark):
    searches = spark.createDataFrame([("s1",)], "search string")
    for space in (trials.CLASSIFIER_SPACE, trials.TEXT_SPACE):
        rows = trials.trial_table(searches, "search", space, 5).orderBy("trial").collect()
        plain = trials.draw_settings("s1", space, 5)
        for a, b in zip(rows, plain, strict=True):
            assert a.asDict() == pytest.approx({"search": "s1", **b}, abs=1e-11)


def test_runtime_summary(spark):
    df = spark.createDataFrame([("training", 3600.4), ("training", 61.2), ("inference", 9.9)], "stage string, seconds double")
    got = {r["stage"]: r["time_hms"] for r in runs.runtime_summary(df).collect()}
    assert got == {"training": "1:01:01", "inference": "0:00:09"}


def test_append_results(spark):
    a = spark.createDataFrame([(1, 0.5)], "K int, f1 double")
    b = spark.createDataFrame([(0.7, 3, "x")], "f1 double, K int, model string")
    assert sorted((r["K"], r["f1"], r["model"]) for r in runs.append_results(a, b).collect()) == [(1, 0.5, None), (3, 0.7, "x")]


def test_compare_models(spark):
    rows = [(1, "positive", "m1", "Positive"), (1, "positive", "m2", "Negative"), (2, "off", "m1", "Off")]
    df = spark.createDataFrame(rows, "row_key int, sentiment string, model string, pred_sentiment string")
    out = {r["row_key"]: r for r in compare.compare_models(df, ["m1", "m2"]).collect()}
    assert (out[1]["m1"], out[1]["m2"], out[1]["n_agree_gold"], out[1]["n_distinct"]) == ("Positive", "Negative", 1, 2)
    assert (out[2]["m2"], out[2]["n_agree_gold"], out[2]["n_distinct"]) == (None, 1, 1)


def test_attach_predictions_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_key int, text string")
    predictions = spark.createDataFrame([(2, 1)], "row_key int, y_pred int")
    out = compare.attach_predictions(rows, predictions).collect()
    assert {r["row_key"]: r["y_pred"] for r in out} == {1: None, 2: 1}


def test_nan_never_wins(spark):
    nan = float("nan")
    log = spark.createDataFrame([(1, e, m) for e, m in enumerate((0.5, nan, 0.7, 0.6, 0.6), 1)], "run int, epoch int, m double")
    assert runs.best_epoch(log, ["run"], "m").first()["epoch"] == 3
    assert runs.best_epoch(log, ["run"], "m", higher=False).first()["epoch"] == 1
    for up, want in ((True, 3), (False, 1)):
        assert runs.best_trial(log, ["run"], "m", [], trial="epoch", maximise=up).first()["epoch"] == want
    assert runs.early_stop(log, ["run"], "m").first()["stop_epoch"] == 5
