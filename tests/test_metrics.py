"""Metrics against published fold results, and on edge cases."""

import pytest
from pyspark.sql import functions as F

from tests import golden
from tonelab.functions.labels import THREE_CLASS, TWO_CLASS
from tonelab.operators import metrics, runs

FOLDS = golden.table(golden.FOLDS_HEADER, golden.FOLDS)
SUMMARY = golden.table(golden.SUMMARY_HEADER, golden.SUMMARY)
MODEL = ["model", "K", "fold"]


@pytest.fixture(scope="module")
def pairs(spark):
    cells = [
        (r["model"], int(r["K"]), int(r["fold"]), t, p, int(r["AB"[t] + "AB"[p]]))
        for r in FOLDS
        for t in (0, 1)
        for p in (0, 1)
    ]
    return spark.createDataFrame(cells, "model string, K int, fold int, y_true int, y_pred int, n bigint")


def test_overall_equals_published_folds(pairs):
    got = {(r["model"], r["K"], r["fold"]): r for r in metrics.overall(pairs, MODEL).collect()}
    assert len(got) == 16
    for r in FOLDS:
        mine = got[r["model"], r["K"], r["fold"]]
        for m in ("accuracy", "f1_macro", "precision_macro", "recall_macro"):
            assert mine[m] == pytest.approx(r[m], abs=1e-8)
        assert mine["recall_weighted"] == pytest.approx(mine["accuracy"], abs=1e-12)


def test_rows_give_the_same_as_pair_counts(spark, pairs):
    one = pairs.filter("model = 'T5' AND K = 1")
    rows = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).filter("n > 0")
    a = metrics.overall(metrics.pair_counts(rows)).first()
    b = metrics.overall(one).first()
    assert a.asDict() == pytest.approx(b.asDict())


def test_summary_equals_published(spark, pairs):
    seconds = spark.createDataFrame(
        [(r["model"], int(r["K"]), int(r["fold"]), r["train_seconds"], r["test_seconds"]) for r in FOLDS],
        "model string, K int, fold int, train_seconds double, test_seconds double",
    )
    results = metrics.overall(pairs, MODEL).join(seconds, MODEL)
    names = ["accuracy", "f1_macro", "precision_macro", "recall_macro", "train_seconds", "test_seconds"]
    got = {(r["model"], r["K"]): r for r in runs.fold_summary(results, names, ["model", "K"]).collect()}
    for r in SUMMARY:
        mine = got[r["model"], r["K"]]
        for name in golden.SUMMARY_HEADER[2:]:
            if r[name] is None:
                assert mine[name] is None
            else:
                assert mine[name] == pytest.approx(r[name], abs=1e-7)


def test_throughput_equals_published(spark):
    df = spark.createDataFrame([(i, int(r["test_n"]), r["runtime"]) for i, r in enumerate(FOLDS)], "i int, n int, s double")
    for batch, models in ((16, {"BERT", "RoBERTa", "BART"}), (8, {"T5"})):
        for r in runs.throughput(df, "n", "s", batch).collect():
            published = FOLDS[r["i"]]
            if published["model"] in models:
                assert r["rows_per_second"] == pytest.approx(published["rows_per_second"], abs=1e-3)
                assert r["steps_per_second"] == pytest.approx(published["steps_per_second"], abs=1e-3)


def ratings(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_pred int")


def test_confusion_matrix_has_all_cells(spark):
    df = ratings(spark, [(0, 0), (0, 1), (1, 1), (1, 1)])
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(df, THREE_CLASS.ids).collect()}
    assert len(cells) == 9
    assert {k: v for k, v in cells.items() if v} == {(0, 0): 1, (0, 1): 1, (1, 1): 2}
    wide = metrics.confusion_wide(metrics.confusion_matrix(df, THREE_CLASS.ids), THREE_CLASS.ids).orderBy("y_true")
    assert [tuple(r) for r in wide.collect()] == [(0, 1, 1, 0), (1, 0, 2, 0), (2, 0, 0, 0)]


def test_confusion_matrix_of_nothing(spark):
    df = ratings(spark, [(0, 0)]).filter("y_true > 5")
    assert [r["n"] for r in metrics.confusion_matrix(df, TWO_CLASS.ids).collect()] == [0, 0, 0, 0]


def test_observed_labels_only(spark):
    df = ratings(spark, [(0, 2), (2, 2)])
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_observed(df).collect()}
    assert cells == {(0, 0): 0, (0, 2): 1, (2, 0): 0, (2, 2): 1}


def test_zero_denominators_and_absent_classes(spark):
    df = ratings(spark, [(0, 0), (0, 0), (1, 0)])
    rows = {r["label"]: r for r in metrics.per_class(metrics.pair_counts(df)).collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[1]["f1"], rows[1]["support"]) == (0, 0, 0, 1)
    total = metrics.overall(metrics.pair_counts(df)).first()
    # Two classes were seen, so the macro mean is over two, not three.
    assert total["f1_macro"] == pytest.approx(0.4)
    assert total["f1_weighted"] == pytest.approx(0.8 * 2 / 3)


def test_report(spark):
    df = ratings(spark, [(0, 0), (0, 1), (1, 1)])
    report = {r["name"]: r for r in metrics.classification_report(metrics.pair_counts(df), TWO_CLASS).collect()}
    assert set(report) == {"Negative", "Positive", "accuracy", "macro avg", "weighted avg"}
    assert report["Negative"]["recall"] == 0.5
    assert report["accuracy"]["f1"] == 0.6667
    assert report["accuracy"]["precision"] is None
    assert report["weighted avg"]["support"] == 3


def test_exact_match(spark):
    rows = [("topic", "prompt", "room", "room"), ("topic", "prompt", "bed", "room"), ("topic", "prefix", None, "room")]
    df = spark.createDataFrame(rows, "task string, style string, pred_text string, gold_text string")
    got = {(r["task"], r["style"]): r["accuracy"] for r in metrics.exact_match(df).collect()}
    assert got == {("topic", "prompt"): 0.5, ("topic", "prefix"): 0.0}
