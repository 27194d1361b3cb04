"""Holdout experiment: fit on train, choose on val, report on test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.functions.labels import LabelDomain
from tonelab.operators import metrics, stratified
from tonelab.operators.stratified import Run
from tonelab.plans.experiment import DEFAULT_SETTINGS, Experiment, Setting, predict_rows, run_experiment
from tonelab.sources.tables import write_table

HOLDOUT = Run(1, 1, "holdout")


def holdout_experiment(
    prepared: DataFrame,
    domain: LabelDomain,
    settings: Sequence[Setting] = DEFAULT_SETTINGS,
    *,
    layout: stratified.Layout | None = None,
    seed: int = 42,
    validate_on_test: bool = False,
    extra: Mapping[str, str] | None = None,
) -> Experiment:
    """80/10/10 by default. With ``validate_on_test`` there is no val part (80/20)."""
    if layout is None:
        layout = stratified.train_test() if validate_on_test else stratified.train_val_test()
    return run_experiment(
        prepared, domain, {"holdout": layout}, [HOLDOUT], settings, seed=seed, validate_on_test=validate_on_test, extra=extra
    )


def test_metrics(e: Experiment) -> DataFrame:
    """Loss and overall metrics on the test part, with the chosen setting."""
    return e.chosen().withColumn("leaky", F.lit(e.leaky))


def test_report(e: Experiment) -> DataFrame:
    return metrics.classification_report(e.test_pairs(), e.domain)


def test_confusion(e: Experiment, labels: Sequence[int] | None = None) -> DataFrame:
    """Confusion matrix of the test part over the given label list."""
    return metrics.confusion_matrix(e.test_pairs(), e.domain.ids if labels is None else labels, weight="n")


def predict_all(e: Experiment) -> DataFrame:
    """Predictions of the chosen model for all rows, training rows included."""
    return predict_rows(e, e.chosen_candidate(HOLDOUT)).drop("label")


def export_predictions(e: Experiment, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the predictions of all rows; returns the runtime summary with the inference stage."""
    e.stopwatch.start()
    write_table(predict_all(e), path, fmt)
    e.stopwatch.lap("inference")
    return e.stopwatch.table(e.rows.sparkSession)


def predict_test(e: Experiment) -> DataFrame:
    """Predictions for the test rows only, with a flag for correct ones."""
    test = e.rows.filter(F.col("role_holdout") == "test")
    out = predict_rows(e, e.chosen_candidate(HOLDOUT), test)
    return out.select(
        "id",
        "text",
        "sentiment",
        "label",
        "pred_sentiment",
        (F.col("pred_id") == F.col("label")).alias("correct"),
        F.lit(e.leaky).alias("leaky"),
    )


def predict_text(e: Experiment, text: str) -> DataFrame:
    """Prediction for one text that is not in the table."""
    spark = e.rows.sparkSession
    schema = "row_key string, id string, text string, sentiment string, label int"
    one = spark.createDataFrame([("adhoc", "adhoc", text, None, None)], schema)
    return predict_rows(e, e.chosen_candidate(HOLDOUT), one).drop("id", "sentiment", "label")
