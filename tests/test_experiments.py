"""Whole experiments, scorers, sinks and plan shapes."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tonelab.functions.labels import THREE_CLASS, TWO_CLASS
from tonelab.functions.text import clean_text
from tonelab.operators import batch_scorer, clean, metrics, naive_bayes, spark_ml, stratified
from tonelab.plans import holdout, kfold, search
from tonelab.sources import scratch, tables

GOOD = ["lovely room", "great view", "kind staff", "great room and kind staff", "lovely stay"]
BAD = ["dirty room", "rude staff", "awful view", "dirty bed and rude staff", "awful stay"]


def review_rows(spark, n=200, labels=("positive", "negative")):
    words = {"positive": GOOD, "negative": BAD, "off": ["room", "staff", "view", "bed", "stay"]}
    data = []
    for i in range(n):
        label = labels[i % len(labels)] if i % 5 else labels[0]
        data.append((i, f"{words[label][i % 5]}\nnumber{i % 7}", label.capitalize()))
    return spark.createDataFrame(data, "id int, text string, sentiment string")


@pytest.fixture(scope="module")
def prepared(spark):
    return clean.dataset_remove_off(review_rows(spark)).withColumn("row_key", F.col("id"))


@pytest.fixture(scope="module")
def folds(prepared):
    return kfold.kfold_experiment(prepared, TWO_CLASS)


@pytest.fixture(scope="module")
def single(prepared):
    return holdout.holdout_experiment(prepared, TWO_CLASS)


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_written_fold_results(spark, folds, tmp_path):
    kfold.write_results(folds, str(tmp_path))
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("fold_results", "fold_summary", "runtime")}
    rows = read["fold_results"].collect()
    assert len(rows) == 4 and read["fold_summary"].count() == 2 and read["runtime"].count() == 3
    for r in rows:
        assert r["epoch"] == 1.0 and r["eval_runtime"] == r["test_seconds"]
        assert r["eval_samples_per_second"] == pytest.approx(r["test_n"] / r["eval_runtime"])
        assert r["eval_steps_per_second"] == pytest.approx(-(-r["test_n"] // kfold.EVAL_BATCH) / r["eval_runtime"])


def test_fold_results(folds):
    rows = kfold.fold_results(folds, timings=True).orderBy("K", "fold").collect()
    assert [(r["K"], r["fold"]) for r in rows] == [(1, 1), (3, 1), (3, 2), (3, 3)]
    assert [(r["train_n"], r["val_n"], r["test_n"]) for r in rows] == [(128, 32, 40), (106, 54, 40), (107, 53, 40), (107, 53, 40)]
    assert all(r["eval_accuracy"] == 1.0 and r["eval_f1_macro"] == 1.0 for r in rows)
    assert all(0 < r["eval_loss"] < 0.5 and r["train_seconds"] > 0 for r in rows)
    summary = {r["K"]: r for r in kfold.fold_summary(kfold.fold_results(folds, timings=True)).collect()}
    assert summary[1]["eval_accuracy_std"] is None and summary[3]["eval_accuracy_std"] == 0.0
    assert summary[3]["train_seconds_mean"] > 0


def test_runs_in_one_job_equal_runs_alone(prepared, folds):
    """Each fold fitted on its own training rows gives the same scores."""
    rows = folds.cuts.assign(prepared.withColumn("row_hash", F.expr(stratified.order_hash("row_key", 42))), {"k3": "r"})
    rows = rows.select("row_key", "text", "label", "r")
    run = folds.runs[2]
    candidate = folds.candidate(run, 1)
    alone = naive_bayes.fit(rows.filter("r NOT IN ('test', 'fold2')"), [naive_bayes.Fit(candidate.fit, "true")], (0, 1))
    test = rows.filter("r = 'test'")
    a = naive_bayes.score(test, alone, [candidate])
    b = naive_bayes.score(test, folds.model, [candidate])
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_holdout(single):
    assert holdout.test_metrics(single).first()["accuracy"] == 1.0
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in holdout.test_confusion(single, THREE_CLASS.ids).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 20
    assert {r["name"] for r in holdout.test_report(single).collect()} == {"Negative", "Positive", "accuracy", "macro avg", "weighted avg"}
    stages = {r["stage"] for r in single.stopwatch.table(single.rows.sparkSession).collect()}
    assert stages >= {"preparation", "training", "evaluation"}


def test_prediction_export(single, tmp_path):
    out = holdout.predict_all(single)
    assert out.columns == ["id", "text", "sentiment", "pred_id", "pred_sentiment", "prob_negative", "prob_positive"]
    assert out.count() == 200
    assert out.filter("abs(prob_negative + prob_positive - 1) > 1e-9").count() == 0
    assert out.filter("lower(pred_sentiment) <> sentiment").count() == 0
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        tables.write_table(out.withColumn("model", F.lit("m")), path, fmt, partition_by=["model"])
        back = tables.read_table(out.sparkSession, path, fmt, out.schema).select(out.columns)
        assert sorted(map(str, back.collect())) == sorted(map(str, out.collect()))


def test_export_adds_the_inference_stage(single, tmp_path):
    summary = holdout.export_predictions(single, str(tmp_path / "out"), "csv")
    assert "inference" in {r["stage"] for r in summary.collect()}
    tables.write_table(summary, str(tmp_path / "runtime"), "csv")
    assert tables.read_table(summary.sparkSession, str(tmp_path / "out"), "csv").count() == 200


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nthere, you', "a\\b")], "id int, text string, sentiment string")
    tables.write_table(df, str(tmp_path / "t"), "csv")
    back = tables.read_table(spark, str(tmp_path / "t"), "csv", df.schema)
    assert back.collect() == df.collect()


def test_csv_keeps_blanks_empties_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "  lead\n"), (2, "\tx "), (3, ""), (4, None), (5, "\\N x")], "id int, text string")
    tables.write_table(df, str(tmp_path / "t"), "csv")
    back = tables.read_table(spark, str(tmp_path / "t"), "csv", df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_keys_must_be_unique(prepared):
    with pytest.raises(ValueError, match="repeats"):
        holdout.holdout_experiment(prepared.unionByName(prepared), TWO_CLASS)


def test_predict_one_text(single):
    good = holdout.predict_text(single, "a lovely room").first()
    bad = holdout.predict_text(single, "rude and dirty").first()
    assert (good["pred_sentiment"], bad["pred_sentiment"]) == ("Positive", "Negative")
    assert good["prob_positive"] > 0.5


def test_predict_test_rows_is_marked_leaky(prepared):
    e = holdout.holdout_experiment(prepared, TWO_CLASS, validate_on_test=True)
    out = holdout.predict_test(e)
    assert out.count() == 40
    row = out.first()
    assert row["leaky"] and row["correct"] and "pred_text_raw" not in out.columns
    assert holdout.test_metrics(e).first()["leaky"]


def test_search(prepared):
    e = search.search_experiment(prepared, TWO_CLASS)
    rows = search.trial_results(e).orderBy("trial").collect()
    assert [r["trial"] for r in rows] == [1, 2, 3, 4, 5]
    best = e.chosen().first()
    assert best["val_f1_macro"] == max(r["f1_macro"] for r in rows)
    least = e.chosen("loss", maximise=False).first()
    assert least["val_loss"] == min(r["loss"] for r in rows)


def test_guard_on_too_few_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="need at least 8"):
        tables.select_by_position(df)


def test_select_by_position_with_odd_names(spark):
    df = spark.createDataFrame([tuple(range(8))], ", ".join(f"`col {i}.x` int" for i in range(8)))
    assert [tuple(r) for r in tables.select_by_position(df).collect()] == [(0, 6, 7)]


def test_read_reviews_from_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, *"abcde", "two\nlines", "Positive")], "i int, a string, b string, c string, d string, e string, t string, s string")
    tables.write_table(df, str(tmp_path / "sheet"), "csv")
    got = tables.read_reviews(spark, str(tmp_path / "sheet"), "csv", df.schema).first()
    assert tuple(got) == (1, "two\nlines", "Positive")


def classifier():
    def predict(vectors):
        return np.stack([vectors[:, 0], vectors[:, 1]], axis=1)

    return predict


def test_batch_classifier(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(150)], "id int, v array<double>")
    logits = batch_scorer.logits_column(classifier, F.col("v"), input_shapes=[[2]])
    out = batch_scorer.classify(df, logits, TWO_CLASS)
    got = {r["id"]: (r["pred_id"], r["pred_sentiment"]) for r in out.collect()}
    assert got[0] == (1, "Positive") and got[1] == (0, "Negative") and got[2] == (0, "Negative")
    assert "Exchange" not in plan(out)


def test_spark_ml_round_trip_and_evaluator(spark, prepared, tmp_path):
    cuts = stratified.fit_cuts(prepared, {"s": stratified.train_test()}, (0, 1))
    rows = cuts.assign(prepared, {"s": "role"})
    train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'")
    model = spark_ml.text_classifier(features=1 << 10, max_iter=5).fit(train)
    spark_ml.save_model(model, str(tmp_path / "m"))
    again = spark_ml.load_model(str(tmp_path / "m"))
    evaluator = spark_ml.MetricEvaluator()
    score = evaluator.evaluate(model.transform(test))
    assert score == evaluator.evaluate(again.transform(test)) and score > 0.9
    expected = metrics.overall(metrics.pair_counts(model.transform(test), true="label", pred="prediction")).first()
    assert score == pytest.approx(expected["f1_macro"])


def test_cross_validation_with_our_folds(prepared):
    cuts = stratified.fit_cuts(prepared, {"k3": stratified.kfold(3)}, (0, 1))
    rows = cuts.assign(prepared, {"k3": "role"}).filter("role <> 'test'")
    rows = rows.withColumn("fold", F.expr("CAST(substring(role, 5) AS INT) - 1"))
    pipeline = spark_ml.text_classifier(features=1 << 8, max_iter=2)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].regParam, [0.01]).build()
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=spark_ml.MetricEvaluator(), numFolds=3, foldCol="fold")
    assert cv.fit(rows).avgMetrics[0] > 0.8


def test_row_operators_accept_a_stream(spark, tmp_path):
    review_rows(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string, sentiment string").parquet(str(tmp_path / "in"))
    out = clean.dataset_with_off(stream).withColumn("clean", clean_text(F.col("text")))
    query = out.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("cleaned").count() == 200


def test_split_plan_is_narrow(prepared, single):
    roles = single.cuts.assign(single.rows.drop("role_holdout"), {"holdout": "role"}).select("row_key", "label", "role")
    text = plan(roles)
    assert "Exchange" not in text and "Window" not in text
    assert "text" not in text.split("ReadSchema")[1].split("\n")[0]


def test_scoring_plan_joins_once(single):
    candidates = [single.candidate(holdout.HOLDOUT, i) for i in range(3)]
    text = plan(naive_bayes.score(single.rows, single.model, candidates))
    tree = text.split("\n\n")[0]
    assert tree.count("Join") == 1 and tree.count(" Exchange") == 1 and "CartesianProduct" not in tree
    large = plan(naive_bayes.score(single.rows, single.model, candidates, broadcast_bytes=0)).split("\n\n")[0]
    assert "SortMergeJoin" in large and "Cartesian" not in large and "NestedLoop" not in large


def test_scratch_folder_comes_from_the_session(spark, monkeypatch):
    old = spark.conf.get(scratch.SETTING, None)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: "/shared/x/" if key == scratch.SETTING else old)
    assert scratch.scratch_path(spark, "t").startswith(f"/shared/x/tonelab/{spark.sparkContext.applicationId}/t-")
