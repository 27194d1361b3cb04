"""Scoring in place, the saved artefact, streams, the Spark ML stage, user metrics, removed tables."""

import os

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tests.test_training import reviews
from tonelab.functions.labels import THREE_CLASS, TWO_CLASS
from tonelab.operators import metrics, naive_bayes, spark_ml
from tonelab.operators.naive_bayes import Candidate, Fit
from tonelab.plans import artefact, holdout, kfold, training
from tonelab.plans.experiment import predict_rows
from tonelab.sources import scratch

SCHEMA = "row_key string, text string, label int"
NAMES = ("negative", "positive")


@pytest.fixture(scope="module")
def prepared(spark):
    table = spark.createDataFrame(reviews(160, 2), SCHEMA).withColumn("id", F.col("row_key"))
    return table.withColumn("sentiment", F.element_at(F.array(*map(F.lit, NAMES)), F.col("label") + 1))


@pytest.fixture(scope="module")
def experiment(prepared):
    return holdout.holdout_experiment(prepared, TWO_CLASS)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_equals_join(spark, prepared):
    """Bit for bit, on odd texts too, for several candidates of several fits and three classes."""
    odd = ["", None, "w1", "w1  w2", " w1 w2 ", "W1 É w1", "nie gesehen", "w3 " * 5000, "a\tb", " w1"]
    rows = prepared.select("row_key", "text", "label").unionByName(spark.createDataFrame([(f"o{i}", t, i % 3) for i, t in enumerate(odd)], SCHEMA))
    model = naive_bayes.fit(rows, [Fit("a", "true"), Fit("b", "label <> 1 OR row_key > 'k5'")], (0, 1, 2))
    candidates = [Candidate("x", "a"), Candidate("y", "b", 0.01, 0.5), Candidate("z", "a", 10.0)]
    names = [f"logits_{c.name}" for c in candidates]
    looked = naive_bayes.with_logits(rows, model, candidates)
    assert looked.columns == [*rows.columns, *names] and "Exchange" not in physical(looked)
    want = {r["row_key"]: r for r in naive_bayes.score(rows, model, candidates).collect()}
    got = looked.collect()
    assert len(got) == len(want) and all(r[n] == want[r["row_key"]][n] for r in got for n in names)
    assert naive_bayes.with_logits(rows.limit(0), model, candidates).count() == 0


def test_joined_lookup_equals_lookup(spark, prepared, tmp_path):
    """Weights beyond a task, in tables and streams, with repeated rows and odd texts: the logits of the map."""
    odd = ["", None, "w1", "w1  w2", " w1 w2 ", "W1 É w1", "nie gesehen", "w3 " * 5000, "a\tb", " w1", "x" * 100, "x" * 100]
    rows = prepared.select("row_key", "text", "label").unionByName(spark.createDataFrame([(f"o{i}", t, i % 3) for i, t in enumerate(odd)], SCHEMA))
    rows = rows.unionByName(rows.where("label = 1")).withColumn("row_key", F.expr("nullif(row_key, 'o3')"))
    model = naive_bayes.fit(rows, [Fit("a", "true"), Fit("b", "label <> 1")], (0, 1, 2))
    candidates = [Candidate("x", "a"), Candidate("y", "b", 0.01, 0.5)]
    want = naive_bayes.with_logits(rows, model, candidates)
    order = lambda df: sorted(df.collect(), key=str)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    for held in (0, 2000, 1 << 20):
        got = naive_bayes.with_joined_logits(rows, model, candidates, held_bytes=held)
        assert got.columns == want.columns and order(got) == order(want)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        scored = naive_bayes.with_joined_logits(stream, model, candidates, held_bytes=held)
        options = {"path": f"{tmp_path}/out{held}", "checkpointLocation": f"{tmp_path}/state{held}"}
        scored.writeStream.format("parquet").options(**options).trigger(availableNow=True).start().awaitTermination()
        assert order(spark.read.schema(want.schema).parquet(options["path"])) == order(want)


def test_no_model_is_too_large_for_stage_and_artefact(spark, experiment, monkeypatch, tmp_path):
    """Without room for any weights in a task, stage and artefact give the same rows, also for a stream and repeated ids."""
    artefact.save(experiment, str(tmp_path / "model"))
    model = artefact.load(spark, str(tmp_path / "model"))
    stage = spark_ml.CountClassifier().fit(experiment.rows)
    raw = experiment.rows.select("id", "text")
    raw = raw.unionByName(raw.limit(5))
    raw.write.parquet(f"{tmp_path}/in")
    want = sorted(model.predict(raw).collect()), sorted(stage.transform(raw).collect())
    monkeypatch.setattr(naive_bayes, "can_look_up", lambda *_: False)
    assert (sorted(model.predict(raw).collect()), sorted(stage.transform(raw).collect())) == want
    stream = model.predict(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in"))
    options = {"path": f"{tmp_path}/out", "checkpointLocation": f"{tmp_path}/state"}
    stream.writeStream.format("parquet").options(**options).trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.read.parquet(options["path"]).collect()) == want[0]


def test_lookup_is_refused_beyond_its_size(prepared):
    model = naive_bayes.fit(prepared, [Fit("a", "true"), Fit("few", "true", max_tokens=3)], (0, 1))
    assert naive_bayes.can_look_up(model, [Candidate("x", "a")])
    assert not naive_bayes.can_look_up(model, [Candidate("x", "few")])
    assert not naive_bayes.can_look_up(model, [Candidate("x", "a")], limit=100)
    with pytest.raises(ValueError):
        naive_bayes.with_logits(prepared, model, [Candidate("x", "few")])


def test_no_text_is_moved(spark, experiment):
    """Without broadcast joins: no shuffle in the export, and the joined route gives the same rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (holdout.predict_all(experiment), holdout.predict_test(experiment), holdout.predict_text(experiment, "w1 w2")):
            assert "Exchange" not in physical(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    candidate = experiment.chosen_candidate(holdout.HOLDOUT)
    joined = predict_rows(experiment, candidate, lookup_bytes=0)
    assert "Join" in physical(joined)
    assert sorted(joined.collect()) == sorted(predict_rows(experiment, candidate).collect())


def test_artefact_scores_raw_rows(spark, experiment, tmp_path):
    path = str(tmp_path / "model")
    artefact.save(experiment, path)
    assert sorted(os.listdir(tmp_path)) == ["model"]  # nothing half written beside it
    with pytest.raises(FileExistsError):
        artefact.save(experiment, path)
    again = artefact.load(spark.newSession(), path)
    raw = [(1, " w1\nw2 ", "Positive"), (2, "w1", None), (3, None, "negative"), (4, " ", "negative"), (None, "w1", "negative")]
    table = spark.createDataFrame(raw, "id int, text string, sentiment string")
    labelled = again.predict(table).collect()
    assert [(r["id"], r["text"], r["sentiment"]) for r in labelled] == [(1, "w1 w2", "positive")]
    bare = {r["id"]: r for r in again.predict(table.drop("sentiment")).collect()}
    assert set(bare) == {1, 2} and bare[1]["prob_positive"] == labelled[0]["prob_positive"]
    one = holdout.predict_text(experiment, "w1 w2").first()
    assert bare[1]["prob_positive"] == one["prob_positive"] and bare[1]["pred_sentiment"] == one["pred_sentiment"]


def test_stream_gives_the_rows_of_the_batch(spark, experiment, tmp_path):
    path, source, out = (str(tmp_path / n) for n in ("model", "in", "out"))
    artefact.save(experiment, path)
    model = artefact.load(spark, path)
    raw = experiment.rows.select("id", "text")
    first, second = raw.where("id < 'k5'"), raw.where("id >= 'k5'")

    def run():
        stream = model.predict(spark.readStream.schema(raw.schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    first.coalesce(1).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == model.predict(first).count() > 0
    second.coalesce(1).write.mode("append").parquet(source)
    run()  # a new query goes on where the old one ended
    want = sorted(model.predict(raw).collect())
    assert sorted(spark.read.parquet(out).collect()) == want and len(want) > 100


def test_count_classifier_stage(prepared, tmp_path):
    stage = spark_ml.CountClassifier(smoothing=0.5, scoreCol="s", predictionCol="p", textCol="t")
    rows = prepared.withColumnRenamed("text", "t")
    fitted = Pipeline(stages=[stage]).fit(rows)
    fitted.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.stages[0].getOrDefault("smoothing") == 0.5 and again.stages[0].uid == fitted.stages[0].uid
    a, b = (m.transform(rows).select("row_key", "s", "p").collect() for m in (fitted, again))
    assert sorted(a) == sorted(b) and {r["p"] for r in a} == {0.0, 1.0}
    stage.write().save(str(tmp_path / "e"))
    assert spark_ml.CountClassifier.load(str(tmp_path / "e")).getOrDefault("scoreCol") == "s"
    grid = ParamGridBuilder().addGrid(stage.smoothing, [0.5, 5.0]).build()
    models = dict(stage.fitMultiple(rows, grid))
    assert models[0].counts is models[1].counts  # counted once
    assert models[1].transform(rows).select("s").collect() == stage.copy(grid[1]).fit(rows).transform(rows).select("s").collect()


def test_user_metrics(prepared):
    extra = {"kappa": metrics.KAPPA, "least_recall": "min(recall)"}
    e = kfold.kfold_experiment(prepared, TWO_CLASS, ks=(1,), extra=extra)
    row, cells = kfold.fold_results(e).first(), {(r["y_true"], r["y_pred"]): r["n"] for r in e.test_pairs().collect()}
    n = np.array([[cells.get((a, b), 0) for b in (0, 1)] for a in (0, 1)], float)
    po, pe = np.trace(n) / n.sum(), (n.sum(0) * n.sum(1)).sum() / n.sum() ** 2
    assert row["eval_kappa"] == pytest.approx((po - pe) / (1 - pe))
    assert row["eval_least_recall"] == pytest.approx(min(n[i, i] / n[i].sum() for i in (0, 1)))
    summary = kfold.fold_summary(kfold.fold_results(e), tuple(extra)).first()
    assert summary["eval_kappa_mean"] == row["eval_kappa"]
    assert e.chosen("kappa").first()["val_kappa"] is not None
    with pytest.raises(ValueError):
        metrics.overall(e.pairs, extra={"accuracy": "avg(recall)"})
    scores = holdout.predict_all(holdout.holdout_experiment(prepared, TWO_CLASS)).selectExpr("CAST(sentiment = 'positive' AS INT) AS label", "pred_id AS prediction")
    own = spark_ml.MetricEvaluator(metricName="kappa", expression=metrics.KAPPA).evaluate(scores)
    assert 0 < own <= 1


def test_closed_experiments_leave_nothing(spark, prepared):
    root = f"{scratch.scratch_root(spark)}/tonelab/{spark.sparkContext.applicationId}"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with holdout.holdout_experiment(prepared, TWO_CLASS) as e:
        assert e.folder and len(os.listdir(e.folder)) >= 3 and holdout.predict_all(e).count() == 160
    t = training.train(prepared, TWO_CLASS, [training.Trial(1, 3e-5, 8, 1, 0.0)], width=64)
    t.close()
    with pytest.raises(ValueError):  # refused rows leave nothing either
        holdout.holdout_experiment(prepared.unionAll(prepared), TWO_CLASS)
    assert set(os.listdir(root)) == before
    with pytest.raises(ValueError):
        scratch.remove(spark, "/tmp")


def test_three_classes_in_place(spark):
    rows = spark.createDataFrame(reviews(120, 3), SCHEMA).withColumns({"id": F.col("row_key"), "sentiment": F.lit("off")})
    e = holdout.holdout_experiment(rows, THREE_CLASS)
    got = holdout.predict_all(e).select("prob_negative", "prob_off", "prob_positive").collect()
    assert all(sum(r) == pytest.approx(1) for r in got) and len(got) == 120
