"""One query per operator, each over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from tonelab.functions import generated, prompts, scores, text, tokens
from tonelab.functions.labels import THREE_CLASS, TWO_CLASS
from tonelab.operators import batch_scorer, clean, compare, keys, metrics, naive_bayes, runs, spark_ml, stratified, trials
from tonelab.plans import artefact, experiment, holdout, kfold, search, text_to_text, training
from tonelab.sources import scratch, tables

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double, so the last bits of two engines do not count."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- scans, projections, filters ------------------------------------------------


def load_reviews(spark, sf):
    return inputs.sheet(spark, sf)


def select_by_position(spark, sf):
    return inputs.reviews(spark, sf)


def drop_null_subset(spark, sf):
    return clean.drop_null_subset(inputs.reviews(spark, sf), ["text", "sentiment"])


def drop_null_any(spark, sf):
    return clean.drop_null_any(inputs.sheet(spark, sf)).select("doc_id", "quality", "toxic", "sentiment")


def clean_text(spark, sf):
    return clean.with_clean_text(inputs.reviews(spark, sf)).select("id", "text")


def drop_empty_text(spark, sf):
    """Over the lines of all documents, of which some are blank."""
    lines = inputs.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return clean.drop_empty_text(clean.with_clean_text(lines))


def normalise_label(spark, sf):
    return inputs.reviews(spark, sf).select("id", text.normalise_label(F.col("sentiment")).alias("sentiment"))


def missing_to_off(spark, sf):
    label = text.missing_to_off(text.normalise_label(F.col("sentiment")))
    return inputs.reviews(spark, sf).select("id", label.alias("sentiment"))


def keep_label_domain(spark, sf):
    label = text.normalise_label(F.col("sentiment"))
    rows = inputs.reviews(spark, sf).select("id", label.alias("sentiment"))
    return clean.keep_label_domain(rows, TWO_CLASS)


def dataset_with_off(spark, sf):
    return clean.dataset_with_off(inputs.reviews(spark, sf))


def dataset_remove_off(spark, sf):
    return clean.dataset_remove_off(inputs.reviews(spark, sf))


def encode_label(spark, sf):
    rows = clean.dataset_with_off(inputs.reviews(spark, sf))
    return rows.select("id", "sentiment", THREE_CLASS.encode(F.col("sentiment")).alias("label"))


def decode_label(spark, sf):
    return inputs.rated(spark, sf).select("id", "y_pred", THREE_CLASS.decode(F.col("y_pred")).alias("pred_sentiment"))


def correct_flag(spark, sf):
    return inputs.rated(spark, sf).select("id", "y_true", "y_pred", metrics.correct_flag().alias("correct"))


# --- splits ---------------------------------------------------------------------


def _split(spark, sf, layout, domain=TWO_CLASS):
    rows = inputs.prepared(spark, sf, domain).select("id", "row_key", "label")
    cuts = stratified.fit_cuts(rows, {"split": layout}, domain.ids)
    return cuts.assign(rows, {"split": "role"}).select("id", "label", "role")


def split_train_test(spark, sf):
    return _split(spark, sf, stratified.train_test())


def split_80_10_10(spark, sf):
    return _split(spark, sf, stratified.train_val_test(), THREE_CLASS)


def split_64_16_20(spark, sf):
    return _split(spark, sf, stratified.nested())


def kfold_assign(spark, sf):
    return _split(spark, sf, stratified.kfold(3))


def kfold_all_k(spark, sf):
    rows = inputs.prepared(spark, sf, TWO_CLASS).select("id", "row_key", "label")
    cuts = stratified.fit_cuts(rows, stratified.fold_layouts(), TWO_CLASS.ids)
    return stratified.role_rows(rows, cuts, stratified.fold_runs(), ["id", "label"])


def split_sizes(spark, sf):
    return stratified.split_sizes(kfold_all_k(spark, sf))


# --- joins ----------------------------------------------------------------------


def attach_predictions(spark, sf):
    rows = inputs.reviews(spark, sf)
    predictions = inputs.rated(spark, sf).select("id", "y_pred")
    return compare.attach_predictions(rows, predictions, "id")


def _three_models(spark, sf):
    """The holdout model at three smoothings: scores of all rows, one column per model."""
    e = _holdout(spark, sf)
    candidates = [e.candidate(holdout.HOLDOUT, i) for i in range(len(e.settings))]
    scored = naive_bayes.score(e.rows, e.model, candidates, carry=["sentiment"])
    names = {c.name: f"smoothing_{i}" for i, c in enumerate(candidates)}
    return scored, candidates, names


def compare_models(spark, sf):
    """From a long table of predictions, as several exports below each other give it."""
    scored, candidates, names = _three_models(spark, sf)
    long = naive_bayes.predictions(scored, candidates, ["row_key", "sentiment"]).replace(names, subset=["model"])
    long = long.withColumn("pred_sentiment", THREE_CLASS.decode(F.col("y_pred")))
    return compare.compare_models(long, list(names.values()))


def compare_models_one_pass(spark, sf):
    """The same from one scoring pass, where the predictions already stand side by side."""
    scored, _, names = _three_models(spark, sf)
    decoded = [THREE_CLASS.decode(scores.argmax(F.col(f"logits_{c}"))).alias(name) for c, name in names.items()]
    return compare.with_agreement(scored.select("row_key", "sentiment", *decoded), list(names.values()))


# --- aggregations ---------------------------------------------------------------


def row_count(spark, sf):
    return clean.row_count(clean.dataset_with_off(inputs.reviews(spark, sf)))


def label_counts(spark, sf):
    return clean.label_counts(clean.dataset_with_off(inputs.reviews(spark, sf)))


def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(inputs.rated(spark, sf), THREE_CLASS.ids, by=["lang"])


def confusion_wide(spark, sf):
    matrix = metrics.confusion_matrix(inputs.rated(spark, sf), THREE_CLASS.ids)
    return metrics.confusion_wide(matrix, THREE_CLASS.ids)


def _two_class_ratings(spark, sf):
    labels = inputs.table(spark, sf, "labels")
    return labels.select(F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))


def confusion_padded(spark, sf):
    return metrics.confusion_matrix(_two_class_ratings(spark, sf), THREE_CLASS.ids)


def confusion_observed(spark, sf):
    return metrics.confusion_observed(inputs.rated(spark, sf), by=["lang"])


def metrics_per_class(spark, sf):
    pairs = metrics.pair_counts(inputs.rated(spark, sf), by=["lang"])
    return rounded(metrics.per_class(pairs, by=["lang"]))


def metrics_overall(spark, sf):
    pairs = metrics.pair_counts(inputs.rated(spark, sf), by=["lang"])
    return rounded(metrics.overall(pairs, by=["lang"]))


def classification_report(spark, sf):
    return metrics.classification_report(metrics.pair_counts(inputs.rated(spark, sf)), THREE_CLASS)


def exact_match(spark, sf):
    """Majority guesses per task: within the language (prompt) or over all rows (prefix)."""
    label = text.missing_to_off(text.normalise_label(F.col("sentiment")))
    rows = inputs.sheet(spark, sf).select("lang", F.col("source").alias("topic"), label.alias("sentiment"))
    examples = rows.selectExpr(
        "lang",
        "inline(array(named_struct('task', 'sentiment', 'gold_text', sentiment),"
        " named_struct('task', 'topic', 'gold_text', topic)))",
    )
    styles = "inline(array(named_struct('style', 'prompt', 'scope', lang), named_struct('style', 'prefix', 'scope', 'all')))"
    counts = examples.groupBy("task", "lang", "gold_text").agg(F.count("*").alias("n"))
    totals = counts.selectExpr("task", "gold_text", "n", styles).groupBy("task", "style", "scope", "gold_text").agg(F.sum("n").alias("n"))
    best = F.min_by("gold_text", F.struct(-F.col("n"), F.col("gold_text"))).alias("pred_text")
    # Two tasks times two styles times the languages: a handful of rows.
    guesses = totals.groupBy("task", "style", "scope").agg(best)
    answered = examples.selectExpr("task", "gold_text", styles).join(F.broadcast(guesses), ["task", "style", "scope"])
    return rounded(metrics.exact_match(answered))


def throughput(spark, sf):
    log = inputs.epochs(spark, sf).groupBy("run").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("metric").cast("decimal(18,2)")).cast("double").alias("seconds")
    )
    return rounded(runs.throughput(log, "n_rows", "seconds", 16))


# --- run logs -------------------------------------------------------------------


def best_epoch(spark, sf):
    log = inputs.epochs(spark, sf).withColumnRenamed("event_id", "epoch")
    return runs.best_epoch(log, ["run"], "metric")


def _diverged(log, key):
    """The log with a metric that is not a number in every seventh row."""
    return log.withColumn("metric", F.when(F.col(key) % 7 == 0, F.lit(float("nan"))).otherwise(F.col("metric")))


def best_epoch_diverged(spark, sf):
    log = inputs.epochs(spark, sf).withColumnRenamed("event_id", "epoch")
    return runs.best_epoch(_diverged(log, "epoch"), ["run"], "metric")


def best_trial_diverged(spark, sf):
    log = inputs.epochs(spark, sf).select("run", F.col("event_id").alias("trial"), "metric", "event_type")
    return runs.best_trial(_diverged(log, "trial"), ["run"], "metric", ["event_type"], maximise=False)


def early_stop(spark, sf):
    events = inputs.epochs(spark, sf).select("run", "event_id", "ts", "hour", "metric")
    numbered = runs.number_epochs(events, ["run"], "hour", ["ts", "event_id"])
    log = scratch.materialize(numbered.select("run", "epoch", "metric"), "epochs")
    return runs.early_stop(log, ["run"], "metric", patience=2)


def best_trial(spark, sf):
    log = inputs.epochs(spark, sf).select("run", F.col("event_id").alias("trial"), "metric", "event_type", "props")
    best = [
        runs.best_trial(log, ["run"], "metric", ["event_type", "props"], maximise=up).withColumn("direction", F.lit(name))
        for up, name in ((True, "maximise"), (False, "minimise"))
    ]
    return best[0].unionByName(best[1])


def runtime_summary(spark, sf):
    return _runtime(spark, sf, ["stage"])


def runtime_by_run(spark, sf):
    return _runtime(spark, sf, ["run", "stage"])


def _runtime(spark, sf, by):
    log = inputs.epochs(spark, sf).select(
        "run", F.col("event_type").alias("stage"), F.col("metric").cast("decimal(18,2)").alias("seconds")
    )
    return runs.runtime_summary(log, by).withColumn("seconds", F.col("seconds").cast("double"))


def append_results(spark, sf):
    """Fold rows of two label domains in one table."""
    two = _kfold_results(spark, sf).withColumn("classes", F.lit(2))
    e = kfold.kfold_experiment(inputs.prepared(spark, sf, THREE_CLASS), THREE_CLASS, ks=(3,))
    three = rounded(kfold.fold_results(e)).withColumn("classes", F.lit(3))
    return runs.append_results(two, three)


# --- scalar functions -----------------------------------------------------------


def sentiment_prompt(spark, sf):
    rows = inputs.reviews(spark, sf)
    return rows.select("id", *[prompts.sentiment_prompt(F.col("text"), v).alias(v) for v in prompts.SENTIMENT_PREFIXES])


def task_prompt(spark, sf):
    rows = inputs.multitask(spark, sf)
    task = F.when(F.col("topic") < "src2", "sentiment").when(F.col("topic") < "src5", "topic").otherwise("selected")
    style = F.when(F.col("sentiment").isNull(), "prefix").otherwise("prompt")
    return rows.select("doc_id", prompts.task_prompt(F.col("text"), task, style).alias("prompt"))


def multitask_examples(spark, sf):
    rows = clean.drop_null_any(inputs.multitask(spark, sf))
    return prompts.multitask_examples(rows, normalise_target=True).select(
        "doc_id", "task", "style", "input_text", "target_text"
    )


def text_to_label(spark, sf):
    return inputs.sheet(spark, sf).select("doc_id", generated.text_to_label(F.col("sentiment")).alias("label"))


def text_fallback(spark, sf):
    rows = inputs.table(spark, sf, "conversations")
    ids = [generated.text_to_id(F.col("text"), p).alias(name) for name, p in generated.FALLBACKS.items()]
    return rows.select("conv_id", "turn", *ids)


def softmax_scores(spark, sf):
    probabilities = scores.softmax(F.col("embedding"))
    rows = inputs.table(spark, sf, "embeddings").select("vec_id", F.posexplode(probabilities).alias("class_id", "probability"))
    return rounded(rows, 9)


def argmax_scores(spark, sf):
    return inputs.table(spark, sf, "embeddings").select("vec_id", scores.argmax(F.col("embedding")).alias("pred_id"))


def _cleaned_documents(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


def bounded_tokens(spark, sf):
    kept = tokens.bounded_tokens(F.col("text"))
    return _cleaned_documents(spark, sf).select("doc_id", F.size(kept).alias("n_tokens"), F.concat_ws(" ", kept).alias("tokens"))


def pad_tokens(spark, sf):
    kept = tokens.bounded_tokens(F.col("text"))
    padded = tokens.pad_tokens(kept, tokens.MAX_SOURCE_TOKENS)
    mask = tokens.token_mask(kept, tokens.MAX_SOURCE_TOKENS)
    return _cleaned_documents(spark, sf).select(
        "doc_id", F.concat_ws(" ", padded).alias("tokens"), F.concat_ws("", mask.cast("array<string>")).alias("mask")
    )


# --- models ---------------------------------------------------------------------


def _holdout(spark, sf):
    return holdout.holdout_experiment(inputs.prepared(spark, sf, THREE_CLASS), THREE_CLASS)


def _two_class_fit(spark, sf):
    """All labelled rows train one model."""
    rows = inputs.prepared(spark, sf, TWO_CLASS)
    return rows, naive_bayes.fit(rows, [naive_bayes.Fit("all", "true")], TWO_CLASS.ids)


CANDIDATE = naive_bayes.Candidate("add_one", "all")


def nb_model(spark, sf):
    _, model = _two_class_fit(spark, sf)
    return rounded(naive_bayes.log_probabilities(model, [CANDIDATE]))


def _nb_scores(spark, sf, **kwargs):
    rows, model = _two_class_fit(spark, sf)
    scored = naive_bayes.score(rows, model, [CANDIDATE], carry=["label"], **kwargs)
    logits = F.col("logits_add_one")
    return rounded(scored.select("row_key", "label", logits[1].alias("log_odds"), scores.argmax(logits).alias("y_pred")))


def nb_predict(spark, sf):
    return _nb_scores(spark, sf)


def nb_predict_large_vocabulary(spark, sf):
    """The same scores by the route for a vocabulary too large to broadcast: 32 KB at most."""
    return _nb_scores(spark, sf, broadcast_bytes=32 * 1024)


def predict_all(spark, sf):
    return rounded(holdout.predict_all(_holdout(spark, sf)))


def predict_all_joined(spark, sf):
    """The same by the route for a model that no task can hold: scores joined to the texts."""
    e = _holdout(spark, sf)
    return rounded(experiment.predict_rows(e, e.chosen_candidate(holdout.HOLDOUT), lookup_bytes=0).drop("label"))


def predict_all_repeated_ids(spark, sf):
    """Every review twice and once more without an id: each row gets its prediction, equal rows the same."""
    reviews = inputs.reviews(spark, sf)
    nameless = reviews.withColumn("id", F.lit(None).cast(dict(reviews.dtypes)["id"]))
    table = reviews.unionByName(reviews).unionByName(nameless)
    rows = clean.prepare_reviews(table, THREE_CLASS, required=("text",))
    e = holdout.holdout_experiment(keys.with_occurrence_key(rows, rows.columns), THREE_CLASS)
    same = F.col("id").isNull() | (F.count_distinct("pred_id", "prob_off") == 1)
    return holdout.predict_all(e).groupBy("id").agg(F.count("*").alias("n_rows"), same.alias("same_prediction"))


def predict_test(spark, sf):
    """Train and test only: the test part also picks the setting, so rows are marked leaky."""
    rows = inputs.prepared(spark, sf, TWO_CLASS)
    return holdout.predict_test(holdout.holdout_experiment(rows, TWO_CLASS, validate_on_test=True))


def holdout_metrics(spark, sf):
    return rounded(holdout.test_metrics(_holdout(spark, sf)))


def holdout_report(spark, sf):
    return holdout.test_report(_holdout(spark, sf))


def holdout_confusion(spark, sf):
    return holdout.test_confusion(_holdout(spark, sf))


def _kfold_results(spark, sf):
    e = kfold.kfold_experiment(inputs.prepared(spark, sf, TWO_CLASS), TWO_CLASS)
    return rounded(kfold.fold_results(e))


def kfold_results(spark, sf):
    return _kfold_results(spark, sf)


def kfold_summary(spark, sf):
    e = kfold.kfold_experiment(inputs.prepared(spark, sf, TWO_CLASS), TWO_CLASS)
    return rounded(kfold.fold_summary(kfold.fold_results(e)))


def hp_trials(spark, sf):
    """One search per source of documents, five trials each."""
    searches = inputs.table(spark, sf, "documents").select("source").distinct()
    return trials.trial_table(searches, "source", trials.TEXT_SPACE, trials.TEXT_TRIALS)


def hp_trials_classifier(spark, sf):
    searches = inputs.table(spark, sf, "documents").select("source").distinct()
    return trials.trial_table(searches, "source", trials.CLASSIFIER_SPACE, trials.CLASSIFIER_TRIALS)


def search_trials(spark, sf):
    e = search.search_experiment(inputs.prepared(spark, sf, TWO_CLASS), TWO_CLASS)
    return rounded(search.trial_results(e))


def search_best(spark, sf):
    """Test metrics of the best trial."""
    e = search.search_experiment(inputs.prepared(spark, sf, TWO_CLASS), TWO_CLASS)
    return rounded(holdout.test_metrics(e))


# Hashed places and patience of the trained classifier here.
TRAIN_WIDTH, TRAIN_PATIENCE = 2048, 1


def _trained(spark, sf):
    return training.search_classifier(inputs.prepared(spark, sf, TWO_CLASS), TWO_CLASS, width=TRAIN_WIDTH, patience=TRAIN_PATIENCE)


def search_classifier(spark, sf):
    """The drawn settings of the classifier, trained together: one row per trial with its best epoch."""
    return rounded(_trained(spark, sf).results())


def training_log(spark, sf):
    """Validation metrics after each epoch of each trial; stopped trials have no later epochs."""
    return rounded(_trained(spark, sf).log)


def early_stop_trained(spark, sf):
    """Stop epochs found from the whole log of trials that were never stopped."""
    prepared = inputs.prepared(spark, sf, TWO_CLASS)
    log = training.search_classifier(prepared, TWO_CLASS, width=TRAIN_WIDTH, patience=None).log
    return runs.early_stop(log, ["trial"], "f1_macro", patience=TRAIN_PATIENCE)


def best_epoch_restored(spark, sf):
    """Predictions of the test part by the weights of the best epoch, read back from the weight table."""
    found = _trained(spark, sf).predict(columns=("row_key", "label"))
    return rounded(found.select(F.col("row_key").alias("id"), "label", "trial", "epoch", "pred_id", F.col("logits")[1].alias("log_odds")))


VECTOR_LENGTH = 64


def _thirds():
    """A stand-in model: the mean of each third of the vector is a logit."""

    def predict(vectors: np.ndarray) -> np.ndarray:
        return np.stack([part.mean(axis=1) for part in np.array_split(vectors, 3, axis=1)], axis=1)

    return predict


def batch_classifier(spark, sf):
    rows = inputs.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    logits = batch_scorer.logits_column(_thirds, F.col("embedding"), input_shapes=[[VECTOR_LENGTH]])
    return rounded(batch_scorer.classify(rows, logits, THREE_CLASS).drop("embedding"))


def _first_word():
    """A stand-in text model: it answers with the first word of the prompt."""

    def predict(prompt: np.ndarray) -> np.ndarray:
        return np.array([str(p).split(" ", 1)[0] for p in prompt], dtype=object)

    return predict


def batch_text_model(spark, sf):
    rows = inputs.table(spark, sf, "conversations").select("conv_id", "turn", text.clean_text(F.col("text")).alias("text"))
    out = batch_scorer.label_generated(rows, batch_scorer.generated_column(_first_word, F.col("text")))
    return out.drop("text")


def _by_length():
    """A stand-in text model: its answer depends on the length of the prompt."""
    answers = (" Positive!", "neg", "unsure")

    def predict(prompt: np.ndarray) -> np.ndarray:
        return np.array([answers[len(str(p)) % 3] for p in prompt], dtype=object)

    return predict


def _text_experiment(spark, sf):
    return text_to_text.text_experiment(inputs.prepared(spark, sf, THREE_CLASS), _by_length)


def text_experiment_metrics(spark, sf):
    return rounded(_text_experiment(spark, sf).measured())


def text_experiment_export(spark, sf):
    """Generated texts and their labels written as CSV and read back."""
    path = scratch.scratch_path(spark, "text-export")
    e = _text_experiment(spark, sf)
    e.export(path, "csv")
    return tables.read_table(spark, path, "csv", e.predictions().schema)


def logistic_regression(spark, sf):
    """Spark ML fits over a grid on vectors written once, the best one on validation saved and loaded: test rows
    per class, how many the loaded model predicts like the fitted one, and whether it beats the largest class."""
    rows = scratch.materialize(inputs.prepared(spark, sf, TWO_CLASS).select("row_key", "text", "label"), "rows")
    cuts = stratified.fit_cuts(rows, {"split": stratified.nested()}, TWO_CLASS.ids)
    rows = cuts.assign(rows, {"split": "role"})
    front = spark_ml.text_front_end(features=1 << 18).fit(rows.filter("role = 'train'"))
    vectors = scratch.materialize(front.transform(rows).select("row_key", "label", "role", "features"), "vectors")
    train, val, test = (vectors.filter(F.col("role") == part) for part in ("train", "val", "test"))
    model = LogisticRegression()
    grid = [{model.regParam: reg, model.maxIter: steps} for reg, steps in ((0.01, 10), (1000.0, 5))]
    fitted = dict(model.fitMultiple(train, grid))
    evaluator = spark_ml.MetricEvaluator()
    best = max(sorted(fitted), key=lambda i: evaluator.evaluate(fitted[i].transform(val)))
    path = scratch.scratch_path(spark, "ml-model")
    spark_ml.save_model(PipelineModel([*front.stages, fitted[best]]), path)
    again = spark_ml.load_model(path).transform(rows.filter("role = 'test'")).select("row_key", F.col("prediction").alias("again"))
    both = scratch.materialize(fitted[best].transform(test).select("row_key", "label", "prediction").join(again, "row_key"), "both")
    hits = both.filter("label = again").count()
    counts = both.groupBy("label").agg(F.count("*").alias("n_test"), F.count_if(F.col("prediction") == F.col("again")).alias("n_same"))
    largest = counts.agg(F.max("n_test")).first()[0]
    return counts.withColumn("beats_majority", F.lit(hits > largest))


def count_estimator(spark, sf):
    """The count model as a Spark ML stage: smoothing chosen by cross-validation on our folds, saved, loaded, test rows scored."""
    rows = scratch.materialize(inputs.prepared(spark, sf, TWO_CLASS).select("row_key", "text", "label"), "rows")
    cuts = stratified.fit_cuts(rows, {"k": stratified.kfold(3)}, TWO_CLASS.ids)
    rows = cuts.assign(rows, {"k": "role"})
    train = rows.filter("role <> 'test'").withColumn("fold", F.expr("CAST(substring(role, 5) AS INT) - 1"))
    classifier = spark_ml.CountClassifier()
    grid = [{classifier.smoothing: s} for s in (1.0, 0.1, 0.01)]
    cv = CrossValidator(estimator=classifier, estimatorParamMaps=grid, evaluator=spark_ml.MetricEvaluator(), numFolds=3, foldCol="fold")
    path = scratch.scratch_path(spark, "count-stage")
    PipelineModel([cv.fit(train).bestModel]).write().save(path)
    scored = spark_ml.load_model(path).transform(rows.filter("role = 'test'"))
    return rounded(scored.select("row_key", "label", F.col("logits")[1].alias("log_odds"), F.col("prediction").cast("int").alias("y_pred")))


def saved_artefact(spark, sf):
    """Raw rows scored from the folder alone: cleaning rules, label domain, chosen setting and counts."""
    path = scratch.scratch_path(spark, "artefact")
    with _holdout(spark, sf) as e:
        artefact.save(e, path)
    return rounded(artefact.load(spark, path).predict(inputs.reviews(spark, sf)))


def stream_predictions(spark, sf):
    """Documents read as a stream, two files a batch, scored by the saved model and written; texts need no label."""
    path, source, out, state = (scratch.scratch_path(spark, n) for n in ("artefact", "stream-in", "stream-out", "stream-state"))
    with _holdout(spark, sf) as e:
        artefact.save(e, path)
    documents = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    documents.repartition(4, "id").write.parquet(source)  # a folder of files that stream in
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 2).parquet(source)
    scored = rounded(artefact.load(spark, path).predict(stream))
    query = scored.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


def kfold_user_metrics(spark, sf):
    """Two metrics of the user's own, measured on the test part of each fold beside the others."""
    extra = {"kappa": metrics.KAPPA, "balanced_accuracy": metrics.BALANCED_ACCURACY}
    e = kfold.kfold_experiment(inputs.prepared(spark, sf, TWO_CLASS), TWO_CLASS, extra=extra)
    return rounded(kfold.fold_results(e).select("K", "fold", "eval_kappa", "eval_balanced_accuracy", "eval_accuracy"))


# --- sinks ----------------------------------------------------------------------


def export_predictions(spark, sf):
    """Predictions written as CSV and read back."""
    path = scratch.scratch_path(spark, "export")
    out = rounded(holdout.predict_all(_holdout(spark, sf)))
    tables.write_table(out, path, "csv")
    return tables.read_table(spark, path, "csv", out.schema)


def csv_round_trip(spark, sf):
    """Outer blanks, empty strings and nulls, written as CSV and read back."""
    path = scratch.scratch_path(spark, "csv")
    out = inputs.reviews(spark, sf).select("id", "sentiment")
    tables.write_table(out, path, "csv")
    return tables.read_table(spark, path, "csv", out.schema)


def saved_model(spark, sf):
    """The count model written, loaded again, and its table read."""
    _, model = _two_class_fit(spark, sf)
    path = scratch.scratch_path(spark, "saved-model")
    naive_bayes.save(model, path)
    return rounded(naive_bayes.log_probabilities(naive_bayes.load(spark, path), [CANDIDATE]))


QUERIES = {
    f.__name__: f
    for f in (
        load_reviews, select_by_position, drop_null_subset, drop_null_any, clean_text, drop_empty_text,
        normalise_label, missing_to_off, keep_label_domain, dataset_with_off, dataset_remove_off,
        encode_label, decode_label, correct_flag,
        split_train_test, split_80_10_10, split_64_16_20, kfold_assign, kfold_all_k, split_sizes,
        attach_predictions, compare_models, compare_models_one_pass,
        row_count, label_counts, confusion_matrix, confusion_wide, confusion_padded, confusion_observed,
        metrics_per_class, metrics_overall, classification_report, exact_match, throughput,
        best_epoch, best_epoch_diverged, early_stop, best_trial, best_trial_diverged, runtime_summary, runtime_by_run, append_results,
        sentiment_prompt, task_prompt, multitask_examples, text_to_label, text_fallback,
        softmax_scores, argmax_scores, bounded_tokens, pad_tokens,
        nb_model, nb_predict, nb_predict_large_vocabulary, predict_all, predict_all_joined, predict_all_repeated_ids, predict_test,
        holdout_metrics, holdout_report, holdout_confusion, kfold_results, kfold_summary,
        hp_trials, hp_trials_classifier, search_trials, search_best,
        search_classifier, training_log, early_stop_trained, best_epoch_restored,
        batch_classifier, batch_text_model, text_experiment_metrics, text_experiment_export, logistic_regression,
        count_estimator, saved_artefact, stream_predictions, kfold_user_metrics,
        export_predictions, csv_round_trip, saved_model,
    )
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return kfold_summary(spark, sf)
