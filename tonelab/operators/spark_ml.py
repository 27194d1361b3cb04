"""The same experiment protocol with Spark ML: a savable pipeline and a macro-F1 evaluator."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.functions.scores import argmax
from tonelab.operators import metrics, naive_bayes
from tonelab.operators.naive_bayes import Candidate, CountModel, Fit


def text_classifier(
    *, features: int, reg_param: float = 0.01, max_iter: int = 20, label: str = "label", text: str = "text"
) -> Pipeline:
    """Words -> hashed counts -> IDF -> logistic regression: one weight vector for two classes, else one per class.

    ``features`` is the width of the feature space: words whose hashes meet share a weight, so
    take many more than there are words. The model does not grow with the data.
    """
    front = text_front_end(features=features, text=text).getStages()
    return Pipeline(stages=[*front, LogisticRegression(labelCol=label, regParam=reg_param, maxIter=max_iter)])


def text_front_end(*, features: int, text: str = "text") -> Pipeline:
    """The stages before the regression. Over a grid, fit them once and write what they give."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=" +"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
            IDF(inputCol="_counts", outputCol="features"),
        ]
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Save the fitted model together with its text front end."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


class _CountParams(HasLabelCol, HasPredictionCol):
    """Text column, label ids, smoothing and prior weight; ``scoreCol`` holds the logits."""

    textCol = Param(Params._dummy(), "textCol", "cleaned text", typeConverter=TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "logits", typeConverter=TypeConverters.toString)
    labels = Param(Params._dummy(), "labels", "label ids", typeConverter=TypeConverters.toListInt)
    smoothing = Param(Params._dummy(), "smoothing", "added to each count", typeConverter=TypeConverters.toFloat)
    priorWeight = Param(Params._dummy(), "priorWeight", "weight of the class shares", typeConverter=TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(
            textCol="text", scoreCol="logits", labels=[0, 1], smoothing=1.0, priorWeight=1.0, labelCol="label", predictionCol="prediction"
        )


class CountClassifier(Estimator, _CountParams, DefaultParamsReadable, DefaultParamsWritable):
    """The count model as a Spark ML estimator, for pipelines and cross-validation."""

    @keyword_only
    def __init__(self, *, textCol="text", scoreCol="logits", labels=None, smoothing=1.0, priorWeight=1.0, labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._defaults()
        self._set(**{name: value for name, value in self._input_kwargs.items() if value is not None})

    def _fit(self, dataset: DataFrame) -> CountClassifierModel:
        text, label, labels = (self.getOrDefault(name) for name in ("textCol", "labelCol", "labels"))
        counts = naive_bayes.fit(dataset, [Fit(FIT, "true")], labels, label=label, text=text)
        return self._copyValues(CountClassifierModel(counts))

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        """One count for all settings of smoothing and prior weight, which do not change it."""
        count_only = {self.smoothing, self.priorWeight}
        if not all(set(p) <= count_only for p in paramMaps):
            return super().fitMultiple(dataset, paramMaps)
        counts = self._fit(dataset).counts
        return iter([(i, self.copy(p)._copyValues(CountClassifierModel(counts))) for i, p in enumerate(paramMaps)])


#: Name of the one fit and of the one candidate of a ``CountClassifierModel``.
FIT = "all"


class CountClassifierModel(Model, _CountParams, MLReadable, MLWritable):
    """Adds logits and the predicted label: a map over the rows, or a join on words if no task can hold the weights."""

    def __init__(self, counts: CountModel | None = None):
        super().__init__()
        self._defaults()
        self.counts = counts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        candidate = Candidate(FIT, FIT, self.getOrDefault("smoothing"), self.getOrDefault("priorWeight"))
        name, out = f"logits_{FIT}", self.getOrDefault("scoreCol")
        add = naive_bayes.with_logits if naive_bayes.can_look_up(self.counts, [candidate]) else naive_bayes.with_joined_logits
        scored = add(dataset, self.counts, [candidate], text=self.getOrDefault("textCol")).withColumnRenamed(name, out)
        place = F.array(*[F.lit(float(c)) for c in self.getOrDefault("labels")])
        return scored.withColumn(self.getPredictionCol(), F.get(place, argmax(F.col(out))))

    def write(self) -> MLWriter:
        return _CountWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CountReader()


class _CountWriter(MLWriter):
    def __init__(self, model: CountClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        naive_bayes.save(self.model.counts, f"{path}/model")


class _CountReader(MLReader):
    def load(self, path: str) -> CountClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CountClassifierModel(naive_bayes.load(self.sparkSession, f"{path}/model"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class MetricEvaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Evaluator for tuning: any metric of ``metrics.overall``, macro F1 by default, or the user's SQL in ``expression``."""

    expression = Param(Params._dummy(), "expression", "SQL of a metric of that name", typeConverter=TypeConverters.toString)
    metricName = Param(Params._dummy(), "metricName", "metric to report", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metricName="f1_macro", expression="", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(metricName="f1_macro", expression="", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = metrics.pair_counts(dataset, true=self.getLabelCol(), pred=self.getPredictionCol())
        own = self.getOrDefault("expression")
        row = metrics.overall(pairs, extra={self.getOrDefault("metricName"): own} if own else None).first()
        value = row[self.getOrDefault(self.metricName)] if row else None
        return 0.0 if value is None else value

    def isLargerBetter(self) -> bool:
        return True


