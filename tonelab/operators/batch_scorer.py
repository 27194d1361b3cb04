"""Score rows with a user's own model, in Arrow batches inside the tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tonelab.functions.generated import FALLBACKS, FallbackPolicy, text_to_id, text_to_label
from tonelab.functions.labels import LabelDomain
from tonelab.functions.scores import argmax, probability_columns, softmax

# Rows per call of a classifier and of a text model.
CLASSIFIER_BATCH = 64
TEXT_BATCH = 32

MakeModel = Callable[[], Callable[[np.ndarray], np.ndarray]]


def logits_column(
    make_model: MakeModel,
    *inputs: Column,
    batch_size: int = CLASSIFIER_BATCH,
    input_shapes: list[list[int] | None] | None = None,
) -> Column:
    """Logit vector per row. ``make_model`` runs once per Python worker and returns
    a function from a batch of inputs to a (rows, classes) matrix. Array inputs
    need their length in ``input_shapes``."""
    udf = predict_batch_udf(
        make_model,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    return udf(*inputs)


def generated_column(make_model: MakeModel, *inputs: Column, batch_size: int = TEXT_BATCH) -> Column:
    """Generated text per row, for a text-to-text model."""
    udf = predict_batch_udf(make_model, return_type=StringType(), batch_size=batch_size)
    return udf(*inputs)


def classify(df: DataFrame, logits: Column, domain: LabelDomain) -> DataFrame:
    """Add ``pred_id``, ``pred_sentiment`` and one probability column per class.

    Rows keep their columns while only the model's input goes to Python, so
    nothing is joined back and nothing is shuffled.
    """
    scored = df.withColumn("_logits", logits).withColumn("_p", softmax(F.col("_logits")))
    columns = {
        "pred_id": argmax(F.col("_logits")),
        "pred_sentiment": domain.decode(argmax(F.col("_logits"))),
        **probability_columns(F.col("_p"), domain),
    }
    return scored.withColumns(columns).drop("_logits", "_p")


def label_generated(df: DataFrame, generated: Column, policy: FallbackPolicy = FALLBACKS["three_class"]) -> DataFrame:
    """Add ``pred_text_raw``, ``pred_label``, ``pred_id`` and ``pred_sentiment``."""
    out = df.withColumn("pred_text_raw", generated)
    raw = F.col("pred_text_raw")
    return out.withColumns(
        {
            "pred_label": text_to_label(raw, policy),
            "pred_id": text_to_id(raw, policy),
            "pred_sentiment": policy.domain.decode(text_to_id(raw, policy)),
        }
    )
