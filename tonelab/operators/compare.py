"""Predictions next to their rows, and models next to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_predictions(rows: DataFrame, predictions: DataFrame, key: str = "row_key") -> DataFrame:
    """Equi-join on the unique row key; rows without a prediction are kept."""
    return rows.join(predictions, key, "left")


def compare_models(predictions: DataFrame, models: Sequence[str], key: str = "row_key", gold: str = "sentiment") -> DataFrame:
    """One row per key from long predictions: gold, one column per model, agreement.

    The model list is given, so the pivot needs no extra pass.
    """
    wide = predictions.groupBy(key, gold).pivot("model", list(models)).agg(F.first("pred_sentiment"))
    return with_agreement(wide, models, gold)


def with_agreement(wide: DataFrame, models: Sequence[str], gold: str = "sentiment") -> DataFrame:
    """Add how many models agree, for predictions that already stand side by side. Narrow.

    ``n_agree_gold`` counts models equal to the gold label, ``n_distinct`` the
    different predictions; a model without a prediction counts for neither.
    """
    agree = " + ".join(f"coalesce(CAST(lower(`{m}`) = `{gold}` AS INT), 0)" for m in models)
    values = ", ".join(f"`{m}`" for m in models)
    return wide.withColumns(
        {
            "n_agree_gold": F.expr(agree),
            "n_distinct": F.expr(f"size(array_distinct(array_compact(array({values}))))"),
        }
    )
