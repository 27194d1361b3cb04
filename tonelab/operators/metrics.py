"""Confusion matrices and classification metrics from (true, predicted) columns.

Rows are reduced to pair counts first, with a map-side combine; every metric is
then arithmetic on at most ``classes ** 2`` rows per group. ``by`` adds group
columns (model, K, fold, ...), so many runs are measured in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.functions.labels import LabelDomain

TRUE, PRED = "y_true", "y_pred"
REPORT_DIGITS = 4


def _names(columns: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def pair_counts(df: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Rows per (true, predicted) pair; only pairs that occur."""
    return df.groupBy(*by, F.col(true).alias(TRUE), F.col(pred).alias(PRED)).agg(F.count("*").alias("n"))


def confusion_matrix(
    df: DataFrame,
    labels: Sequence[int],
    by: Sequence[str] = (),
    true: str = TRUE,
    pred: str = PRED,
    weight: str | None = None,
) -> DataFrame:
    """Cell counts over a given label list, absent pairs as 0, in long form.

    One conditional count per cell, then one row per cell: no grid to join.
    Listing a label that never occurs gives a zero row and column. ``weight``
    names the count column where the input already holds pair counts.
    """
    cells = [(t, p) for t in labels for p in labels]
    one = "1L" if weight is None else f"`{weight}`"
    counts = df.groupBy(*by).agg(
        *[
            F.expr(f"coalesce(sum({one}) FILTER (WHERE `{true}` = {t} AND `{pred}` = {p}), 0L)").alias(f"_{i}")
            for i, (t, p) in enumerate(cells)
        ]
    )
    entries = ", ".join(f"named_struct('{TRUE}', {t}, '{PRED}', {p}, 'n', _{i})" for i, (t, p) in enumerate(cells))
    return counts.selectExpr(*_names(by), f"inline(array({entries}))")


def confusion_wide(matrix: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One row per true label, one column ``pred_<label>`` per predicted label."""
    columns = [F.sum(F.when(F.col(PRED) == p, F.col("n"))).alias(f"pred_{p}") for p in labels]
    return matrix.groupBy(*by, TRUE).agg(*columns)


def confusion_observed(df: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Cell counts over the labels seen as true or predicted.

    Works on the pair counts, so what is gathered per group is bounded by the
    number of label pairs, not by the rows.
    """
    pairs = pair_counts(df, by, true, pred)
    cell = F.struct(F.col(TRUE), F.col(PRED))
    grouped = pairs.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(cell.alias("key"), F.col("n").alias("value")))).alias("cells"),
        F.array_distinct(F.flatten(F.collect_list(F.array(TRUE, PRED)))).alias("seen"),
    )
    rows = grouped.withColumn(TRUE, F.explode("seen")).withColumn(PRED, F.explode("seen"))
    return rows.select(*by, TRUE, PRED, F.coalesce(F.element_at("cells", cell), F.lit(0)).alias("n"))


def per_class(pairs: DataFrame, by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class seen as true or predicted.

    Input: pair counts or a confusion matrix (``y_true, y_pred, n``). A zero
    denominator gives 0. ``sums`` names columns to add up by true class as well.
    """
    return _class_totals(pairs, by, sums).drop("predicted")


def _class_totals(pairs: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``per_class`` with ``predicted``, the rows predicted as the class."""
    extra = [f", '{c}', `{c}`" for c in sums]
    none = [f", '{c}', 0 * `{c}`" for c in sums]
    sides = (
        f"named_struct('label', {TRUE}, 'support', n, 'predicted', 0L, 'tp', if({TRUE} = {PRED}, n, 0L){''.join(extra)}),"
        f" named_struct('label', {PRED}, 'support', 0L, 'predicted', n, 'tp', 0L{''.join(none)})"
    )
    totals = (
        pairs.filter("n > 0")
        .selectExpr(*_names(by), f"inline(array({sides}))")
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp", *sums)])
    )
    return totals.selectExpr(
        *_names([*by, "label"]),
        "coalesce(try_divide(tp, predicted), 0D) AS precision",
        "coalesce(try_divide(tp, support), 0D) AS recall",
        "coalesce(try_divide(2 * tp, predicted + support), 0D) AS f1",
        "support",
        "predicted",
        "tp",
        *_names(sums),
    )


_MACRO = {f"{m}_macro": f"avg({m})" for m in ("precision", "recall", "f1")}
_WEIGHTED = {f"{m}_weighted": f"sum({m} * support) / sum(support)" for m in ("precision", "recall", "f1")}
_OVERALL = {"accuracy": "sum(tp) / sum(support)", **_MACRO, **_WEIGHTED}


# Metrics that a user may ask for as ``extra``.
BALANCED_ACCURACY = "sum(recall) FILTER (WHERE support > 0) / count_if(support > 0)"
KAPPA = (
    "try_divide(sum(tp) / sum(support) - sum(support * predicted) / (sum(support) * sum(support)),"
    " 1 - sum(support * predicted) / (sum(support) * sum(support)))"
)


def overall(
    pairs: DataFrame, by: Sequence[str] = (), means: Sequence[str] = (), extra: Mapping[str, str] | None = None
) -> DataFrame:
    """Accuracy with macro and weighted precision, recall and F1.

    Macro F1 is the mean of the class F1 values, not the harmonic mean of macro
    precision and macro recall. ``means`` names summed columns (such as a loss)
    to report per row. ``extra`` holds the user's metrics by name: each an SQL aggregate over
    one row per class with ``label, precision, recall, f1, support, predicted, tp``.
    """
    expressions = _OVERALL | {c: f"sum(`{c}`) / sum(support)" for c in means}
    if taken := expressions.keys() & (extra or {}):
        raise ValueError(f"metrics that exist already: {sorted(taken)}")
    expressions |= extra or {}
    columns = [F.expr(e).alias(name) for name, e in expressions.items()]
    return _class_totals(pairs, by, means).groupBy(*by).agg(*columns)


def classification_report(pairs: DataFrame, domain: LabelDomain, by: Sequence[str] = ()) -> DataFrame:
    """Class rows by display name, then accuracy, macro avg and weighted avg, 4 decimals.

    The class rows of a group (two or three) are gathered next to its totals, so
    the report is one pass over the pair counts.
    """

    def line(name: str, precision: str, recall: str, f1: str) -> str:
        values = {"precision": precision, "recall": recall, "f1": f1}
        digits = "".join(f", '{k}', round({v}, {REPORT_DIGITS})" for k, v in values.items())
        return f"named_struct('name', {name}{digits}, 'support', support)"

    classes = per_class(pairs, by).withColumn("name", domain.decode(F.col("label")))
    grouped = classes.groupBy(*by).agg(
        F.collect_list(F.expr(line("name", "precision", "recall", "f1"))).alias("lines"),
        *[F.expr(e).alias(name) for name, e in _OVERALL.items()],
        F.sum("support").alias("support"),
    )
    none = "CAST(NULL AS DOUBLE)"
    totals = [
        line("'accuracy'", none, none, "accuracy"),
        line("'macro avg'", "precision_macro", "recall_macro", "f1_macro"),
        line("'weighted avg'", "precision_weighted", "recall_weighted", "f1_weighted"),
    ]
    return grouped.selectExpr(*_names(by), f"inline(concat(lines, array({', '.join(totals)})))")


def exact_match(df: DataFrame, by: Sequence[str] = ("task", "style"), pred="pred_text", gold="gold_text") -> DataFrame:
    """Share of rows whose decoded text equals the gold text."""
    same = F.coalesce(F.col(pred) == F.col(gold), F.lit(False)).cast("int")
    return df.groupBy(*by).agg(F.avg(same).alias("accuracy"), F.count("*").alias("n"))


def correct_flag(true: str = TRUE, pred: str = PRED) -> Column:
    return F.col(pred) == F.col(true)
