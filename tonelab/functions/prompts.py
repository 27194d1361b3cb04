"""Prompt columns for text-to-text models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.functions.text import clean_text, target_text

# Sentiment prompt prefixes.
SENTIMENT_PREFIXES = {
    "three_class": "sentiment classification (negative, off, positive): ",
    "two_class": "sentiment classification (negative, positive): ",
    "two_class_short": "sentiment (negative or positive): ",
}

# Fixed values: (task, style) -> text before and after the review.
TASK_TEMPLATES = {
    ("sentiment", "prefix"): ("sentiment classification: ", ""),
    ("topic", "prefix"): ("topic classification: ", ""),
    ("selected", "prefix"): ("generate selected content: ", ""),
    ("sentiment", "prompt"): (
        "Task: Determine the sentiment of the following review.\nReview: ",
        "\nSentiment:",
    ),
    ("topic", "prompt"): (
        "Task: Identify the topic of the following review.\nReview: ",
        "\nTopic:",
    ),
    ("selected", "prompt"): (
        "Task: Generate the selected content that supports the opinion.\nReview: ",
        "\nAnswer:",
    ),
}

# The column holding the target of each task.
TASK_TARGETS = {"sentiment": "sentiment", "topic": "topic", "selected": "selected_text"}


def sentiment_prompt(text: Column, variant: str = "three_class") -> Column:
    """Cleaned text behind one of the fixed sentiment prefixes."""
    return F.concat(F.lit(SENTIMENT_PREFIXES[variant]), clean_text(text))


def task_prompt(text: Column, task: Column, style: Column) -> Column:
    """Prompt for a (task, style) pair given as columns; null for an unknown pair."""
    expr = None
    for (t, s), (before, after) in TASK_TEMPLATES.items():
        hit = (task == F.lit(t)) & (style == F.lit(s))
        value = F.concat(F.lit(before), text, F.lit(after))
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr


def multitask_examples(
    df: DataFrame,
    pairs: list[tuple[str, str]] | None = None,
    normalise_target: bool = False,
) -> DataFrame:
    """One (input_text, target_text) example per row, task and style.

    A literal array is exploded, so the fan-out is a narrow map: no join and no
    shuffle whatever the number of rows.
    """
    pairs = pairs or list(TASK_TEMPLATES)
    plan = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(s).alias("style")) for t, s in pairs]))
    out = df.withColumn("_pair", plan).withColumns({"task": F.col("_pair.task"), "style": F.col("_pair.style")})
    target = None
    for t, column in TASK_TARGETS.items():
        hit, value = F.col("task") == F.lit(t), F.col(column).cast("string")
        target = F.when(hit, value) if target is None else target.when(hit, value)
    return out.withColumns(
        {
            "input_text": task_prompt(F.col("text"), F.col("task"), F.col("style")),
            "target_text": target_text(target) if normalise_target else target,
        }
    ).drop("_pair")
