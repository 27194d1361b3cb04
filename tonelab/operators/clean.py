"""Row filters and the cleaned, encoded review table.

All of it is narrow: one pass, no shuffle. Null and label filters sit on plain
columns so they reach the scan; filters on cleaned text cannot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.functions.labels import THREE_CLASS, TWO_CLASS, LabelDomain
from tonelab.functions.text import clean_text, missing_to_off, normalise_label


def drop_null_subset(df: DataFrame, columns: Sequence[str] = ("id", "text")) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def drop_null_any(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def with_clean_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, clean_text(F.col(column)))


def drop_empty_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop rows whose cleaned text is empty."""
    return df.filter(F.col(column) != "")


def keep_label_domain(df: DataFrame, domain: LabelDomain, column: str = "sentiment") -> DataFrame:
    """Keep rows whose normalised label is in the domain; null is dropped too."""
    return df.filter(domain.contains(F.col(column)))


def prepare_reviews(
    df: DataFrame,
    domain: LabelDomain,
    *,
    required: Sequence[str] = ("id", "text"),
    drop_empty: bool = True,
) -> DataFrame:
    """Raw ``id, text, sentiment`` rows -> cleaned rows with an integer ``label``.

    A missing label becomes ``off`` only where the domain has ``off``; otherwise
    the row is dropped.
    """
    out = with_clean_text(drop_null_subset(df, required))
    if drop_empty:
        out = drop_empty_text(out)
    sentiment = normalise_label(F.col("sentiment"))
    if "off" in domain.names:
        sentiment = missing_to_off(sentiment)
    out = keep_label_domain(out.withColumn("sentiment", sentiment), domain)
    return out.withColumn("label", domain.encode(F.col("sentiment")))


def dataset_with_off(df: DataFrame) -> DataFrame:
    """Three-class table: rows without a label count as ``off``."""
    return prepare_reviews(df, THREE_CLASS)


def dataset_remove_off(df: DataFrame) -> DataFrame:
    """Two-class table: rows without a positive or negative label are dropped."""
    return prepare_reviews(df, TWO_CLASS)


def label_counts(df: DataFrame, column: str = "sentiment") -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))
