"""Review tables read from the given Parquet tables.

``documents`` left-joined with ``labels`` stands for the raw sheet: eight columns,
id at position 0, text at 6, sentiment at 7. The sentiment column is spelled in
several ways and is missing in several ways, so cleaning has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelab.functions.labels import LabelDomain
from tonelab.functions.text import clean_text
from tonelab.operators import clean
from tonelab.sources.tables import read_table, select_by_position


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def raw_sentiment():
    return (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Positive")
        .when(F.col("quality") == 1, " positive\n")
        .when(F.col("quality") == 0, "NEGATIVE\t")
        .when(F.col("lang") == "en", F.lit(None))
        .when(F.col("lang") == "de", "None")
        .when(F.col("lang") == "fr", " NaN ")
        .otherwise("")
    )


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    joined = documents.join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic", "text", raw_sentiment().alias("sentiment")
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return select_by_position(sheet(spark, sf))


def prepared(spark: SparkSession, sf: str, domain: LabelDomain) -> DataFrame:
    """Cleaned rows with label and row key; document ids are unique."""
    return clean.prepare_reviews(reviews(spark, sf), domain).withColumn("row_key", F.col("id"))


def multitask(spark: SparkSession, sf: str) -> DataFrame:
    """Topic is the source, selected content the last line of the cleaned text."""
    s = sheet(spark, sf)
    lines = F.split(F.col("text"), "\n")
    return s.select(
        "doc_id",
        clean_text(F.col("text")).alias("text"),
        "sentiment",
        F.col("source").alias("topic"),
        F.element_at(lines, -1).alias("selected_text"),
    )


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """True and predicted labels: a rule on length and toxicity stands for a model."""
    rows = clean.prepare_reviews(
        sheet(spark, sf).withColumnRenamed("doc_id", "id"), clean.THREE_CLASS
    )
    guess = F.when(F.col("toxic") == 1, 0).when(F.col("n_chars") > 1500, 2).otherwise(1)
    return rows.select("id", "lang", "sentiment", F.col("label").alias("y_true"), guess.alias("y_pred"))


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Metric log: one run per user, one epoch per event, the event value as metric."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        "event_id",
        "ts",
        F.date_trunc("hour", "ts").alias("hour"),
        F.col("value").alias("metric"),
        "event_type",
        "props",
    )
