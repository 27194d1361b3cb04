"""Reading review tables and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Positions of id, text and sentiment in a raw sheet.
REVIEW_POSITIONS = (0, 6, 7)
REVIEW_COLUMNS = ("id", "text", "sentiment")

# Both ways the same, so that outer blanks, empty strings and nulls come back as they were.
CSV = {
    "header": True, "quote": '"', "escape": '"', "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """Read a whole table: ``parquet``, ``orc``, ``json`` or ``csv`` with a header row.

    In CSV, ``\\N`` is null and an empty field an empty string. Fields may hold line breaks, so one CSV file is one task; store large
    tables as Parquet or as many CSV files. Give CSV and JSON a schema, or the
    types are inferred in an extra pass.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.options(multiLine=True, emptyValue="", **CSV)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.format(fmt).load(path)


def select_by_position(
    df: DataFrame, positions: Sequence[int] = REVIEW_POSITIONS, names: Sequence[str] = REVIEW_COLUMNS
) -> DataFrame:
    """Pick columns by position and rename them; fails before any job if there are too few."""
    if len(df.columns) <= max(positions):
        raise ValueError(f"table has {len(df.columns)} columns; need at least {max(positions) + 1}")
    return df.select(*[F.col(f"`{df.columns[p]}`").alias(n) for p, n in zip(positions, names, strict=True)])


def read_reviews(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    positions: Sequence[int] = REVIEW_POSITIONS,
) -> DataFrame:
    """Raw ``id, text, sentiment`` rows of a sheet."""
    return select_by_position(read_table(spark, path, fmt, schema), positions)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write a result as a folder of part files; CSV gets a header and no index, and ``\\N`` for null."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(emptyValue='""', **CSV)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
