"""What the corpus operators share: row identity, checked broadcasts, row filters."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tonelab.sources.scratch import scratch_path

#: Internal columns start with this; a table that has such a name is one of ours.
OWN = "_tonelab_"
ROW = OWN + "row"
#: Rows of two or three numbers that may be broadcast: about 50 MB on each executor.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts that a Python worker is sent at once.
BATCH_BYTES = 1 << 21


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: cuts lineage. ``options`` are Parquet's."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a step go when the step has ended, not when the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Steps run meanwhile send rows to Python workers by BATCH_BYTES, a longer row alone.

    Spark's own 64 MB lie in the executor and in each worker several times over, and neither gives all of it back.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if it has few rows; else leave it to a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def map_frames(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` by way of Arrow tables: the result's columns get exactly the given types."""
    out = StructType.fromDDL(schema)
    types = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in f(b.to_pandas() for b in batches):
            if len(frame):
                yield from pa.Table.from_pandas(frame, types, preserve_index=False).combine_chunks().to_batches()
        pa.default_memory_pool().release_unused()  # the worker lives on, for other work

    return df.mapInArrow(run, out)


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """Add the column ROW: a unique long in the order of ``key``, nulls last, unless it is there.

    A key that is a whole number without nulls and repeats is the row number itself. Else
    the table is sorted and written once with a running number, so that every later pass
    sees the same numbers; a random second sort column spreads equal keys over tasks.
    """
    if ROW in docs.columns:  # numbered before
        return docs
    counted = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bad = counted.where(F.col(key).isNull() | (F.col("n") > 1)).limit(1).count()
    if not bad and dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
        return docs.withColumn(ROW, F.col(key).cast("bigint"))
    ordered = docs.withColumn(ROW, F.rand(7)).orderBy(F.col(key).asc_nulls_last(), ROW)
    return written(ordered.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def bit_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits as bytes: a set bit for each hash, by its lowest bits.

    Its size, also on the way to the driver, does not depend on the table.
    """
    slot = F.col(column).bitwiseAND(bits - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    marks = hashes.select(F.floor(slot / 64).cast("int").alias("word"), one.alias("bit"))
    found = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_pandas()
    held = np.zeros(bits // 64, np.int64)
    held[found["word"].to_numpy(int)] = found["bits"].to_numpy(np.int64)
    return held.view(np.uint8)


def in_filter(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be in the filter; never false for one that is."""
    at = hashes & np.uint64(8 * len(held) - 1)
    return ((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def without(docs: DataFrame, gone: DataFrame, key: str = ROW) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone``; texts are not moved if ``gone`` is small."""
    gone = written(gone.select(key), "gone")
    return docs.join(small(gone), key, "left_anti")
