"""Metric logs and run tables: best epoch, early stop, best trial, summaries.

Choices of a best row are ``max_by``-style aggregates, not sorted windows: they
combine on the map side, so one run may hold any share of the log.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tonelab.functions.durations import format_duration


def _number(metric: str) -> Column:
    """The metric, or null where it is not a number: a diverged run never wins."""
    return F.when(~F.isnan(metric), F.col(metric))


def best_epoch(log: DataFrame, run: Sequence[str], metric: str, epoch: str = "epoch", higher: bool = True) -> DataFrame:
    """Best epoch per run; the earliest one on ties. Null and NaN metrics never win."""
    value = _number(metric) if higher else -_number(metric)
    order = F.struct(value.alias("value"), (-F.col(epoch)).alias("early"))
    top = log.filter(_number(metric).isNotNull()).groupBy(*run).agg(F.max(order).alias("top"))
    best = F.col("top.value") if higher else -F.col("top.value")
    return top.select(*run, (-F.col("top.early")).alias(epoch), best.alias(metric))


def best_trial(
    trials: DataFrame,
    by: Sequence[str],
    objective: str,
    params: Sequence[str],
    trial: str = "trial",
    maximise: bool = True,
) -> DataFrame:
    """Trial with the best objective per search; the lowest trial number on ties. Null and NaN never win."""
    value = _number(objective) if maximise else -_number(objective)
    order = F.struct(value, -F.col(trial))
    chosen = F.max_by(F.struct(trial, objective, *params), order).alias("best")
    return trials.filter(_number(objective).isNotNull()).groupBy(*by).agg(chosen).select(*by, "best.*")


def _same_keys(a: str, b: str, columns: Sequence[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def _with_carry(df: DataFrame, run: Sequence[str], chunk: str, value: Column, aggregate, name: str) -> DataFrame:
    """Add the aggregate of ``value`` over all earlier chunks of the run."""
    keys = [*run, chunk]
    per_chunk = df.groupBy(*keys).agg(aggregate(value).alias("_part"))
    earlier = W.Window.partitionBy(*run).orderBy(chunk).rowsBetween(W.Window.unboundedPreceding, -1)
    carry = per_chunk.withColumn(name, aggregate("_part").over(earlier)).drop("_part")
    return df.alias("d").join(carry.alias("c"), _same_keys("d", "c", keys)).select("d.*", name)


def number_epochs(log: DataFrame, run: Sequence[str], chunk: str, order: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """Number the rows of each run from 1 in the given order.

    ``chunk`` is a coarse column that grows with ``order`` (a day, an hour, an id
    range). Rows are ranked within a chunk and moved up by the rows of earlier
    chunks, so a long run is many small windows instead of one.
    """
    within = W.Window.partitionBy(*run, chunk).orderBy(*order)
    offset = _with_carry(log, run, chunk, F.lit(1), F.sum, "_before")
    number = F.row_number().over(within) + F.coalesce(F.col("_before"), F.lit(0))
    return offset.withColumn(epoch, number.cast("bigint")).drop("_before")


def early_stop(
    log: DataFrame,
    run: Sequence[str],
    metric: str,
    epoch: str = "epoch",
    patience: int = 2,
    chunk_epochs: int = 1024,
    higher: bool = True,
) -> DataFrame:
    """Epoch at which each run stops: the first one that is the ``patience``-th in a
    row without a better metric. Null where a run never stops early. A null or NaN metric
    is never better.

    Epochs are whole numbers that follow each other; a run with a gap, a repeated or a null
    epoch fails with an error. A run stops ``patience`` epochs after the
    first record that is not followed by another one in time. Rows are only
    ranked within chunks of epochs; each chunk then becomes one row with its first
    and last record, so no window holds the rows of a whole run. What earlier chunks
    reached enters a chunk as a row ahead of its own, so the log is shuffled once.
    """
    value = _number(metric) if higher else -_number(metric)
    df = log.select(*run, F.col(epoch).cast("bigint").alias("_e"), value.alias("_v"))
    df = df.withColumn("_chunk", F.floor(F.col("_e") / chunk_epochs))
    before = W.Window.partitionBy(*run).orderBy("_chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    reached = df.groupBy(*run, "_chunk").agg(F.max("_v").alias("_v")).withColumn("_v", F.max("_v").over(before))
    reached = reached.withColumns({"_e": F.lit(None).cast("bigint"), "_own": F.lit(False)})
    df = df.withColumn("_own", F.lit(True)).unionByName(reached)
    ordered = W.Window.partitionBy(*run, "_chunk").orderBy("_own", "_e")
    earlier = ordered.rowsBetween(W.Window.unboundedPreceding, -1)
    record = F.col("_own") & F.col("_v").isNotNull() & (F.col("_best").isNull() | (F.col("_v") > F.col("_best")))
    df = df.withColumns({"_best": F.max("_v").over(earlier), "_step": F.col("_e") - F.lag("_e").over(ordered)})
    df = df.withColumn("_record", F.when(record, F.col("_e"))).withColumn("_previous", F.max("_record").over(earlier))
    late = F.col("_record") - F.col("_previous") > patience
    chunks = df.groupBy(*run, "_chunk").agg(
        F.min("_record").alias("_first"),
        F.max("_record").alias("_last"),
        F.min(F.when(late, F.col("_previous") + patience)).alias("_inside"),
        F.min("_e").alias("_start"),
        F.max("_e").alias("_end"),
        F.count_if("_own").alias("_rows"),
        F.count_if(F.col("_step") != 1).alias("_jumps"),
    )
    later = W.Window.partitionBy(*run).orderBy("_chunk").rowsBetween(1, W.Window.unboundedFollowing)
    whole = W.Window.partitionBy(*run)
    chunks = chunks.withColumns({"_next": F.min("_first").over(later), "last_epoch": F.max("_end").over(whole)})
    wait = F.coalesce(F.col("_next") - 1, F.col("last_epoch")) - F.col("_last")
    between = F.when(wait >= patience, F.col("_last") + patience)
    gapless = (F.sum("_jumps") == 0) & (F.sum("_rows") == F.max("_end") - F.min("_start") + 1)
    wrong = F.raise_error(F.lit("early_stop: the epochs of a run must follow each other without gaps or repeats")).cast("bigint")
    return chunks.groupBy(*run).agg(
        F.when(gapless, F.min(F.least("_inside", between))).otherwise(wrong).alias("stop_epoch"), F.max("last_epoch").alias("last_epoch")
    )


def fold_summary(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("K",)) -> DataFrame:
    """Mean and sample standard deviation of each metric; std is null for one row."""
    columns = []
    for m in metrics:
        columns += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return results.groupBy(*by).agg(*columns)


def append_results(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Result tables of several models below each other, by column name."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def throughput(df: DataFrame, rows: str, seconds: str, batch: int) -> DataFrame:
    """Seconds per row, rows per second and steps per second; a last short batch is a step."""
    n, s = F.col(rows), F.col(seconds)
    steps = F.floor((n + (batch - 1)) / batch)
    return df.withColumns(
        {
            "seconds_per_row": F.try_divide(s, n),
            "rows_per_second": F.try_divide(n, s),
            "steps_per_second": F.try_divide(steps, s),
        }
    )


def runtime_summary(timings: DataFrame, by: Sequence[str] = ("stage",), seconds: str = "seconds") -> DataFrame:
    """Total seconds per stage, also as ``H:MM:SS``."""
    total = timings.groupBy(*by).agg(F.sum(seconds).alias("seconds"))
    return total.withColumn("time_hms", format_duration(F.col("seconds")))
