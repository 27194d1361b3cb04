"""Ranks and running totals within groups of any size, without a window that holds a group."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelab.llm import rows

#: Running number of a written row: unique, ascending in the order asked for.
NUMBER = rows.OWN + "number"
#: Hexadecimal digits by which a running total goes up a level: 4,096 parts each.
DIGITS = 3


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], rank: str = "rank") -> DataFrame:
    """Add the number of the row within its group ``by`` (from 0) in the order of ``order``, nulls first.

    The table is sorted over all tasks once, a random last sort column spreading rows that are
    equal, and written with a running number. A group's rows of one task follow each other, so a
    rank is the distance to the first of them plus the group's rows in earlier tasks. Rows equal in ``by`` and
    ``order`` get their ranks in any order. Also adds ``NUMBER``, which is unique.
    """
    salt, part, first, n, before = (rows.OWN + name for name in ("salt", "part", "first", "n", "before"))
    keys = [F.col(c).asc_nulls_first() for c in dict.fromkeys((*by, *order))] + [F.col(salt)]
    sorted_ = df.withColumn(salt, F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = rows.written(sorted_.drop(salt).withColumn(NUMBER, F.monotonically_increasing_id()), "ranked")
    task = F.shiftright(NUMBER, 33)
    # One row for each task and each group: as many as tasks and groups, at most.
    parts = placed.groupBy(task.alias(part), *by).agg(F.min(NUMBER).alias(first), F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.written(parts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n), "parts")
    starts = parts.select(part, first, before, *[F.col(c).alias(rows.OWN + "by_" + c) for c in by])
    same = [F.col(c).eqNullSafe(F.col(rows.OWN + "by_" + c)) for c in by]
    joined = placed.join(rows.small(starts), functools.reduce(lambda x, y: x & y, same, task == F.col(part)))
    return joined.withColumn(rank, F.col(NUMBER) - F.col(first) + F.col(before)).select(*df.columns, NUMBER, rank)


def hexadecimal(c: Column, n: int) -> tuple[Column, int]:
    """Whole numbers below ``n`` as texts of one length, and that length."""
    width = len(f"{max(0, n - 1):x}")
    return F.lpad(F.hex(c), width, "0"), width


def before(df: DataFrame, by: Sequence[str], order: str, value: Column, digits: int, name: str = "before") -> DataFrame:
    """Add the sum of ``value`` over earlier rows of the group ``by``, in the order of ``order``.

    ``order`` holds hexadecimal texts of one length, unique in the group. Rows are summed up in windows
    that share the first ``digits`` digits; sums of windows are summed up in the same way with
    fewer digits. Choose ``digits`` so that few rows of a group share them. ``df`` is read twice.
    """
    digits = max(0, digits)
    head, part, inside, upto = (f"{rows.OWN}{c}_{digits}" for c in ("head", "part", "inside", "upto"))
    cut = df.withColumn(head, F.substring(order, 1, digits))
    whole = Window.partitionBy(*by, head).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn(inside, F.coalesce(F.sum(value).over(whole), F.lit(0)))
    if not digits:
        return summed.withColumnRenamed(inside, name).drop(head)
    parts = rows.written(cut.groupBy(*by, head).agg(F.sum(value).alias(part)), "parts")
    sums = rows.small(rows.written(before(parts, by, head, F.col(part), digits - DIGITS, upto).drop(part), "upto"))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = summed.alias("a").join(sums.alias("b"), functools.reduce(lambda x, y: x & y, keys, F.col(f"a.{head}") == F.col(f"b.{head}")))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{inside}") + F.col(f"b.{upto}")).alias(name))
