"""Durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR, MINUTE = 86400, 3600, 60


def format_duration(seconds: Column) -> Column:
    """Whole seconds (cut off) as ``H:MM:SS``, with ``N day(s), `` from one day on."""
    whole = seconds.cast("bigint")
    days = F.floor(whole / DAY).cast("bigint")
    rest = whole % DAY
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / HOUR).cast("bigint"),
        F.floor(rest % HOUR / MINUTE).cast("bigint"),
        rest % MINUTE,
    )
    return (
        F.when(days == 0, clock)
        .when(days == 1, F.concat(F.lit("1 day, "), clock))
        .otherwise(F.concat(days.cast("string"), F.lit(" days, "), clock))
    )
