"""Row keys for tables whose ids are null or repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.sources.scratch import materialize

CHUNK = 4096

# Repeated digests that may be broadcast.
BROADCAST_ROWS = 1_000_000


def with_occurrence_key(df: DataFrame, columns: Sequence[str], key: str = "row_key") -> DataFrame:
    """Give every row a unique key that does not depend on the layout.

    The key is a digest of ``columns`` and the number of the copy. Digests are counted first, a
    narrow shuffle; rows whose digest is unique keep their place and get number 0. Copies are
    equal in all ``columns``, so they are counted (combined on the map side) and written out
    again: a row that makes up a third of the table is one aggregation buffer per task, and
    its copies come back in chunks spread over all tasks. No window and no group is ever
    held in one task. If more digests repeat than may be broadcast, all rows are counted in one shuffle instead of
    three. ``columns`` must be all columns of the table that are to be kept.
    """
    columns = list(columns)
    zero = F.lit(0).cast("bigint")
    digest = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    tagged = df.select(*columns, digest.alias("_digest"))
    counted = tagged.groupBy("_digest").agg(F.count("*").alias("_copies"))
    repeated = materialize(counted.filter("_copies > 1").select("_digest"), "repeated")
    named = F.concat_ws("-", "_digest", F.col("_copy").cast("string")).alias(key)
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
        unique = tagged.join(repeated, "_digest", "left_anti").withColumn("_copy", zero).select(named, *columns)
        copies = tagged.join(repeated, "_digest", "left_semi").groupBy("_digest", *columns).agg(F.count("*").alias("_copies"))
    else:
        every = tagged.groupBy("_digest", *columns).agg(F.count("*").alias("_copies"))
        few = every.filter(F.col("_copies") <= CHUNK)  # these stay where they were counted
        unique = few.withColumn("_copy", F.explode(F.sequence(zero, F.col("_copies") - 1))).select(named, *columns)
        copies = every.filter(F.col("_copies") > CHUNK)
    chunks = copies.withColumn("_chunk", F.explode(F.sequence(zero, F.expr(f"(_copies - 1) div {CHUNK}"))))
    first = F.col("_chunk") * CHUNK
    last = F.least(first + CHUNK, F.col("_copies")) - 1
    spread = chunks.repartition("_digest", "_chunk").withColumn("_copy", F.explode(F.sequence(first, last)))
    return unique.unionByName(spread.select(named, *columns))
