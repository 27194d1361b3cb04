"""Merkle fixity audit of archive replicas.

Records are hashed; the hashes of the records that start in one range of offsets are hashed in
order, and so are ranges of ranges, up to one root per archive. Two replicas are compared
from the roots down, and only branches that differ are opened, to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.llm import order, rows

#: Bytes of an archive under one lowest node, and children of a higher node.
RANGE, FAN_OUT = 1 << 16, 16
#: Records of an archive made by ``layout``.
PER_ARCHIVE = 1024
DATE = "2024-01-01T00:00:00Z"


def warc_record(key: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as text; a null url or body is empty, a null key has no number."""
    held = F.coalesce(body, F.lit(""))
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: " + DATE + "\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(held).cast("string"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, held, F.lit("\r\n\r\n"))


def layout(records: DataFrame, key: str, record: str, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """``archive, offset, length, digest, key``: records placed one after the other, by key and digest.

    An archive holds the records of ``per_archive`` consecutive keys; rows without a key are dealt
    to archives by their digest. Keys may repeat: offsets are running totals over windows of
    bounded size, so an archive may hold any share of the table. A null record is empty. Contents
    are hashed where they are, also very long ones; only digests are moved.
    """
    content = F.coalesce(F.col(record), F.lit("")).cast("binary")
    length, digest = F.octet_length(content).cast("bigint").alias("length"), F.sha2(content, 256).alias("digest")
    narrow = rows.written(records.select(F.col(key), length, digest), "records")
    number = F.coalesce(F.floor(F.col(key) / per_archive).cast("string"), F.concat(F.lit("x"), F.substring("digest", 1, 4)))
    placed = narrow.withColumn("archive", F.concat(F.lit("pages-"), number))
    rank, place = rows.OWN + "rank", rows.OWN + "place"
    placed = order.ranked(placed, ["archive"], [key, "digest"], rank)
    most = placed.agg(F.max(rank)).first()[0] or 0
    text, width = order.hexadecimal(F.col(rank), most + 1)
    summed = order.before(placed.withColumn(place, text), ["archive"], place, F.col("length"), width - order.DIGITS, "offset")
    return summed.select("archive", "offset", "length", "digest", key)


def tree(manifest: DataFrame, levels: int) -> list[DataFrame]:
    """Written node tables ``archive, node, hash``, from the lowest level to the roots.

    A lowest node has at most RANGE different starts and a higher one FAN_OUT children, so
    no group grows with the archive.
    """
    start = F.struct("offset", "length", "digest")
    lowest = manifest.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node")).agg(F.sort_array(F.collect_set(start)).alias("parts"))
    text = F.transform("parts", lambda p: F.concat_ws(":", p["offset"].cast("string"), p["length"].cast("string"), p["digest"]))
    nodes = [rows.written(lowest.select("archive", "node", F.sha2(F.array_join(text, "\n"), 256).alias("hash")), "nodes")]
    for _ in range(levels):
        above = nodes[-1].groupBy("archive", F.floor(F.col("node") / FAN_OUT).alias("node"))
        parts = above.agg(F.sort_array(F.collect_list(F.struct(nodes[-1]["node"].alias("child"), "hash"))).alias("parts"))
        text = F.transform("parts", lambda p: F.concat_ws(":", p["child"].cast("string"), p["hash"]))
        nodes.append(rows.written(parts.select("archive", "node", F.sha2(F.array_join(text, "\n"), 256).alias("hash")), "nodes"))
    return nodes


def audit(ours: DataFrame, theirs: DataFrame, record: str) -> DataFrame:
    """Records in which two replicas differ: ``archive, offset, record, kind, length, digest, their_length, their_digest``.

    Manifests have ``archive, offset, length, digest`` and the record's name; ``kind`` is
    ``missing`` (not in the second), ``extra`` (only there) or ``changed``. Repeated rows of a
    manifest count once; records without archive or offset are left out; different records
    at one offset are compared with each other. Equal or empty replicas give no row. Other
    columns are ignored.
    """
    columns = ["archive", "offset", "length", "digest", record]
    known = F.col("archive").isNotNull() & F.col("offset").isNotNull()
    sides = [rows.written(m.where(known).select(columns).distinct(), "manifest") for m in (ours, theirs)]
    last = max(m.agg(F.max("offset")).first()[0] or 0 for m in sides)
    levels, top = 0, last // RANGE
    while top:
        levels, top = levels + 1, top // FAN_OUT
    a, b = (tree(m, levels) for m in sides)
    suspects = None
    for level in range(levels, -1, -1):
        left, right = a[level], b[level].withColumnRenamed("hash", "other")
        if suspects is not None:
            parent = F.floor(F.col("node") / FAN_OUT).alias("node_up")
            up = rows.small(suspects.withColumnRenamed("node", "node_up"))
            left, right = (t.select("*", parent).join(up, ["archive", "node_up"], "left_semi").drop("node_up") for t in (left, right))
        both = left.join(right, ["archive", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other")))
        suspects = rows.written(both.select("archive", "node"), "suspects")
    branch = F.floor(F.col("offset") / RANGE).alias("node")
    left, right = (m.select("*", branch).join(rows.small(suspects), ["archive", "node"], "left_semi").drop("node") for m in sides)
    right = right.select("archive", "offset", F.col("length").alias("their_length"), F.col("digest").alias("their_digest"), F.col(record).alias("_record"))
    both = left.join(right, ["archive", "offset"], "full")
    same = F.col("digest").eqNullSafe(F.col("their_digest")) & F.col("length").eqNullSafe(F.col("their_length"))
    kind = F.when(F.col("their_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return both.where(~same).select(
        "archive", "offset", F.coalesce(record, "_record").alias(record), kind.alias("kind"), "length", "digest", "their_length", "their_digest"
    )
