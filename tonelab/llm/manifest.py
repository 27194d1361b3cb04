"""Merkle manifest of a dataset as a content-addressed graph: digests and their children.

The rows of a group (a language, say) are leaves in the order of their key. Runs of eight nodes
are hashed to a node of the next level until one is left, the group's subroot; subroots are
hashed to the root in the same way. Every node is stored once, by its digest, with its children.

A proof needs the siblings of all nodes on the way from a leaf to the root. Requests for leaves descend
from the root: at each node the next digit of a leaf's rank, to base eight, selects a child, and the
other children become a segment of the path. Requests that share their first digits are one row until
they part, so no record is asked for once per leaf, and paths meet the leaves in runs of
eight. At the end a path's segments, collected from the root down, are turned round.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.llm import order, rows

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ABSENT = "-"
SEGMENT = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` for null, else bytes of the text, a colon and the text: values cannot run into each other."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit(ABSENT))


def leaf(docs: DataFrame, fields: Sequence[str] = FIELDS, **other: Column) -> Column:
    """Digest of a row; ``other``: values that take the place of fields."""
    return digest(*[field(other.get(name, docs[name])) for name in fields])


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``tree, rank, key, leaf`` and ``other``; ``trees``: ``tree, by, n, height, subroot``.

    ``nodes[h]`` and ``top[h]`` hold ``digest, children`` of the nodes h + 1 levels above leaves and subroots.
    """

    leaves: DataFrame
    trees: DataFrame
    nodes: tuple[DataFrame, ...]
    top: tuple[DataFrame, ...]
    root: str | None
    key: str
    by: str
    fan_out: int


def _levels(level: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of all levels above ``tree, at, digest, n``, and the last node of each tree.

    ``n``: nodes of the tree at this level. Each group holds at most ``fan_out`` rows.
    """
    records, ends = [], []
    while True:
        ends.append(level.where("n = 1").select("tree", F.col("digest").alias("subroot"), F.lit(len(records)).alias("height")))
        runs = level.where("n > 1").groupBy("tree", F.expr(f"at div {fan_out}").alias("at"), "n")
        child = F.struct("at", "digest")
        met = runs.agg(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["digest"]).alias("children"))
        level = met.select("tree", "at", F.expr(f"(n - 1) div {fan_out} + 1").alias("n"), digest(F.array_join("children", "")).alias("digest"), "children")
        level = rows.written(level, "level")
        if not level.limit(1).count():
            return records, functools.reduce(DataFrame.unionByName, ends)
        records.append(rows.written(level.select("digest", "children").dropDuplicates(["digest"]), "records"))


def build(docs: DataFrame, key: str = "doc_id", by: str = "lang", fields: Sequence[str] = FIELDS, *, fan_out: int = FAN_OUT, also: str | None = None) -> Manifest:
    """Hash ``docs`` into a tree per value of ``by`` and one tree above them.

    Leaves ascend by ``key`` (nulls first), equal keys by digest; trees ascend by ``by`` as UTF-8, null
    first. Only digests are sorted and shuffled, texts are hashed where they are, whole. Equal rows are
    leaves of their own with equal digests, of which the records keep one. A null is unlike
    an empty text. Other columns are ignored. An empty table has no root. ``also`` is a column kept beside the leaves.
    """
    extra = F.col(also) if also else F.lit(None).cast("string")
    narrow = docs.select(F.col(by).alias("by"), F.col(key).alias("key"), leaf(docs, fields).alias("leaf"), extra.alias("other"))
    narrow = rows.written(narrow, "narrow")  # the sort reads its input twice
    placed = rows.written(order.ranked(narrow, ["by"], ["key", "leaf"]).drop(order.NUMBER), "leaves")
    counted = rows.written(placed.groupBy("by").agg(F.count(F.lit(1)).alias("n")), "trees")
    numbers = rows.written(order.ranked(counted, [], ["by"], "tree").drop(order.NUMBER), "trees")
    n_trees = numbers.count()
    names = rows.small(numbers.withColumnRenamed("by", "name"), n_trees)
    leaves = rows.written(placed.join(names, F.col("by").eqNullSafe(F.col("name"))).select("tree", "rank", "key", "leaf", "other", "n"), "leaves")
    nodes, ends = _levels(leaves.select("tree", F.col("rank").alias("at"), F.col("leaf").alias("digest"), "n"), fan_out)
    trees = rows.written(numbers.join(ends, "tree"), "trees")
    top, last = _levels(trees.select(F.lit(0).alias("tree"), F.col("tree").alias("at"), F.col("subroot").alias("digest"), F.lit(n_trees).alias("n")), fan_out)
    root = last.first()
    return Manifest(leaves.drop("n"), trees, tuple(nodes), tuple(top), root["subroot"] if root else None, key, by, fan_out)


def _descend(requests: DataFrame, records: DataFrame, fan_out: int) -> DataFrame:
    """One step: ``at, digest, path`` and columns that go along, for each child of each node asked for."""
    others = [c for c in requests.columns if c not in ("at", "digest", "path")]
    opened = requests.join(records, "digest").select(*others, "at", "path", "children", F.posexplode("children").alias("digit", "child"))
    return opened.select(*others, (F.col("at") * fan_out + F.col("digit")).alias("at"), F.col("child").alias("digest"), _longer("digit").alias("path"))


def _longer(digit: str) -> Column:
    """The path with a segment of the children not selected."""
    segment = F.struct(
        F.array_join(F.expr(f"slice(children, 1, {digit})"), "").alias("before"),
        F.array_join(F.expr(f"slice(children, {digit} + 2, size(children))"), "").alias("after"),
    )
    return F.concat("path", F.array(segment))


def prove(m: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """``key, leaf, other, subroot, root, path`` for the leaves asked for: all, or those with ``tree`` and ``rank`` in ``wanted``.

    ``path``: from the leaf to the root, the siblings before and after each node, as text; a node
    without siblings has empty ones. Equal leaves get the path of their own place.
    """
    leaves = m.leaves if wanted is None else m.leaves.join(wanted.select("tree", "rank"), ["tree", "rank"], "left_semi")
    spark = leaves.sparkSession
    start = spark.createDataFrame([(0, m.root)] if m.root else [], "at bigint, digest string")
    found = start.withColumn("path", F.array().cast(SEGMENT))
    for records in reversed(m.top):
        found = _descend(found, records, m.fan_out)
    subroots = found.select(F.col("at").alias("tree"), "digest", "path")
    subroots = rows.written(subroots.join(m.trees.select("tree", "height", "subroot"), "tree"), "subroots")
    runs = leaves.groupBy("tree", F.expr(f"rank div {m.fan_out}").alias("at")).agg(
        F.collect_list(F.struct(F.expr(f"CAST(rank % {m.fan_out} AS INT)").alias("digit"), "key", "leaf", "other")).alias("asked")
    )
    at_subroot = lambda h: subroots.where(F.col("height") == h).select("tree", "subroot", F.lit(0).cast("bigint").alias("at"), "digest", "path")
    found = at_subroot(len(m.nodes))
    for h in range(len(m.nodes), 1, -1):
        found = _descend(found, m.nodes[h - 1], m.fan_out).unionByName(at_subroot(h - 1))
    alone = at_subroot(0).join(runs, ["tree", "at"]).select("subroot", "path", F.explode("asked").alias("a"))
    out = [alone.select("a.*", "subroot", "path")]
    if m.nodes:
        met = found.join(m.nodes[0], "digest").join(runs, ["tree", "at"])
        each = met.select("subroot", "path", "children", F.explode("asked").alias("a")).select("a.*", "subroot", "path", "children")
        out.append(each.withColumn("path", _longer("digit")).drop("children"))
    both = functools.reduce(DataFrame.unionByName, out)
    return both.select(F.col("key").alias(m.key), "leaf", "other", "subroot", F.lit(m.root).alias("root"), F.reverse("path").alias("path"))


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, level by level upwards."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))
