"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Every source gets a target: its share by weight of the words wanted, bounded by how often it may
be repeated. The mix is a row of slots of equal numbers of words. Slot i takes the point i times
the golden ratio, modulo 1, and goes to the source on whose stretch of the cumulative
targets it falls, so any run of slots holds each source nearly in proportion. The r-th
slot of a source takes the r-th block of its texts, which are shuffled by hash, laid end to
end as often as needed and cut into blocks of the slots' size. A source's last slot is cut
at its target, and the few slots that the schedule gave it too few follow at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.llm import order, rows

#: Weights of the sources in order, repeated; words of the mix for each word of the table; times a text may be taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words of a slot.
BLOCK = 2048
#: Points are whole numbers below 2^32; neighbours lie the golden ratio apart.
POINT_BITS, STEP = 32, 2654435769
#: Texts of a source that share a window, about; least cells of the cumulative targets.
WINDOW, CELLS = 1024, 4096
SOURCE, SIZE, LINE, FROM = (rows.OWN + name for name in ("source", "size", "line", "from"))


def words(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def point(i: Column) -> Column:
    """``i`` times the golden ratio, as the first 32 bits behind the point; no product overflows."""
    low, high = i.bitwiseAND(0xFFFF), F.shiftright(i, 16).bitwiseAND(0xFFFF)
    upper = F.shiftleft((high * F.lit(STEP)).bitwiseAND(0xFFFF), 16)
    return (low * F.lit(STEP) + upper).bitwiseAND((1 << POINT_BITS) - 1)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, place, weight, target`` from ``source, source_size``, one row a source.

    ``place`` orders the sources by code point, null last; the weights are dealt in that order. All share
    ``share`` times the words there are; no target is above ``repeats`` times its source's
    size, and the excess is shared again by weight among the others until none is above.
    """
    nameless = F.col("source").isNull()
    last = order.ranked(sizes.withColumn(rows.OWN + "last", nameless), [], [rows.OWN + "last", "source"], "place")
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    table = last.select("source", "source_size", "place", F.get(dealt, (F.col("place") % len(weights)).cast("int")).alias("weight"))
    table = rows.written(table, "sources")
    wanted = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * float(repeats)
    left, rest, held = wanted, table.agg(F.sum("weight")).first()[0] or 0.0, 0
    while rest > 0:  # a share only grows, so whoever is above stays above
        above = left * F.col("weight") / rest > most
        full, weight, n = table.where(above).agg(F.sum(most), F.sum("weight"), F.count(F.lit(1))).first()
        if n == held:
            break
        left, held = wanted - full, n
        rest = table.where(~above).agg(F.sum("weight")).first()[0] or 0.0
    part = F.least(F.lit(left) * F.col("weight") / rest, most) if rest > 0 else most
    return table.withColumn("target", part)


def schedule(sources: DataFrame, n_sources: int, n_slots: int) -> DataFrame:
    """``place, slot, turn``: the source of each slot, and its how-manieth slot it is, from 0.

    ``sources``: ``place, share``, shares adding up to 1, and ``upto``, their sum before. A point is matched with
    the few stretches that lie in its cell, so no slot meets all sources, and a source with a third
    of the slots has a third of the cells.
    """
    bits = max(CELLS, 4 * n_sources).bit_length()
    scale = F.lit(float(1 << POINT_BITS))
    first, end = F.round(F.col("upto") * scale).cast("bigint"), F.round((F.col("upto") + F.col("share")) * scale).cast("bigint")
    stretch = sources.select("place", first.alias("first"), F.least(end, F.lit(1 << POINT_BITS)).alias("end")).where("end > first")
    cell = lambda c: F.shiftright(c, POINT_BITS - bits)
    cells = stretch.withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("end") - 1))))
    cells = rows.small(rows.written(cells, "cells"))
    slots = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("p"))
    met = slots.withColumn("cell", cell(F.col("p"))).join(cells, "cell").where("p >= first AND p < end").select("place", "slot")
    text, width = order.hexadecimal(F.col("slot"), n_slots)
    named = rows.written(met.withColumn("h", text), "slots")
    return order.before(named, ["place"], "h", F.lit(1), width - order.DIGITS, "turn").drop("h")


def measured(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Narrow rows: ``key``, SOURCE, SIZE (words of the text), NUMBER (unique) and LINE, a hash by which they are shuffled.

    The hash is that of the row's rank by key, source and text, so equal keys are spread as well.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(source).alias(SOURCE), words(F.col(text)).alias(SIZE), F.xxhash64(text).alias("text"))
    narrow = rows.written(narrow, "narrow")  # the sort reads its input twice
    placed = order.ranked(narrow, [], ["key", SOURCE, "text"]).drop("text")
    return placed.withColumn(LINE, F.md5(F.concat(F.lit("42:"), F.col("rank").cast("string")).cast("binary"))).drop("rank")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """The mix, and its accounts.

    First ``NUMBER, key, slot, place, offset, start, length``: words ``start`` to ``start + length`` of a row
    stand at ``offset`` of slot ``slot``; slots of equal number follow each other by ``place``, the number of the
    source. Then ``NUMBER, key, size, source_size, target, taken``, one row per row of ``docs``: its words,
    its source's words and target, and the words taken, repeats counted. The words of a
    source in the mix are its target, rounded; no row gives more than ``repeats`` times its words.

    A null text has no words, null is a source like others and stands last. Rows with null and repeated
    keys are rows of their own; equal rows are interchangeable. Long texts are taken in pieces.
    Other columns are ignored, so their names cannot clash. An empty table gives two empty ones.
    The result depends on the rows alone, not on their layout.
    """
    sized = rows.written(measured(docs, key, source, text), "sized")
    per_source = sized.groupBy(F.col(SOURCE).alias("source")).agg(F.sum(SIZE).alias("source_size"), F.count(F.lit(1)).alias("n"))
    per_source = rows.written(per_source, "per-source")
    counts = per_source.agg(F.count(F.lit(1)), F.sum("n")).first()
    wanted = targets(per_source.drop("n"), weights, share, repeats)
    quota = F.round("target").cast("bigint")
    name, width = order.hexadecimal(F.col("place"), counts[0])
    held = rows.written(wanted.withColumns({"quota": quota, "h": name}), "targets")
    total = held.agg(F.sum("quota")).first()[0] or 0
    upto = order.before(held, [], "h", F.col("quota"), width - order.DIGITS, "upto")
    shares = upto.select("place", *[(F.col(c) / F.lit(float(max(1, total)))).alias(n) for c, n in (("quota", "share"), ("upto", "upto"))])
    slots = rows.written(schedule(shares, counts[0], -(-total // block)), "schedule")
    # What the schedule gave too much goes, what it gave too little follows.
    need = F.ceil(F.col("quota") / F.lit(block)).cast("bigint")
    given = held.select("place", need.alias("need")).join(slots.groupBy("place").agg(F.count(F.lit(1)).alias("given")), "place", "left")
    given = given.withColumn("given", F.coalesce("given", F.lit(0).cast("bigint"))).where("need > given")
    end = slots.agg(F.max("slot")).first()[0]
    late = given.select("place", F.explode(F.sequence("given", F.col("need") - 1)).alias("turn")).withColumn("slot", F.lit(0 if end is None else end + 1) + F.col("turn"))
    turns = slots.unionByName(late)
    # The rows of a source in the order of their hash, end to end.
    names = held.select(F.col("source").alias(rows.OWN + "name"), "place", "quota", "source_size")
    known = sized.join(rows.small(names, counts[0]), F.col(SOURCE).eqNullSafe(F.col(rows.OWN + "name"))).drop(rows.OWN + "name", SOURCE)
    known = rows.written(known.where(F.col(SIZE) > 0), "known")
    digits = math.ceil(math.log2(max(1, (counts[1] or 0) / WINDOW)) / 4)
    line = rows.written(order.before(known, ["place"], LINE, F.col(SIZE), digits, FROM), "line")
    passes = line.select(order.NUMBER, "key", "place", "quota", SIZE, F.col(FROM), "source_size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass"))
    a = F.col(FROM) + F.col("pass") * F.col("source_size")
    reached = passes.withColumn("a", a).withColumn("b", F.least(F.col("a") + F.col(SIZE), F.col("quota"))).where("a < b")
    turn = F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))).alias("turn")
    pieces = reached.select(order.NUMBER, "key", "place", "a", "b", turn)
    pieces = pieces.withColumns({"from": F.greatest(F.col("a"), F.col("turn") * block), "to": F.least(F.col("b"), (F.col("turn") + 1) * block)})
    mixed = pieces.join(turns, ["place", "turn"]).select(
        order.NUMBER, "key", "slot", "place", (F.col("from") - F.col("turn") * block).alias("offset"),
        (F.col("from") - F.col("a")).alias("start"), (F.col("to") - F.col("from")).alias("length"),
    )
    mixed = rows.written(mixed, "mixed")
    taken = mixed.groupBy(order.NUMBER).agg(F.sum("length").alias("taken"))
    sums = held.select(F.col("source").alias(rows.OWN + "name"), "source_size", "target")
    every = sized.join(rows.small(sums, counts[0]), F.col(SOURCE).eqNullSafe(F.col(rows.OWN + "name"))).join(taken, order.NUMBER, "left")
    accounts = every.select(order.NUMBER, "key", F.col(SIZE).alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))
    return mixed.withColumnRenamed("key", key), accounts.withColumnRenamed("key", key)
