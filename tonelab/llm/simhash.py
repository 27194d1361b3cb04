"""SimHash fingerprints and covering locality-sensitive hashing of them.

Every bit position gets a non-zero vector of ``radius + 1`` bits. A table belongs to each
non-zero vector v and keeps the positions whose vector has an odd product with v. The up
to ``radius`` positions in which two fingerprints differ span less than the whole space, so
some v is orthogonal to all of them: in that table the two agree. No pair within the radius
is missed, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tonelab.llm import rows
from tonelab.llm.components import components
from tonelab.llm.linking import runs, spanning

BITS = 64
SEED = 42
#: Fingerprints compared with each other in one piece of work; larger buckets are split.
BLOCK = 2048


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Majority bits of the hashes of all word shingles, as an unsigned number; no word: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    first = (end - size)[: len(words) - shingle + 1].tolist()
    last = (end[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64, len(first))
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str, text: str = "text", shingle: int = 4) -> DataFrame:
    """Numbered rows -> ``_row``, ``key`` and ``fp`` (signed long); texts stay where they are."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], names=[rows.ROW, key, "fp"])

    narrow = docs.select(rows.ROW, key, F.col(text).cast("binary"))
    out = StructType([*narrow.schema.fields[:2], StructField("fp", LongType())])
    return narrow.mapInArrow(of, out)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; each pair of words within the radius agrees under one."""
    space = (1 << (radius + 1)) - 1
    vector = [i % space + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, space + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints ``fp`` -> spanning links ``(u, v)`` that connect what is within the radius.

    Buckets of equal masked bits are counted first; those above ``block`` are split into
    blocks, and every pair of blocks is a piece of work of its own. A piece returns at
    most one link per fingerprint, not its pairs.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(covering_masks(radius))])
    keyed = distinct.select("fp", F.explode(masks).alias("x")).select(
        "fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("k")
    )
    sizes = rows.written(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), parts.cast("bigint")).cast("int")
    met = keyed.join(sizes, ["t", "k"]).select("fp", "t", "k", parts.alias("parts"), own.alias("own"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pieces = met.select("t", "k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")
    dealt = pieces.repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b")

    def use(c: dict, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        u, v = [], []
        fp = c["fp"].view(np.uint64)
        two = starts[ends - starts == 2]
        near = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & ((c["a"][two] == c["b"][two]) | (c["own"][two] != c["own"][two + 1]))
        u.append(c["fp"][two[near]])
        v.append(c["fp"][two[near] + 1])
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            part = fp[s:e]
            label = spanning(np.bitwise_count(part[:, None] ^ part[None, :]) <= radius)
            hung = np.flatnonzero(label != np.arange(e - s))
            u.append(c["fp"][s:e][hung])
            v.append(c["fp"][s:e][label[hung]])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ({k: b[k].to_numpy() for k in b.columns} for b in batches)
        return runs(columns, ["t", "k", "a", "b"], use)

    return rows.map_frames(dealt, find, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``_row``, ``fp``, ``component_id``, ``kept``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; a component is
    what links connect, ``component_id`` its smallest key and ``kept`` marks exactly one
    row of it: the one with that key (nulls last, then the running number of ``numbered``).
    Empty, blank and null texts have the fingerprint 0 and form one component like any
    other. Equal fingerprints are grouped before they are compared, so exact copies cost
    one row. Other columns of ``docs`` are ignored; an empty table gives none.
    """
    whole = rows.numbered(docs, key)
    with rows.short_batches(docs.sparkSession):
        found = rows.written(fingerprints(whole, key, text, shingle), "fingerprints")
    joined = components(links(found.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    group = F.coalesce("component", "fp").alias("group")
    named = rows.written(found.join(joined, "fp", "left").select(key, rows.ROW, "fp", group), "groups")
    first = named.groupBy("group").agg(F.min(rows.ROW).alias("first"), F.min(key).alias("component_id"))
    first = rows.written(first, "first")
    kept = (F.col("first") == F.col(rows.ROW)).alias("kept")
    return named.join(first, "group").select(key, rows.ROW, "fp", "component_id", kept)
