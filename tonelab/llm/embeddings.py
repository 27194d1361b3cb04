"""Near-duplicate embeddings by PCA-ordered tiled comparison.

All vectors are scaled to unit length and turned so that the dimensions come in the order
of their variance. Vectors are cut into tiles by the signs of their leading dimensions; a
tile is one row. A pair's cosine is at most the product over the first dimensions plus the
product of the norms of the rest; the same bound over the boxes of two tiles rules out whole
pairs of tiles, and inside a pair of tiles it leaves few pairs for the exact cosine. Pairs of
tiles are a Cartesian product that reads the written tiles again: no vector is shuffled for
it, so what lies on disk grows with the table and not with its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.llm import rows
from tonelab.llm.components import components
from tonelab.sources import scratch

#: Least number of vectors of a tile; a large table has tiles of 16 times as many, if they take TILE_BYTES at most.
TILE = 1024
TILE_BYTES = 1 << 22
#: Tiles that one task reads of each side: the first if the tasks are few, the second at most.
SIDE = (3, 16)
#: Pieces of each side, as long as SIDE allows: a vector has a row of links for each piece at most.
PIECES = 24
#: Rows and columns that are compared at once; they stay in a core's cache.
BLOCK = (512, 1024)
#: Links that a task gathers before it joins them.
LINKS = 1 << 20
#: Slack of the bounds against rounding; the final test uses the exact cosine.
SLACK = 1e-9
#: Rounding in a single-precision sum of products, for each of its terms, at most.
ROUNDING = 2.0**-23


def _moments(vectors: DataFrame, width: int, unit: Callable[[pd.Series], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum, second moments and number of the unit vectors: one small row per task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, second, n = np.zeros(width), np.zeros((width, width)), 0
        for b in batches:
            x = unit(b["v"])
            total += x.sum(axis=0)
            second += x.T @ x
            n += len(x)
        yield pd.DataFrame({"i": range(width + 1), "x": [total, *second], "n": [n] + [0] * width})

    parts = rows.map_frames(vectors.select("v"), partial, "i int, x array<double>, n bigint")
    flat = parts.select("i", "n", F.posexplode("x").alias("j", "x"))
    sums = flat.groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow().to_pandas()
    if sums.empty:
        return np.zeros(width), np.zeros((width, width)), 0
    grid = sums.pivot(index="i", columns="j", values="x").to_numpy()
    return grid[0], grid[1:], int(sums[(sums.i == 0) & (sums.j == 0)].n.iloc[0])


def _raw(column: pd.Series, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they are, shorter ones filled up with zeros, and their lengths."""
    raw = np.frombuffer(b"".join(column), kind)
    sizes = np.fromiter(map(len, column), np.int64, len(column)) // np.dtype(kind).itemsize
    return _filled(raw, sizes, width), sizes


def _filled(raw: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    if (sizes == width).all():
        return raw.reshape(len(sizes), width)
    x = np.zeros((len(sizes), width), raw.dtype)
    x[np.arange(width)[None, :] < sizes[:, None]] = raw
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """``key``, ``v``: the vector's components as bytes, null if it cannot be compared."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["x"]:
                a = None if x is None else np.asarray(x, kind)
                out.append(a.tobytes() if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
            yield pd.DataFrame({"key": b["key"], "v": pd.Series(out, dtype=object)})

    held = vectors.select(F.col(key).alias("key"), F.col(vector).cast(f"array<{'float' if kind == 'f4' else 'double'}>").alias("x"))
    whole = F.when(F.col("x").isNotNull() & ~F.exists("x", F.isnull), F.col("x")).alias("x")
    return rows.map_frames(held.select("key", whole), pack, f"key {dict(vectors.dtypes)[key]}, v binary")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: ``key``, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked if their cosine, in double precision, is at least ``threshold``.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest key
    reachable by links, ``kept`` says that the key is that one. Vectors that are null,
    empty, zero or hold null or non-finite components, and vectors of different
    lengths, are not linked. Equal vectors are compared once: copies count as links of each
    other. Null keys never are component ids, unless a component has no other. Repeated
    keys are rows of their own. Other columns are ignored; an empty table gives none.
    """
    spark = vectors.sparkSession
    kind = "f4" if dict(vectors.dtypes)[vector] == "array<float>" else "f8"
    digest = F.unhex(F.md5("v")).alias("id")
    with rows.freed(spark), rows.short_batches(spark):
        with scratch.scope(spark, "packed") as folder:
            packed = rows.written(_packed(vectors, key, vector, kind), "vectors")
        keys = rows.written(packed.select("key", digest), "keys")
        counted = packed.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first"))
        classes = rows.written(counted.select(F.monotonically_increasing_id().alias("num"), digest, "copies", "first", "v"), "classes")
        scratch.remove(spark, folder)
        width = (classes.agg(F.max(F.octet_length("v"))).first()[0] or 8) // np.dtype(kind).itemsize
        found = _compare(classes, max(1, width), kind, threshold, tile)
        counted = found.groupBy(F.col("u").alias("num")).agg(F.sum("n").alias("others"))
        groups = components(found.select("u", "v"))
    named = classes.select("num", "id", "copies", "first").join(groups.withColumnRenamed("node", "num"), "num", "left")
    named = named.join(counted, "num", "left").withColumn("component", F.coalesce("component", "num"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    result = named.join(least, "component").select(
        "id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    out = keys.join(result, "id", "left")
    alone = F.col("id").isNull()
    return out.select(
        F.col("key").alias(key),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("key").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def _compare(classes: DataFrame, width: int, kind: str, threshold: float, tile: int) -> DataFrame:
    """Written rows ``(u, v, n)``: ``n`` links of class ``u`` to other classes; ``v`` is reached from it by links.

    A class has a row for each task that found links of it; those of a class and of all that it
    is linked to meet in the ``v`` of some rows.
    """
    spark = classes.sparkSession
    unit = lambda column: _unit(_raw(column, width, kind)[0])
    total, second, n = _moments(classes, width, unit)
    if not n:
        return spark.createDataFrame([], "u bigint, v bigint, n bigint")
    tile = max(tile, min(16 * tile, n // 24, TILE_BYTES // (width * np.dtype(kind).itemsize)))
    _, axes = np.linalg.eigh(second)
    axes = axes[:, ::-1].copy()
    lead = min(width, 16)
    middle = (total / n) @ axes
    splits = max(0, min(lead, math.floor(math.log2(n / tile))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            side = unit(b["v"]) @ axes[:, :splits] > middle[:splits]
            yield b.assign(cell=(side << np.arange(splits)).sum(axis=1) if splits else 0)

    held = rows.map_frames(classes.select("num", "copies", "v"), place, "num bigint, copies bigint, v binary, cell bigint")
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("num"), F.greatest(F.lit(1), F.round(F.col("size") / tile).cast("bigint")))
    dealt = held.join(F.broadcast(sizes), "cell").select("cell", part.alias("part"), "num", "copies", "v")
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per tile: its vectors one after the other, and its box; a larger one is cut."""
        now, parts, count, most = None, [], 0, 2 * tile
        for b in batches:
            for name, g in b.groupby(["cell", "part"], sort=False):
                if parts and name != now:
                    yield packed(pd.concat(parts))
                    parts, count = [], 0
                now = name
                while len(g):
                    parts.append(g.iloc[: most - count])
                    g, count = g.iloc[most - count :], count + len(parts[-1])
                    if count == most:
                        yield packed(pd.concat(parts))
                        parts, count = [], 0
        if parts:
            yield packed(pd.concat(parts))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        x, length = _raw(g["v"], width, kind)
        x = _unit(x) @ axes
        first = x[:, :lead]
        rest = np.sqrt((x[:, lead:] ** 2).sum(axis=1).max())
        held = [g["num"].iloc[0], first.min(axis=0), first.max(axis=0), rest]
        held += [g["num"].to_numpy(np.int64).tobytes(), g["copies"].to_numpy(np.int64).tobytes(), length.tobytes(), b"".join(g["v"])]
        return pd.DataFrame([held], columns=["no", "low", "high", "rest", "num", "copies", "size", "v"])

    form = "no bigint, low array<double>, high array<double>, rest double, num binary, copies binary, size binary, v binary"
    with scratch.scope(spark, "tiled") as folder:
        # Short row groups: a reader holds one whole.
        short = {"parquet.block.size": 4 * TILE_BYTES, "parquet.page.size.row.check.min": 1}
        tiles = rows.written(rows.map_frames(dealt, gather, form), "tiles", **short)
    n_tiles = tiles.count()
    pieces = max(min(math.ceil(n_tiles / SIDE[0]), PIECES), math.ceil(n_tiles / SIDE[1]))
    a, b = (tiles.select(*(F.col(c).alias(f"{side}_{c}") for c in tiles.columns)).coalesce(pieces) for side in "ab")
    # Each pair once, and half of the pairs in each piece.
    once = (F.col("a_no") == F.col("b_no")) | ((F.col("a_no") < F.col("b_no")) == ((F.col("a_no") + F.col("b_no")) % 2 == 0))

    def best(so_far: Column, d: Column) -> Column:
        return so_far + F.greatest(*(F.col(f"a_{x}")[d] * F.col(f"b_{y}")[d] for x in ("low", "high") for y in ("low", "high")))

    reach = F.aggregate(F.sequence(F.lit(0), F.lit(lead - 1)), F.col("a_rest") * F.col("b_rest"), best)
    pairs = a.join(b.hint("shuffle_replicate_nl"), once & (reach >= threshold - SLACK))
    columns = [f"{side}_{c}" for side in "ab" for c in ("no", "num", "copies", "size", "v")]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, left, seen = _Task(axes, threshold), None, {}  # seen: one of the SIDE tiles that come again with each left one
        for b in batches:
            for x in b.itertuples(index=False):
                if left is None or left.no != x.a_no:
                    left = _Side(x.a_no, x.a_num, x.a_copies, x.a_size, x.a_v, width, kind)
                    turned = task.turn(left)
                if x.a_no == x.b_no:
                    task.compare(left, left, turned, turned)
                    continue
                right = _Side(x.b_no, x.b_num, x.b_copies, x.b_size, x.b_v, width, kind)
                if right.no not in seen:
                    seen[right.no] = task.turn(right)
                task.compare(left, right, turned, seen[right.no])
        yield task.table()

    found = rows.written(rows.map_frames(pairs.select(columns), find, "u bigint, v bigint, n bigint"), "pairs")
    scratch.remove(spark, folder)
    return found


class _Side:
    """Vectors of a tile."""

    def __init__(self, no: int, num: bytes, copies: bytes, size: bytes, v: bytes, width: int, kind: str):
        self.no = no
        self.num, self.copies, self.size = (np.frombuffer(x, np.int64) for x in (num, copies, size))
        self.raw = _filled(np.frombuffer(v, kind), self.size, width)
        self.whole: np.ndarray | None = None
        self.asked = 0

    def unit(self, i: np.ndarray) -> np.ndarray:
        """Unit vectors of some rows; those of all rows are kept when as many were asked for."""
        self.asked += len(i)
        if self.whole is None and self.asked < len(self.num):
            return _unit(self.raw[i])
        self.whole = _unit(self.raw) if self.whole is None else self.whole
        return self.whole[i]


class _Task:
    """Goes through pairs of tiles: how many links each vector has, and what they connect."""

    def __init__(self, axes: np.ndarray, threshold: float):
        self.axes, self.threshold = axes, threshold
        self.least = np.float32(threshold - SLACK - (2 * len(axes) + 16) * ROUNDING)
        self.start: dict[int, int] = {}
        self.num, self.n, self.label = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_open = 0

    def turn(self, side: _Side) -> np.ndarray:
        """The vectors in the order of the axes."""
        return (_unit(side.raw) @ self.axes).astype(np.float32)

    def compare(self, a: _Side, b: _Side, x: np.ndarray, y: np.ndarray) -> None:
        """Add the links between two tiles, or inside one if both are the same; ``x`` and ``y`` are their turned vectors."""
        k = self.dimensions(x, y)
        x, y = _lead(x, k), _lead(y, k)
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(x), BLOCK[0]):
            for to in range(0, len(y), BLOCK[1]):
                if a is b and to + BLOCK[1] <= at:
                    continue
                bound = x[at : at + BLOCK[0]] @ y[to : to + BLOCK[1]].T
                some = np.flatnonzero(bound.max(axis=1) >= self.least)
                if not len(some):
                    continue
                i, j = np.nonzero(bound[some] >= self.least)
                near.append((at + some[i], to + j))
                if len(near) >= 64 or sum(len(i) for i, _ in near) >= LINKS // 8:
                    self.settle(a, b, near)
                    near = []
        self.settle(a, b, near)

    def settle(self, a: _Side, b: _Side, near: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Add those of the pairs whose exact cosine reaches the threshold."""
        if not near:
            return
        i, j = (np.concatenate(x) for x in zip(*near, strict=True))
        if a is b:
            i, j = i[i < j], j[i < j]
        sure = (_cosines(a, b, i, j) >= self.threshold) & (a.size[i] == b.size[j])
        if sure.any():
            self.add(a, b, i[sure], j[sure])

    def dimensions(self, x: np.ndarray, y: np.ndarray) -> int:
        """How many dimensions to compare first: the fewest that leave few pairs, judged by some rows of both sides.

        Measured in dimensions of a pair, a block in which a pair is left costs as much as 4 more, a row of it
        as 60 more, and a pair that is left as 1,500.
        """
        x, y = (t[side :: max(1, min(len(t) // 128, 32))] for side, t in enumerate((x, y)))
        costs = {}
        for k in [*range(7, x.shape[1], 4), x.shape[1]]:
            left = _lead(x, k) @ _lead(y, k).T >= self.least
            share = left.mean() if left.size else 0
            some = [1 - math.exp(-n * share) for n in (BLOCK[0] * BLOCK[1], BLOCK[1])]
            costs[k] = k + 4 * some[0] + 60 * some[1] + 1500 * share
        return min(costs, key=costs.get)

    def at(self, side: _Side) -> int:
        """Place of the side's first vector."""
        if side.no not in self.start:
            self.start[side.no] = had = len(self.num)
            self.num = np.concatenate([self.num, side.num])
            self.n = np.concatenate([self.n, np.zeros(len(side.num), np.int64)])
            self.label = np.concatenate([self.label, np.arange(had, len(self.num))])
        return self.start[side.no]

    def add(self, a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> None:
        """Links of vectors ``i`` of ``a`` with ``j`` of ``b``."""
        at_a, at_b = self.at(a), self.at(b)
        np.add.at(self.n, at_a + i, b.copies[j])
        np.add.at(self.n, at_b + j, a.copies[i])
        self.open.append((at_a + i, at_b + j))
        self.n_open += len(i)
        if self.n_open >= LINKS:
            self.join()

    def join(self) -> None:
        """Linked vectors get the least place among those they are connected to as label."""
        if not self.open:
            return
        a, b = (np.concatenate(x) for x in zip(*self.open, strict=True))
        self.open, self.n_open, label = [], 0, self.label
        while len(a):
            high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            apart = high != low
            a, b = a[apart], b[apart]
            np.minimum.at(label, high[apart], low[apart])
            while (label[label] != label).any():
                label = label[label]
        self.label = label

    def table(self) -> pd.DataFrame:
        self.join()
        some = np.flatnonzero(self.n)
        return pd.DataFrame({"u": self.num[some], "v": self.num[self.label[some]], "n": self.n[some]})


def _lead(turned: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` dimensions and the norm of the rest, so that products are bounds of the cosine."""
    rest = turned[:, k:]
    return np.hstack([turned[:, :k], np.sqrt(np.einsum("ij,ij->i", rest, rest))[:, None]])


def _cosines(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Cosines of vectors ``i`` of ``a`` with vectors ``j`` of ``b``, in bounded memory."""
    parts = [np.einsum("ij,ij->i", a.unit(i[s : s + chunk]), b.unit(j[s : s + chunk])) for s in range(0, len(i), chunk)]
    return np.concatenate(parts) if parts else np.zeros(0)
