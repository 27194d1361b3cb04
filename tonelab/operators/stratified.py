"""Exact stratified splits and folds without sorting or shuffling the rows.

Rows of a class are ordered by ``md5(seed | row key)``. Every role (test, val,
train, fold 1, ...) is a stretch of that order, so a split is described by one
hash bound per class and role. Finding the bounds takes

1. a count per (class, hash prefix) - combined on the map side, at most
   ``labels * 16**PREFIX_DIGITS`` rows come out of it;
2. a running sum over that bounded table, which names the few prefixes in which
   a bound lies;
3. a ranking of the rows in those prefixes only.

Only class counts and the bounds themselves reach the driver (labels x roles
values). Assigning roles is then a CASE expression on the hash: a narrow map
that never moves the text. All layouts asked for are fitted together.

Row keys must be unique for exact sizes (see ``keys.with_occurrence_key``);
copies of one key always share a role.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

PREFIX_DIGITS = 4
FIFTH = Fraction(1, 5)
HALF = Fraction(1, 2)

Counts = Mapping[int, int]
Segments = list[tuple[str, Counts]]
Layout = Callable[[Counts], Segments]


def held_out(counts: Counts, fraction: Fraction) -> dict[int, int]:
    """Rows to hold out per class: ``ceil(n * fraction)`` shared out by class size.

    Each class gets the whole part of its share; what is left goes one each to
    the largest remainders, lower label first.
    """
    n = sum(counts.values())
    if n == 0:
        return dict.fromkeys(counts, 0)
    total = -(-n * fraction.numerator // fraction.denominator)
    quota = {c: m * total // n for c, m in counts.items()}
    remainder = {c: m * total % n for c, m in counts.items()}
    for c in sorted(counts, key=lambda c: (-remainder[c], c))[: total - sum(quota.values())]:
        quota[c] += 1
    return quota


def _minus(counts: Counts, taken: Counts) -> dict[int, int]:
    return {c: n - taken[c] for c, n in counts.items()}


def train_test(test: Fraction = FIFTH) -> Layout:
    """Two roles: test and train."""

    def layout(counts: Counts) -> Segments:
        held = held_out(counts, test)
        return [("test", held), ("train", _minus(counts, held))]

    return layout


def train_val_test(held: Fraction = FIFTH, test: Fraction = HALF) -> Layout:
    """Hold out a part, then divide it into val and test (80/10/10)."""

    def layout(counts: Counts) -> Segments:
        outer = held_out(counts, held)
        inner = held_out(outer, test)
        return [("test", inner), ("val", _minus(outer, inner)), ("train", _minus(counts, outer))]

    return layout


def nested(test: Fraction = FIFTH, val: Fraction = FIFTH) -> Layout:
    """Hold out test, then hold out val from the rest (64/16/20)."""

    def layout(counts: Counts) -> Segments:
        outer = held_out(counts, test)
        rest = _minus(counts, outer)
        inner = held_out(rest, val)
        return [("test", outer), ("val", inner), ("train", _minus(rest, inner))]

    return layout


def kfold(k: int, test: Fraction = FIFTH) -> Layout:
    """Fixed test part, the rest in ``k`` folds named ``fold1`` ... ``foldk``.

    Fold sizes are those of dealing the rest, ordered by class, out to the folds
    in turn: sizes differ by at most one over all rows and within each class.
    """

    def layout(counts: Counts) -> Segments:
        outer = held_out(counts, test)
        rest = _minus(counts, outer)
        folds: list[dict[int, int]] = [{} for _ in range(k)]
        start = 0
        for c in sorted(rest):
            for f in range(k):
                offset = (f - start) % k
                folds[f][c] = max(0, -(-(rest[c] - offset) // k))
            start += rest[c]
        return [("test", outer), *((f"fold{f + 1}", sizes) for f, sizes in enumerate(folds))]

    return layout


def order_hash(key: str, seed: int) -> str:
    """SQL for the value that orders the rows of a class."""
    return f"md5(concat_ws('|', '{int(seed)}', CAST(`{key}` AS STRING)))"


@dataclass(frozen=True)
class Cuts:
    """Fitted bounds. ``bounds[layout][label]`` lists (role, last hash or None for the end)."""

    bounds: dict[str, dict[int, list[tuple[str, str | None]]]]
    sizes: dict[str, dict[str, dict[int, int]]]
    hash_sql: str
    label: str

    def assign(self, df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        """Add the role in each layout: ``columns`` maps layout to column name. Narrow."""
        hashed = df.withColumn("_hash", F.expr(self.hash_sql))
        return hashed.withColumns({c: F.expr(self._role(layout)) for layout, c in columns.items()}).drop("_hash")

    def _role(self, layout: str) -> str:
        by_label = []
        for label, stretches in self.bounds[layout].items():
            whens = "".join(f" WHEN _hash <= '{last}' THEN '{name}'" for name, last in stretches[:-1])
            end = f"'{stretches[-1][0]}'"
            by_label.append(f" WHEN `{self.label}` = {label} THEN {f'CASE{whens} ELSE {end} END' if whens else end}")
        return f"CASE{''.join(by_label)} END"

    def size(self, layout: str, role: str) -> int:
        return sum(self.sizes[layout].get(role, {}).values())


def fit_cuts(
    df: DataFrame,
    layouts: Mapping[str, Layout],
    labels: Sequence[int],
    *,
    label: str = "label",
    key: str = "row_key",
    seed: int = 42,
    hash_column: str | None = None,
    prefix_digits: int = PREFIX_DIGITS,
) -> Cuts:
    """Find the hash bounds of every layout over the rows of ``df``.

    ``hash_column`` names a column that already holds ``order_hash``.
    """
    hash_sql = f"`{hash_column}`" if hash_column else order_hash(key, seed)
    rows = df.filter(F.col(label).isin(*labels)).selectExpr(f"`{label}` AS label", f"{hash_sql} AS h")
    prefix = F.substring("h", 1, prefix_digits).alias("bucket")
    buckets = rows.groupBy("label", prefix).agg(F.count("*").alias("n")).persist()
    try:
        found = buckets.groupBy("label").agg(F.sum("n").alias("n")).collect()
        counts = {c: 0 for c in labels} | {r["label"]: r["n"] for r in found}
        segments = {name: layout(counts) for name, layout in layouts.items()}
        ranks = {c: _inner_ranks(segments.values(), c, counts[c]) for c in labels}
        hashes = _hash_at_ranks(rows, buckets, ranks, prefix)
    finally:
        buckets.unpersist()
    bounds = {name: {c: _stretches(parts, c, counts[c], hashes) for c in labels} for name, parts in segments.items()}
    sizes = {name: {role: dict(by_label) for role, by_label in parts} for name, parts in segments.items()}
    return Cuts(bounds, sizes, hash_sql, label)


def _inner_ranks(all_segments, label: int, n: int) -> list[int]:
    """Ranks after which a role ends, without the ends of the class."""
    ranks = set()
    for segments in all_segments:
        end = 0
        for _, sizes in segments:
            end += sizes[label]
            ranks.add(end)
    return sorted(r for r in ranks if 0 < r < n)


def _stretches(segments: Segments, label: int, n: int, hashes) -> list[tuple[str, str | None]]:
    out: list[tuple[str, str | None]] = []
    end = 0
    for name, sizes in segments:
        if sizes[label] == 0:
            continue
        end += sizes[label]
        out.append((name, None if end == n else hashes[label, end]))
    return out or [(segments[-1][0], None)]


def _hash_at_ranks(rows: DataFrame, buckets: DataFrame, ranks: Mapping[int, list[int]], prefix: Column):
    """(label, rank) -> hash of the row with that rank."""
    if not any(ranks.values()):
        return {}
    lists = "".join(f" WHEN label = {c} THEN array({', '.join(f'{r}L' for r in rs)})" for c, rs in ranks.items() if rs)
    wanted = F.expr(f"CASE{lists} ELSE array() END")

    def ranks_within(size: str) -> Column:
        return F.expr(f"filter(ranks, r -> r > upto - {size} AND r <= upto)")

    # The bucket table is bounded, so a window per label over it is small.
    per_label = W.Window.partitionBy("label").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0)
    located = (
        buckets.withColumns({"upto": F.sum("n").over(per_label), "ranks": wanted})
        .withColumn("ranks", ranks_within("n"))
        .filter(F.size("ranks") > 0)
        .select("label", "bucket", (F.col("upto") - F.col("n")).alias("start"), "ranks")
    )
    # At most one row per wanted rank, so the broadcast side is bounded. Copies of
    # a key are counted before the shuffle and cannot make a bucket hot.
    edge = (
        rows.withColumn("bucket", prefix)
        .join(F.broadcast(located), ["label", "bucket"])
        .groupBy("label", "bucket", "start", "ranks", "h")
        .agg(F.count("*").alias("m"))
    )
    in_bucket = (
        W.Window.partitionBy("label", "bucket").orderBy("h").rowsBetween(W.Window.unboundedPreceding, 0)
    )
    hits = (
        edge.withColumn("upto", F.col("start") + F.sum("m").over(in_bucket))
        .withColumn("rank", F.explode(ranks_within("m")))
        .select("label", "rank", "h")
        .collect()
    )
    return {(r["label"], r["rank"]): r["h"] for r in hits}


@dataclass(frozen=True)
class Run:
    """One fit: K, the fold number, and the layout that holds its roles."""

    k: int
    fold: int
    layout: str

    @property
    def name(self) -> str:
        return f"k{self.k}_f{self.fold}"

    def role(self, column: str) -> str:
        """SQL for the role in this run, from the column with the role in the layout."""
        if self.k == 1:
            return column
        return f"CASE {column} WHEN 'test' THEN 'test' WHEN 'fold{self.fold}' THEN 'val' ELSE 'train' END"

    def trains(self, column: str) -> str:
        """SQL condition for training rows of this run."""
        return f"{column} = 'train'" if self.k == 1 else f"{column} NOT IN ('test', 'fold{self.fold}')"

    def sizes(self, cuts: Cuts) -> dict[str, int]:
        test = cuts.size(self.layout, "test")
        total = sum(cuts.size(self.layout, role) for role in cuts.sizes[self.layout])
        val = cuts.size(self.layout, "val" if self.k == 1 else f"fold{self.fold}")
        return {"train_n": total - test - val, "val_n": val, "test_n": test}


def fold_layouts(ks: Sequence[int] = (1, 3), test: Fraction = FIFTH, val: Fraction = FIFTH) -> dict[str, Layout]:
    """One layout per K: K = 1 is a single holdout, K > 1 a k-fold; all share the test part."""
    return {f"k{k}": nested(test, val) if k == 1 else kfold(k, test) for k in ks}


def fold_runs(ks: Sequence[int] = (1, 3)) -> list[Run]:
    return [Run(k, f, f"k{k}") for k in ks for f in range(1, k + 1)]


def role_rows(df: DataFrame, cuts: Cuts, runs: Sequence[Run], columns: Sequence[str]) -> DataFrame:
    """One row per input row and run: ``columns, K, fold, role``. Narrow."""
    layouts = {run.layout: f"_{run.layout}" for run in runs}
    entries = ", ".join(
        f"named_struct('K', {r.k}, 'fold', {r.fold}, 'role', {r.role(layouts[r.layout])})" for r in runs
    )
    return cuts.assign(df, layouts).selectExpr(*[f"`{c}`" for c in columns], f"inline(array({entries}))")


def split_sizes(assigned: DataFrame, by: Sequence[str] = ("K", "fold", "role")) -> DataFrame:
    """Rows per run and role."""
    return assigned.groupBy(*by).agg(F.count("*").alias("n"))
