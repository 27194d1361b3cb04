"""Multinomial naive Bayes as token counts; many fits from one counting job.

* ``fit`` explodes each training text once and counts, per token, one column per
  (fit, class). A row that trains several folds adds to several columns of the
  same group, so folds do not multiply rows or shuffles. The aggregation
  combines on the map side, so frequent tokens arrive as one row per task.
* Smoothing and prior weight do not change counts. Any number of them are
  scored from the same count table (``Candidate``).
* ``score`` joins tokens to the count table once, with one weight column per
  candidate and class after the first: only differences between classes matter,
  so weights are log odds against the first class.
* ``with_logits`` looks the words of a text up in a sorted table that each task holds, if the
  measured weights are small enough for that. It is a map: no row is moved, no text joined
  back, and a streaming DataFrame can be scored with it.
* ``with_joined_logits`` does the same for weights of any size: tasks hold the frequent words, and
  only words they do not hold are joined. It needs no key and takes streams too.

Log weights are kept as fixed-point integers while they are summed. Integer sums
do not depend on the order of the rows, so a retried task or another partitioning
gives the same scores, bit for bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tonelab.functions.scores import argmax
from tonelab.functions.tokens import words
from tonelab.sources.scratch import materialize

FIXED_POINT = 1e9

# Size check of the join in ``score``. A weight table of up to BROADCAST_BYTES is
# broadcast whole. Beyond that only the frequent tokens that fit are (see
# ``_head_share`` and ``_least_held``). Tokens longer than SHORT_BYTES are joined by a digest, which
# bounds the size of those rows too.
BROADCAST_BYTES = 256 * 1024 * 1024
SHORT_BYTES = 64
ROW_BYTES, SLOT_BYTES = 32, 9
# Weights that every Python worker may hold for ``with_logits``.
LOOKUP_BYTES = 64 * 1024 * 1024
# Rows of a stream that meet their rare words in one group.
BLOCK_ROWS = 512

# Every text starts with one empty token. Words are never empty, so the group of
# this token holds the document counts, and a row without words is not lost.
DOCUMENT = ""


@dataclass(frozen=True)
class Fit:
    """Which rows train a model (a SQL condition), and how many words of each text
    it reads (None: all)."""

    name: str
    in_train: str
    max_tokens: int | None = None


@dataclass(frozen=True)
class Candidate:
    """A scored model: a fit with smoothing (above 0) and prior weight."""

    name: str
    fit: str
    smoothing: float = 1.0
    prior_weight: float = 1.0


@dataclass(frozen=True)
class CountModel:
    """Fitted counts. ``counts`` grows with the vocabulary; the rest is a few numbers per fit."""

    counts: DataFrame
    labels: tuple[int, ...]
    limits: dict[str, int | None]
    documents: dict[str, dict[int, int]]
    tokens: dict[str, dict[int, int]]
    vocabulary: dict[str, int]
    n_tokens: int
    n_rows: int
    token_bytes: int

    def prior(self, candidate: Candidate, label: int) -> float:
        """Weighted log share of the class among training rows, add-one smoothed."""
        documents = self.documents[candidate.fit]
        total = sum(documents.values()) + len(self.labels)
        return candidate.prior_weight * math.log((documents[label] + 1) / total)

    def denominator(self, candidate: Candidate, label: int) -> float:
        return self.tokens[candidate.fit][label] + candidate.smoothing * self.vocabulary[candidate.fit]

    def weight_bytes(self, candidates: Sequence[Candidate]) -> int:
        """Size of the weight table of these candidates, nulls and row headers included."""
        return self.token_bytes + self.n_rows * _row_bytes(candidates, self.labels)


# Wide lists of near-equal expressions are written as SQL text: one call each
# instead of a dozen, which matters with many fits and settings.


def _column(fit: str, label: int) -> str:
    return f"n_{fit}_{label}"


def _row_bytes(candidates: Sequence[Candidate], labels: Sequence[int]) -> int:
    return ROW_BYTES + SLOT_BYTES * len(candidates) * (len(labels) - 1)


def _head_share(broadcast_bytes: int, candidates: Sequence[Candidate], labels: Sequence[int]) -> int:
    """How many frequent tokens fit into the budget. At most that many have at least
    1/share of all occurrences, so taking those keeps to the budget."""
    return max(1, broadcast_bytes // (SHORT_BYTES + _row_bytes(candidates, labels)))


def token_rows(df: DataFrame, columns: Sequence[Column | str], limited: bool, text: str = "text") -> DataFrame:
    """One row per word of the whole text, after one empty token per row.

    The position is kept only where a limit needs it; words count from 1.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    mark = F.array(F.lit(DOCUMENT))
    tokens = F.when(body == "", mark).otherwise(F.concat(mark, words(body)))
    exploded = F.posexplode(tokens).alias("position", "token") if limited else F.explode(tokens).alias("token")
    return df.select(*columns, exploded)


def _within(limit: int | None) -> str:
    return "true" if limit is None else f"position <= {limit}"


def fit(
    df: DataFrame, fits: Sequence[Fit], labels: Sequence[int], *, label: str = "label", text: str = "text"
) -> CountModel:
    """Count tokens for all fits in one pass over ``df``.

    Pass the table that will be scored, not only training rows: rows that train
    nothing add to ``n_total`` alone, and that is what finds the frequent tokens
    of the scored rows, also those no training row has.
    """
    limited = any(f.max_tokens is not None for f in fits)
    conditions = dict.fromkeys(f.in_train for f in fits)
    flags = {condition: f"_in_{i}" for i, condition in enumerate(conditions)}
    rows = df.selectExpr(
        f"`{label}` AS label", f"`{text}` AS text", *[f"({condition}) AS {flag}" for condition, flag in flags.items()]
    )
    counts = (
        token_rows(rows, ["label", *flags.values()], limited)
        .groupBy("token")
        .agg(
            *[
                F.expr(f"count_if({flags[f.in_train]} AND label = {c} AND {_within(f.max_tokens)})").alias(
                    _column(f.name, c)
                )
                for f in fits
                for c in labels
            ],
            F.count("*").alias("n_total"),
        )
    )
    limits = {f.name: f.max_tokens for f in fits}
    return _with_totals(materialize(counts, "token-counts"), limits, labels)


def _seen(fit: str, labels: Sequence[int]) -> str:
    """Is the token in the vocabulary of the fit?"""
    return "(" + " + ".join(_column(fit, c) for c in labels) + " > 0)"


def _with_totals(counts: DataFrame, limits: Mapping[str, int | None], labels: Sequence[int]) -> CountModel:
    """Totals per fit: one row of numbers, read from the written counts."""
    word = f"token <> '{DOCUMENT}'"
    columns = [_column(f, c) for f in limits for c in labels]
    row = counts.selectExpr(
        *[f"coalesce(sum({n}) FILTER (WHERE {word}), 0) AS t_{n}" for n in columns],
        *[f"coalesce(sum({n}) FILTER (WHERE NOT {word}), 0) AS d_{n}" for n in columns],
        *[f"count_if({word} AND {_seen(f, labels)}) AS v_{f}" for f in limits],
        f"coalesce(sum(n_total) FILTER (WHERE {word}), 0) AS n_tokens",
        "coalesce(sum(octet_length(token)), 0) AS token_bytes",
        "count(*) AS n_rows",
    ).first()
    return CountModel(
        counts=counts,
        labels=tuple(labels),
        limits=dict(limits),
        documents={f: {c: row[f"d_{_column(f, c)}"] for c in labels} for f in limits},
        tokens={f: {c: row[f"t_{_column(f, c)}"] for c in labels} for f in limits},
        vocabulary={f: row[f"v_{f}"] for f in limits},
        n_tokens=row["n_tokens"],
        n_rows=row["n_rows"],
        token_bytes=row["token_bytes"],
    )


def _log_total(model: CountModel, m: Candidate, label: int) -> float:
    return math.log(model.denominator(m, label) or 1.0)


def _log_weight(model: CountModel, m: Candidate, label: int) -> str:
    """Log probability of the token given the class; null outside the vocabulary of the fit."""
    smoothed = f"{_column(m.fit, label)} + {float(m.smoothing)!r}D"
    return f"CASE WHEN {_seen(m.fit, model.labels)} THEN ln({smoothed}) - {_log_total(model, m, label)!r}D END"


def log_probabilities(model: CountModel, candidates: Sequence[Candidate]) -> DataFrame:
    """Model table in long form: ``token, model, label, n, log_prob``."""
    entries = ", ".join(
        f"named_struct('model', '{m.name}', 'label', {c}, 'n', {_column(m.fit, c)},"
        f" 'log_prob', {_log_weight(model, m, c)})"
        for m in candidates
        for c in model.labels
    )
    words_only = model.counts.filter(F.col("token") != DOCUMENT)
    return words_only.selectExpr("token", f"inline(array({entries}))").filter("log_prob IS NOT NULL")


def score(
    df: DataFrame,
    model: CountModel,
    candidates: Sequence[Candidate],
    *,
    key: str = "row_key",
    carry: Sequence[str] = (),
    text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Logits of every candidate for every row: ``key, carry, logits_<candidate>``.

    A logit is the log odds against the first class, whose own logit is 0.
    ``carry`` names short columns that depend on the key; they ride along as
    grouping columns instead of being joined back. Tokens outside a fit's
    vocabulary count for nothing, and a row without any known token keeps its
    prior.
    """
    slots, weights = _weights(model, candidates)
    limited = any(model.limits[m.fit] is not None for m in candidates)
    tokens = token_rows(df, [key, *carry], limited, text)
    if model.weight_bytes(candidates) <= broadcast_bytes:
        joined = tokens.join(F.broadcast(weights.drop("n_total")), "token", "left")
    else:
        share = _head_share(broadcast_bytes, candidates, model.labels)
        least = min(-(-model.n_tokens // share), _least_held(model, candidates, broadcast_bytes))
        joined = _join_head_and_tail(tokens, weights, least)
    sums = joined.groupBy(key, *carry).agg(
        *[
            F.expr(f"coalesce(sum(CASE WHEN {_within(model.limits[m.fit])} THEN {w} END), 0L)").alias(w)
            for m, _, w in slots
        ]
    )

    return sums.selectExpr(*[f"`{c}`" for c in (key, *carry)], *_logits(model, slots, [w for _, _, w in slots]))


Slots = Sequence[tuple[Candidate, int, str]]


def _weights(model: CountModel, candidates: Sequence[Candidate]) -> tuple[Slots, DataFrame]:
    """Candidate, class and column of each weight, and the weight table: ``token, n_total``, weights in fixed point."""
    first, *others = model.labels
    slots = [(m, c, f"w_{i}_{c}") for i, m in enumerate(candidates) for c in others]

    def odds(m: Candidate, c: int) -> str:
        smoothed = [f"ln({_column(m.fit, x)} + {float(m.smoothing)!r}D)" for x in (c, first)]
        shift = _log_total(model, m, c) - _log_total(model, m, first)
        return f"CASE WHEN {_seen(m.fit, model.labels)} THEN {smoothed[0]} - {smoothed[1]} - {shift!r}D END"

    return slots, model.counts.filter(F.col("token") != DOCUMENT).selectExpr(
        "token",
        "n_total",
        *[f"CAST(round({odds(m, c)} * {FIXED_POINT!r}D) AS BIGINT) AS {w}" for m, c, w in slots],
    )


def _logits(model: CountModel, slots: Slots, sums: Sequence[str]) -> list[str]:
    """SQL of ``logits_<candidate>`` from the summed weights: zero for the first class, then sum and prior."""
    out: dict[str, list[str]] = {}
    for (m, c, _), total in zip(slots, sums, strict=True):
        prior = model.prior(m, c) - model.prior(m, model.labels[0])
        out.setdefault(m.name, []).append(f"{total} / {FIXED_POINT!r}D + {prior!r}D")
    return [f"array(0D, {', '.join(terms)}) AS logits_{name}" for name, terms in out.items()]


def can_look_up(model: CountModel, candidates: Sequence[Candidate], limit: int = LOOKUP_BYTES) -> bool:
    """Whether ``with_logits`` can score the candidates: small weights, and no limit on the words read."""
    return all(model.limits[m.fit] is None for m in candidates) and model.weight_bytes(candidates) <= limit


def with_logits(df: DataFrame, model: CountModel, candidates: Sequence[Candidate], *, text: str = "text") -> DataFrame:
    """``df`` with ``logits_<candidate>``: the logits of ``score``, bit for bit, in one map over the rows.

    Only for a model that ``can_look_up`` accepts: its weights come to the driver and go to every worker.
    """
    if not can_look_up(model, candidates):
        raise ValueError(f"the weights of {len(candidates)} candidates are too large to look up; see score")
    slots, weights = _weights(model, candidates)
    names = [w for _, _, w in slots]
    held = weights.where(" OR ".join(f"{w} IS NOT NULL" for w in names) or "false").select("token", *names)
    find = _finder(held, names)
    sums = F.arrow_udf(lambda lowered: find(lowered)[0], "array<bigint>")
    found = df.withColumn("_sums", sums(F.lower(F.coalesce(text, F.lit("")))))
    return found.selectExpr(*[f"`{c}`" for c in df.columns], *_logits(model, slots, [f"_sums[{i}]" for i in range(len(names))]))


def _finder(held: DataFrame, names: Sequence[str]) -> Callable[[pa.Array], tuple[pa.Array, pa.Array]]:
    """For lower-cased texts: the summed weights of the words in ``held``, and the other words, both as lists."""
    table = held.toArrow()
    tokens = pc.cast(table.column("token"), pa.large_string()).combine_chunks()
    values = np.zeros((len(names), len(tokens) + 1), np.int64)  # the last place is that of unknown words
    for row, name in zip(values, names, strict=True):
        row[:-1] = pc.fill_null(table.column(name), 0).to_numpy()
    shared = held.sparkSession.sparkContext.broadcast((tokens, values))

    def find(lowered: pa.Array) -> tuple[pa.Array, pa.Array]:
        known, weight = shared.value
        split = pc.split_pattern(pc.cast(lowered, pa.large_string()), " ")
        sizes = pc.list_value_length(split).to_numpy()
        if not len(sizes):
            return pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.string()))
        pieces = pc.list_flatten(split)
        at = pc.fill_null(pc.index_in(pieces, value_set=known), len(known)).to_numpy()
        starts = np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64)  # a text has one piece at least
        found = np.stack([np.add.reduceat(w[at], starts) for w in weight]) if len(weight) else np.zeros((0, len(sizes)), np.int64)
        ends = np.arange(0, found.size + 1, max(1, len(names)), dtype=np.int32)
        sums = pa.ListArray.from_arrays(pa.array(ends[: len(sizes) + 1]), pa.array(found.T.ravel()))
        other = (at == len(known)) & (pc.binary_length(pieces).to_numpy() > 0)
        cuts = np.append(0, np.cumsum(np.add.reduceat(other.astype(np.int64), starts))).astype(np.int32)
        return sums, pa.ListArray.from_arrays(pa.array(cuts), pc.cast(pieces.filter(pa.array(other)), pa.string()))

    return find


def with_joined_logits(
    df: DataFrame, model: CountModel, candidates: Sequence[Candidate], *, text: str = "text", held_bytes: int = LOOKUP_BYTES
) -> DataFrame:
    """``with_logits`` for weights of any size: the same columns and the same logits, bit for bit.

    Tasks hold the most frequent words that fit ``held_bytes``. The words of a text that are not among them are joined. Logits depend on the text alone, so in a table equal texts are scored once, by
    their digest, and meet their rows in one join. In a stream, whose rows cannot be aggregated without a
    watermark, rows and the weights of their words meet in blocks of ``BLOCK_ROWS`` rows. No key is needed.
    """
    if any(model.limits[m.fit] is not None for m in candidates):
        raise ValueError("a limit on the words read needs a key; see score")
    slots, weights = _weights(model, candidates)
    names = [w for _, _, w in slots]
    head = (F.col("n_total") >= F.lit(_least_held(model, candidates, held_bytes))) & (F.octet_length("token") <= SHORT_BYTES)
    known = F.expr(" OR ".join(f"{w} IS NOT NULL" for w in names) or "false")
    tail = weights.where(~head & known).select("token", *names)
    find = _finder(weights.where(head).select("token", *names), names)

    def look_up(lowered: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(find(lowered), names=["sums", "words"])

    held = F.arrow_udf(look_up, "sums array<bigint>, words array<string>")(F.lower(F.coalesce(text, F.lit("")))).alias("_held")
    logits = _logits(model, slots, names)
    if df.isStreaming:
        return _met_in_blocks(df, held, tail, names).selectExpr(*[f"`{c}`" for c in df.columns], *logits)
    digest = F.md5(F.coalesce(text, F.lit(""))).alias("_digest")
    once = df.select(digest, held).dropDuplicates(["_digest"])
    total = [F.sum(F.coalesce(w, F.lit(0)) + F.coalesce(F.col("_sums")[i], F.lit(0))).alias(w) for i, w in enumerate(names)]
    scored = _with_rare_words(once, "_digest", [], tail).groupBy("_digest").agg(*total).selectExpr("_digest", *logits)
    joined = df.withColumn("_digest", digest).join(scored, "_digest")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[f"logits_{c.name}" for c in candidates])


def _least_held(model: CountModel, candidates: Sequence[Candidate], held_bytes: int) -> int:
    """The least power of two such that all words which occur so often fit ``held_bytes``."""
    powers = [1 << k for k in range(63)]
    size = f"least(octet_length(token), {SHORT_BYTES}) + {_row_bytes(candidates, model.labels)}"
    sizes = model.counts.selectExpr(*[f"coalesce(sum({size}) FILTER (WHERE n_total >= {p}), 0)" for p in powers]).first()
    return next((p for p, held in zip(powers, sizes, strict=True) if held <= held_bytes), powers[-1])


def _with_rare_words(found: DataFrame, key: str, carry: Sequence[str], tail: DataFrame) -> DataFrame:
    """One row per word of ``_held`` with its weights, and one without a word that has ``_sums`` and ``carry``.

    The row without a word is joined by its key behind a newline, which equals no word and spreads evenly.
    """
    first = F.struct(F.concat(F.lit("\n"), F.col(key).cast("string")).alias("token"), F.col("_held.sums").alias("_sums"), *carry)
    empty = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in carry]
    others = F.transform(F.col("_held.words"), lambda w: F.struct(w.alias("token"), F.lit(None).cast("array<bigint>").alias("_sums"), *empty))
    rows = found.select(key, F.inline(F.concat(F.array(first), others)))
    return rows.join(tail, "token", "left").drop("token")


def _met_in_blocks(df: DataFrame, held: Column, tail: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of a stream with the summed weights ``names``; rows are numbered per task, as they come."""

    def number(tasks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n = 0
        for task in tasks:
            yield pa.array((task.to_numpy().astype(np.int64) << 33) + np.arange(n, n + len(task)))
            n += len(task)

    def meet(block: pa.Table) -> pa.Table:
        rows = block.filter(pc.is_valid(block.column("_row")))
        own, place = np.unique(rows.column("_key").to_numpy(), return_inverse=True)
        at = np.searchsorted(own, block.column("_key").to_numpy())
        flat = rows.column("_sums").combine_chunks().flatten().to_numpy().reshape(len(own), len(names))
        out = pa.Table.from_arrays(rows.column("_row").combine_chunks().flatten(), names=columns)
        for i, name in enumerate(names):
            total = np.zeros(len(own), np.int64)
            np.add.at(total, at, pc.fill_null(block.column(name), 0).to_numpy())
            out = out.append_column(name, pa.array(total[place] + flat[:, i]))
        return out

    columns = df.columns
    numbered = F.arrow_udf(number, "bigint").asNondeterministic()(F.spark_partition_id()).alias("_key")
    found = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), held, numbered)
    rows = _with_rare_words(found, "_key", ["_row"], tail).withColumn("_block", F.expr(f"_key div {BLOCK_ROWS}"))
    schema = StructType([*df.schema.fields, *[StructField(name, LongType()) for name in names]])
    return rows.groupBy("_block").applyInArrow(meet, schema)


def _join_head_and_tail(tokens: DataFrame, weights: DataFrame, least: int) -> DataFrame:
    """Join against a vocabulary too large to broadcast.

    Frequent tokens, those that occur ``least`` times, carry most occurrences and would be hot
    join keys. Their number is bounded, so they are broadcast and never shuffled; the others are
    spread over many rare keys. The first branch keeps every row.
    """
    # Words hold no newline, so a digest behind one never equals a word.
    short = F.expr(f"if(octet_length(token) <= {SHORT_BYTES}, token, concat('\n', md5(token)))")
    tokens = tokens.withColumn("token", short)
    weights = weights.withColumn("token", short)
    frequent = F.col("n_total") >= F.lit(least)
    head = weights.filter(frequent).drop("n_total")
    tail = weights.filter(~frequent).drop("n_total")
    near = tokens.join(F.broadcast(head), "token", "left")
    rare = tokens.filter(F.col("token") != DOCUMENT).join(F.broadcast(head.select("token")), "token", "left_anti")
    return near.unionByName(rare.join(tail.hint("merge"), "token"))


def predictions(scored: DataFrame, candidates: Sequence[Candidate], columns: Sequence[str]) -> DataFrame:
    """Long form: ``columns, model, logits, y_pred``. Narrow."""
    entries = ", ".join(f"named_struct('model', '{m.name}', 'logits', logits_{m.name})" for m in candidates)
    long = scored.selectExpr(*[f"`{c}`" for c in columns], f"inline(array({entries}))")
    return long.withColumn("y_pred", argmax(F.col("logits")))


def one_fit(model: CountModel, fit: str, name: str) -> CountModel:
    """The model of one fit under a name of its own: the words it has seen, and the document counts."""
    columns = [f"{_column(fit, c)} AS {_column(name, c)}" for c in model.labels]
    kept = model.counts.where(f"{_seen(fit, model.labels)} OR token = '{DOCUMENT}'").selectExpr("token", *columns, "n_total")
    return _with_totals(kept, {name: model.limits[fit]}, model.labels)


def save(model: CountModel, path: str, mode: str = "errorifexists") -> None:
    """Write the counts and the list of fits as two Parquet tables below ``path``."""
    spark = model.counts.sparkSession
    model.counts.write.mode(mode).parquet(f"{path}/counts")
    fits = [(name, limit, list(model.labels)) for name, limit in model.limits.items()]
    schema = "fit string, max_tokens int, labels array<int>"
    spark.createDataFrame(fits, schema).coalesce(1).write.mode(mode).parquet(f"{path}/fits")


def load(spark: SparkSession, path: str) -> CountModel:
    fits = spark.read.parquet(f"{path}/fits").collect()
    limits = {r["fit"]: r["max_tokens"] for r in fits}
    return _with_totals(spark.read.parquet(f"{path}/counts"), limits, fits[0]["labels"])
