"""Language-model scores from a probabilistic suffix tree over words.

A state of the tree is a context of up to ``depth`` words. It is kept if its parent (the same
context without its oldest word) is kept, it occurs often enough, and its next-word
distribution diverges from the parent's: the log-likelihood gained over the parent, with
every occurrence left out of its own count, must reach a threshold. Distributions are
smoothed by absolute discounting; what is discounted, and words seen too rarely after the
context, follow the parent. A word is scored in the state of the longest suffix kept.

The logarithm of a word's probability is a sum: the base term of the word, and for each kept
suffix its discount and, if the word is known there, a correction. Scoring is therefore a
join of the n-grams of the texts with one table of terms. The most frequent terms, a fixed
number, are held by every task; a filter of fixed size tells which others may exist, and
only those n-grams are shuffled: as lists per range of hashes, to the terms of that range.

N-grams to be counted are shuffled as words: a frequent word is its rank, one to three bytes, any
other one its hash. Both ends hold the frequent words, a fixed number. Contexts and their parents
follow from the words and are not sent.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.llm import hashing, rows
from tonelab.llm.hashing import mixed as _mixed
from tonelab.llm.linking import runs
from tonelab.sources import scratch

DEPTH = 3
#: Occurrences of a context; occurrences of a word after it; discount; nats gained.
MIN_CONTEXT, MIN_PAIR, DISCOUNT, GAIN = 50, 4, 0.75, 5.0
#: Terms held by every task, bits of the filters, bytes of text and n-grams taken at once.
HEAD, BITS, BYTES, HELD = 1 << 20, 1 << 27, 1 << 19, 1 << 19
#: Terms or n-grams of a range of hashes, which is worked on at once, and ranges at least.
RANGE, RANGES = 1 << 19, 32
#: Contexts with more occurrences are counted in PARTS parts by their next word.
BUSY, PARTS = 1 << 16, 64
#: Words that have a rank and slots to look them up; first bytes up to which a rank is one byte, or two; that of a whole number.
RANKED, SLOTS, _ONE, _TWO, _WHOLE = 1 << 18, 1 << 21, 192, 248, 255
_CONTEXT, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Stands for the end of a text.
END = np.uint64(0xEF46DB3751D8E999)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(context * _PAIR + word)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((_mixed(keys) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


class Grams:
    """Hashed words of some texts, each with an end sign, and their contexts."""

    def __init__(self, texts: list[bytes | None]):
        words, size = hashing.words(texts)
        size = size + 1
        last = np.cumsum(size) - 1
        self.word = np.full(len(words) + len(texts), END)
        inner = np.ones(len(self.word), bool)
        inner[last] = False
        self.word[inner] = words
        self.text = np.repeat(np.arange(len(texts)), size)
        self.place = np.arange(len(self.word)) - np.repeat(last + 1 - size, size)

    def back(self, k: int) -> np.ndarray:
        """The word k places before; undefined where ``place`` < k."""
        return np.roll(self.word, k)

    def context(self, k: int) -> np.ndarray:
        """Hash of the k words before each place, from the nearest one on."""
        out = np.zeros(len(self.word), np.uint64)
        for i in range(1, k + 1):
            out = _mixed(out * _CONTEXT + self.back(i))
        return out


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("binary").alias("t"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of about BYTES bytes together; a longer text alone."""
    for b in batches:
        size = np.fromiter((len(t or b"") + 1 for t in b["t"]), np.int64, len(b))
        block = (np.cumsum(size) - size) // BYTES
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        for at, to in zip(cuts, np.append(cuts[1:], len(b)), strict=True):
            yield b.iloc[at:to]


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``h, n``: occurrences of each word hash and of the end sign."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in _chunks(batches):
            held.append(Grams(list(b["t"])).word)
            size += len(held[-1])
            if size > HELD:
                yield _counted(held)
                held, size = [], 0
        if held:
            yield _counted(held)

    return rows.map_frames(_texts(docs, text), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray]) -> pd.DataFrame:
    h, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"h": h.view(np.int64), "n": n})


class Code:
    """N-grams of word hashes and their counts as bytes, by the rank of the frequent words.

    A number is a first byte and the bytes that follow from it: none, one or two of a rank, or all eight of a
    hash or a large count. First bytes and following bytes are kept apart, so both are read at once.
    """

    def __init__(self, words: np.ndarray):
        """``words``: hashes, the most frequent one first; of words that meet in a slot only that one has a rank."""
        self.words = words if len(words) else np.zeros(1, np.uint64)
        self.slots = np.zeros(SLOTS, np.int32)
        self.slots[self.words[::-1] & np.uint64(SLOTS - 1)] = np.arange(len(self.words), dtype=np.int32)[::-1]
        self.more = np.repeat(np.uint8([0, 1, 2, 8]), [_ONE, _TWO - _ONE, _WHOLE - _TWO, 1])
        self.least = np.cumsum(np.append(0, (1 << 8 * self.more.astype(np.int64))[:-2]), dtype=np.int32)  # rank of a first byte
        self.least = np.append(self.least, 0).astype(np.int32)
        rank = np.arange(len(self.words), dtype=np.int32)
        first = np.searchsorted(self.least[:-1], rank, "right") - 1
        self.first, self.rest = np.append(first, _WHOLE).astype(np.uint8), np.append(rank - self.least[first], 0).astype(np.uint16)

    def rank(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 without one."""
        rank = self.slots[words & np.uint64(SLOTS - 1)]
        return np.where(self.words[rank] == words, rank, np.int32(-1))

    def _laid(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of following bytes, and where they start."""
        size = self.more[first]
        size[:, -1] = (first[:, -1] == _WHOLE) * np.uint8(8)
        size = size.ravel()
        return size, np.cumsum(size, dtype=np.int64) - size

    def write(self, ranks: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes, following bytes and their number up to each n-gram; ``ranks`` and ``words`` by n-gram and place."""
        first, rest = np.empty((len(n), ranks.shape[1] + 1), np.uint8), np.zeros((len(n), ranks.shape[1] + 1), np.uint16)
        first[:, :-1], first[:, -1], rest[:, :-1] = self.first[ranks], np.minimum(n, _WHOLE), self.rest[ranks]
        size, at = self._laid(first)
        to = np.append(at.reshape(first.shape)[:, 0], at[-1] + size[-1] if len(at) else 0)
        more, rest = np.zeros(to[-1], np.uint8), rest.ravel()
        one, two, whole = (np.flatnonzero(size == x) for x in (1, 2, 8))
        more[at[one]] = rest[one]
        more[at[two]], more[at[two] + 1] = rest[two] >> 8, rest[two] & 255
        row, place = np.divmod(whole, first.shape[1])
        last = place == ranks.shape[1]
        value = words[row, np.where(last, 0, place)]
        value[last] = n[row[last]]
        more[at[whole][:, None] + np.arange(8)] = value.view(np.uint8).reshape(-1, 8)
        return first, more, to

    def read(self, k: int, first: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Words by place, and counts."""
        first, more = np.frombuffer(first, np.uint8).reshape(-1, k + 2), np.frombuffer(more, np.uint8)
        size, at = self._laid(first)
        one, two, whole = (np.flatnonzero(size == x) for x in (1, 2, 8))
        rank = self.least[first]
        rank[:, -1] = 0
        flat = rank.ravel()
        flat[one] += more[at[one]]
        flat[two] += (more[at[two]].astype(np.int32) << 8) + more[at[two] + 1]
        out = self.words[rank]
        out[:, -1] = first[:, -1]
        out.ravel()[whole] = more[at[whole][:, None] + np.arange(8)].reshape(-1).view(np.uint64)
        return np.ascontiguousarray(out[:, :-1].T), out[:, -1].astype(np.int64)


def followers(docs: DataFrame, text: str, depths: list[int], often, busy, code, least: int, ranges: int) -> DataFrame:
    """``k, s, p, x, n``: words ``x`` that follow context ``s`` (parent ``p``) at least ``least`` times;
    with ``x`` null: all occurrences of the context, in parts.

    ``often`` and ``busy`` are filters of words (depth 1) or of word pairs (above): a context
    can be frequent only if its words, or all its pairs of neighbours, are. A task sums up
    what it reads and sends lists per range of hashes of contexts, and of parts of busy contexts.
    """

    def key(g: Grams, k: int, at: np.ndarray) -> np.ndarray:
        if k == 1:
            return g.back(1)[at]
        return pair_key(_mixed(g.back(2)[at]), g.back(1)[at])

    def candidates(g: Grams, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(g.place >= k)
        at = at[rows.in_filter(often.value, key(g, k, at))]
        for i in range(1, k - 1):  # pairs further back
            older = pair_key(_mixed(g.back(2 + i)[at]), g.back(1 + i)[at])
            at = at[rows.in_filter(often.value, older)]
        return at, rows.in_filter(busy.value, key(g, k, at))

    def lists(k: int, parts: list[tuple], words: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        s, at, b = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        _, first, n = np.unique(pair_key(s, words[at]), return_index=True, return_counts=True)
        s, at, b = s[first], at[first], b[first]
        part = np.where(b, words[at] % np.uint64(PARTS), np.uint64(PARTS))
        where = _range_of(pair_key(s, part), ranges)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(ranges + 1))
        places = at[order][:, None] - np.arange(k, -1, -1)
        lead, more, to = code.value.write(rank[places], words[places], n[order])
        some = np.flatnonzero(np.diff(cuts))
        bounds = np.append(cuts[some], len(order))
        values = [
            pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))])
            for at, v in ((bounds * (k + 2), lead), (to[bounds], more))
        ]
        keys = [pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*keys, *values], names=["k", "range", "first", "more"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            words = np.concatenate(read)
            rank = code.value.rank(words)
            yield from (lists(k, held[k], words, rank) for k in depths if sum(len(h[0]) for h in held[k]))

        read, held, size, before = [], {k: [] for k in depths}, 0, 0
        for b in _chunks(x.to_pandas() for x in batches):
            g = Grams(list(b["t"]))
            for k in depths:
                at, split = candidates(g, k)
                held[k].append((g.context(k)[at], at + before, split))
                size += len(at)
            read.append(g.word)
            before += len(g.word)
            if size > HELD or before > 4 * HELD:
                yield from sent()
                read, held, size, before = [], {k: [] for k in depths}, 0, 0
        if read:
            yield from sent()
        del read, held
        pa.default_memory_pool().release_unused()

    def one(k: int, c: dict, some: slice) -> pd.DataFrame:
        words, n = code.value.read(k, b"".join(c["first"][some]), b"".join(c["more"][some]))
        p, x = np.zeros(len(n), np.uint64), words[-1].view(np.int64)
        for w in words[-2:0:-1]:
            p = _mixed(p * _CONTEXT + w)
        s, p = _mixed(p * _CONTEXT + words[0]).view(np.int64), p.view(np.int64)
        order = np.lexsort((x, s))
        s, p, x, n = s[order], p[order], x[order], n[order]
        new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (s[1:] != s[:-1])))
        s, p, x, n = s[new], p[new], x[new], np.add.reduceat(n, new)
        heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        total, keep = np.add.reduceat(n, heads), n >= least
        null = np.arange(keep.sum() + len(heads)) >= keep.sum()
        return pd.DataFrame({
            "k": np.int32(k), "s": np.append(s[keep], s[heads]), "p": np.append(p[keep], p[heads]), "n": np.append(n[keep], total),
            "x": pd.arrays.IntegerArray(np.append(x[keep], total), null),
        })

    def use(c: dict, starts: np.ndarray, ends: np.ndarray) -> Iterator[pd.DataFrame]:
        return (one(c["k"][a], c, slice(a, z)) for a, z in zip(starts, ends, strict=True))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frames in runs(({c: b[c].to_numpy() for c in b.columns} for b in batches), ["k", "range"], use):
            yield from frames
        pa.default_memory_pool().release_unused()

    sent = _texts(docs, text).mapInArrow(gather, "k int, range int, first binary, more binary")
    # Small tasks: one range or a few, also where ranges outnumber the session's partitions.
    tasks = min(ranges, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = sent.repartition(tasks, "k", "range").sortWithinPartitions("k", "range")
    return rows.map_frames(dealt, add_up, "k int, s bigint, p bigint, n bigint, x bigint")


def states(found: DataFrame, parents: DataFrame, min_context: int, gain: float) -> DataFrame:
    """Pairs of the kept contexts: ``s, x, n, total, rest, prob, log_ratio``.

    ``found``: followers of one depth; ``parents(p, x, below)``: probability of the word in the
    parent state. ``rest`` is the weight the state gives to its parent. A pair without a
    parent probability belongs to a parent that was not kept, and goes.
    """
    totals = found.where("x IS NULL").groupBy("s").agg(F.sum("n").alias("total")).where(F.col("total") >= min_context)
    pairs = rows.written(found.where("x IS NOT NULL").join(parents, ["p", "x"]), "pairs")
    summed = pairs.groupBy("s").agg(F.sum(F.col("n") - DISCOUNT).alias("own"), F.count(F.lit(1)).alias("types"))
    weights = rows.written(
        totals.join(summed, "s").select("s", "total", (1 - F.col("own") / F.col("total")).alias("rest")), "weights"
    )
    model = pairs.join(weights, "s")
    # Left out of its own count, a word may fall under the least count and follow the parent.
    less = F.greatest(F.col("n") - 1 - DISCOUNT, F.lit(0.0)) / (F.col("total") - 1)
    seen = F.col("n") > MIN_PAIR
    won = F.sum(F.when(seen, F.col("n") * F.log(less / F.col("below") + F.col("rest"))).otherwise(0.0))
    other = F.first("total") - F.sum(F.when(seen, F.col("n")).otherwise(0))
    judged = model.groupBy("s").agg((won + other * F.log(F.first("rest"))).alias("gained"))
    kept = rows.written(judged.where(F.col("gained") >= gain).select("s"), "kept")
    prob = (F.col("n") - DISCOUNT) / F.col("total") + F.col("rest") * F.col("below")
    out = model.join(kept, "s").select("s", "x", "n", "total", "rest", prob.alias("prob"), "below")
    return out.withColumn("log_ratio", F.log10(F.col("prob") / (F.col("rest") * F.col("below"))))


def _keyed(pairs: DataFrame, kind: str) -> DataFrame:
    """Terms of the pairs of kept states, and of the states."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = pair_key(b["s"].to_numpy().view(np.uint64), b["x"].to_numpy().view(np.uint64))
            yield b[["n", "log_ratio"]].assign(key=key.view(np.int64)).rename(columns={"log_ratio": "value"})

    def run_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = _mixed(b["s"].to_numpy().view(np.uint64) ^ _CONTEXT)
            yield pd.DataFrame({"n": b["total"], "value": b["value"], "key": key.view(np.int64)})

    if kind == "pairs":
        return rows.map_frames(pairs.select("s", "x", "n", "log_ratio"), run, "key bigint, n bigint, value double")
    contexts = pairs.groupBy("s").agg(F.first("total").alias("total"), F.first("rest").alias("rest"))
    return rows.map_frames(contexts.select("s", "total", F.log10("rest").alias("value")), run_states, "key bigint, n bigint, value double")


class Table:
    """Numbers by 64-bit key: a sparse table of places in dense arrays, with open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask, self.keys, self.values = np.uint64(size - 1), keys, values
        self.place = np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), _mixed(keys) & self.mask
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]  # of several for one slot, the last stays
            open_ = self.place[slot] != left
            left, slot = left[open_], (slot[open_] + np.uint64(1)) & self.mask

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 if there is none), and whether there is one."""
        value, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        at, slot = np.arange(len(keys)), _mixed(keys) & self.mask
        while len(at):
            place = self.place[slot]
            used = place >= 0
            at, slot, place = at[used], slot[used], place[used]
            hit = self.keys[place] == keys[at]
            value[at[hit]], found[at[hit]] = self.values[place[hit]], True
            at, slot = at[~hit], (slot[~hit] + np.uint64(1)) & self.mask
        return value, found


#: Sums of ``texts`` texts of a batch, side by side as bytes; a batch is named by its first row. ``ids``, rows of all its
#: texts, and ``n_tokens`` come once a batch; ``whose`` are the places of the texts in it, of all if null. A null sum is 0.
_SUMS = {"batch": "bigint", "texts": "int", "ids": "binary", "n_tokens": "binary", "whose": "binary", "n_known": "binary", "base": "binary", "more": "binary"}
#: N-grams still to be looked up, by range of hashes: ``sizes`` keys of each of ``whose`` texts.
_OPEN = {"range": "int", "sizes": "binary", "keys": "binary"}


def _laid_out(numbers: np.ndarray) -> bytes | None:
    """Numbers from 0 on, in as few bytes each as the largest needs, or doubles; null if all are 0."""
    if not numbers.any():
        return None
    return (numbers if numbers.dtype == np.float64 else numbers.astype(np.min_scalar_type(numbers.max()))).tobytes()


def _numbers(data: bytes | None, n: int) -> np.ndarray:
    """The whole numbers that ``_laid_out`` wrote."""
    return np.zeros(n, np.int64) if data is None else np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


def _doubles(data: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n) if data is None else np.frombuffer(data)


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in columns.items())


def _first_sums(texts: DataFrame, depth: int, heavy, light, unknown: float, ranges: int) -> DataFrame:
    """Sums over the terms that tasks hold (in any range, ``keys`` null), and the n-grams that may have others."""

    def chunk(b: pd.DataFrame) -> Iterator[dict]:
        g, n_texts, ids = Grams(list(b["t"])), len(b), b[rows.ROW].to_numpy(np.int64)
        later_key, later_text = [], []

        def value(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own, hit = heavy.value.look_up(keys)
            maybe = ~hit & rows.in_filter(light.value, keys)
            maybe[maybe] = rows.in_filter(light.value, keys[maybe] >> np.uint64(32))
            later_key.append(keys[maybe])
            later_text.append(g.text[at[maybe]])
            return np.bincount(g.text[at], own, n_texts), hit, maybe

        base, hit, _ = value(np.arange(len(g.word)), g.word)
        n_known, n_tokens = np.bincount(g.text[hit], minlength=n_texts), np.bincount(g.text, minlength=n_texts)
        more, at = np.zeros(n_texts), np.arange(len(g.word))
        for k in range(1, depth + 1):
            at = at[g.place[at] >= k]
            context = g.context(k)[at]
            sums, hit, maybe = value(at, _mixed(context ^ _CONTEXT))
            at, context = at[hit | maybe], context[hit | maybe]
            more += sums + value(at, pair_key(context, g.word[at]))[0]
        base += n_tokens * unknown
        sums = {c: _laid_out(x) for c, x in {"n_tokens": n_tokens, "n_known": n_known, "base": base, "more": more}.items()}
        yield {"range": ids[0] % ranges, "batch": ids[0], "texts": n_texts, "ids": ids.tobytes(), **sums}
        keys, whose = np.concatenate(later_key), np.concatenate(later_text)
        part = _range_of(keys, ranges)
        order = np.lexsort((whose, part))
        keys, whose, part = keys[order].view(np.int64), whose[order], part[order]
        bounds = np.searchsorted(part, np.arange(ranges + 1))
        for r in np.unique(part):
            some = slice(bounds[r], bounds[r + 1])
            owner, sizes = np.unique(whose[some], return_counts=True)
            yield {"range": r, "batch": ids[0], "texts": len(owner), "whose": _laid_out(owner), "sizes": _laid_out(sizes), "keys": keys[some].tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _chunks(batches):
            yield pd.DataFrame([[row.get(c) for c in (*_OPEN, *_SUMS)] for row in chunk(b)], columns=[*_OPEN, *_SUMS], dtype=object)
        pa.default_memory_pool().release_unused()

    return rows.map_frames(texts, run, _ddl(_OPEN | _SUMS))


def _packed(tail: DataFrame, ranges: int) -> DataFrame:
    """``range, term_key, term_value, term_word``: terms in lists by range, as bytes."""
    types = {"key": np.int64, "value": np.float64, "word": np.uint8}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(range=_range_of(b["key"].to_numpy(np.int64).view(np.uint64), ranges)).sort_values("range")
            cuts = np.flatnonzero(np.diff(b["range"], prepend=-1))
            parts = {c: [p.tobytes() for p in np.split(b[c].to_numpy(t), cuts[1:])] if len(b) else [] for c, t in types.items()}
            yield pd.DataFrame({"range": b["range"].to_numpy()[cuts], **{f"term_{c}": p for c, p in parts.items()}})

    schema = "range int, term_key binary, term_value binary, term_word binary"
    return rows.map_frames(tail.select("key", "value", "word"), run, schema)


def _resolved(first: DataFrame, packed: DataFrame) -> DataFrame:
    """All sums: those that were held, and those over other terms. Terms of a range come first, then its n-grams, batch by batch."""
    terms = packed.withColumns({"turn": F.lit(0), "batch": F.lit(0).cast("bigint"), "texts": F.lit(0)})
    asked = terms.unionByName(first.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    dealt = asked.repartition("range").sortWithinPartitions("range", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, terms, table = None, [], None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row.range != now:
                    now, terms, table = row.range, [], None
                if row.term_key is not None:
                    terms.append((row.term_key, row.term_value, row.term_word))
                    continue
                if row.keys is None:
                    out.append([getattr(row, c) for c in _SUMS])
                    continue
                if table is None:
                    table, terms = _RangeTable(terms), []
                sums = table.sums(np.frombuffer(row.keys, np.int64), _numbers(row.sizes, row.texts))
                # A null ``whose`` names all texts; of places that are all 0 there is one, the first text's.
                out.append((row.batch, row.texts, None, None, row.whose or b"\0", *map(_laid_out, sums)))
            yield pd.DataFrame(out, columns=list(_SUMS), dtype=object)

    return rows.map_frames(dealt, run, _ddl(_SUMS))


class _RangeTable:
    """Terms of one range; a term of a word adds to the base and counts as known, others to the rest."""

    def __init__(self, terms: list[tuple]):
        keys, values, word = (b"".join(c) for c in zip(*terms, strict=True)) if terms else (b"", b"", b"")
        keys, values, word = np.frombuffer(keys, np.int64), np.frombuffer(values), np.frombuffer(word, np.uint8)
        order = np.argsort(keys)
        self.keys, self.values, self.word = keys[order], values[order], word[order].astype(bool)

    def sums(self, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known words, base and rest of texts that have so many of the keys each."""
        whose = np.repeat(np.arange(len(sizes)), sizes)
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        at, whose = at[hit], whose[hit]
        value, word = self.values[at], self.word[at]
        base = np.bincount(whose, value * word, len(sizes))
        return np.bincount(whose[word], minlength=len(sizes)), base, np.bincount(whose, value * ~word, len(sizes))


def _added(parts: DataFrame) -> DataFrame:
    """One row per text from the sums of its batch."""

    def use(c: dict, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        done = []
        for a, z in zip(starts, ends, strict=True):
            first = next(i for i in range(a, z) if c["ids"][i] is not None)
            n, sizes = c["texts"][first], c["texts"][a:z]
            at = np.concatenate([np.arange(n) if w is None else _numbers(w, k) for w, k in zip(c["whose"][a:z], sizes, strict=True)])
            read = {"n_known": _numbers, "base": _doubles, "more": _doubles}
            sums = {s: np.bincount(at, np.concatenate([*map(f, c[s][a:z], sizes)]), n) for s, f in read.items()}
            done.append(pd.DataFrame({rows.ROW: np.frombuffer(c["ids"][first], np.int64), "n_tokens": _numbers(c["n_tokens"][first], n), **sums}))
        return pd.concat(done).astype({"n_known": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return runs(({c: b[c].to_numpy() for c in b.columns} for b in batches), ["batch"], use)

    dealt = parts.repartition("batch").sortWithinPartitions("batch")
    return rows.map_frames(dealt, run, f"{rows.ROW} bigint, n_tokens bigint, n_known bigint, base double, more double")


def score(
    docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, min_context: int = MIN_CONTEXT,
    min_pair: int = MIN_PAIR, gain: float = GAIN, head: int = HEAD,
) -> DataFrame:
    """One row per row of ``docs``: ``key, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` holds the texts to learn from. Tokens are runs without ASCII white space, in lower
    case A-Z, and one end sign; ``n_known`` counts those that occur in ``train``. ``base_score`` is
    the log10 probability by word frequency with 0.5 added, one unknown word included, and
    the root of the tree; ``score`` is that of the tree. A null text is empty. Without training
    texts both are 0. Repeated rows and keys and null keys are rows of their own; other
    columns are ignored. Words are told apart by 64-bit hashes; empty and very long
    texts are like any other (a text is hashed in blocks and held by one task). ``head``: terms each task holds.
    """
    with rows.freed(docs.sparkSession):
        return _score(docs, train, key, text, depth, min_context, min_pair, gain, head)


def _most_frequent(table: DataFrame, number: int):
    """Condition on ``size``, a step of the logarithm of the count, that holds for at most so many rows: the most frequent ones."""
    least, kept = 1 << 30, 0
    for size, n in sorted(table.groupBy("size").count().collect(), reverse=True):  # a few hundred sizes
        kept += n
        if kept > number:
            break
        least = size
    return F.col("size") >= least


def _sized(counts: DataFrame) -> DataFrame:
    return counts.withColumn("size", F.floor(8 * F.log2("n")).cast("int"))


def _score(
    docs: DataFrame, train: DataFrame, key: str, text: str, depth: int, min_context: int, min_pair: int, gain: float, head: int,
) -> DataFrame:
    share = docs.sparkSession.sparkContext.broadcast

    def counted(depths: list[int], *used) -> DataFrame:
        return rows.written(followers(train, text, depths, *used, code, min_pair, grams), "followers")

    with scratch.scope(docs.sparkSession, "model") as folder:
        counts = rows.written(word_counts(train, text), "words")
        n, v = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        n, mass = n or 0, (n or 0) + 0.5 * (v + 1)
        unknown = float(np.log10(0.5 / mass))
        end = int(END.view(np.int64))
        base = counts.select(F.lit(0).cast("bigint").alias("p"), F.col("h").alias("x"), ((F.col("n") + 0.5) / mass).alias("below"))
        terms = [counts.select(F.col("h").alias("key"), "n", (F.log10((F.col("n") + 0.5) / mass) - unknown).alias("value"), F.lit(1).alias("word"))]
        contexts = counts.where(F.col("h") != end)
        filters = [share(rows.bit_filter(contexts.where(F.col("n") >= least), "h", BITS)) for least in (min_context, BUSY)]
        parents, grams = base, max(RANGES, math.ceil(n / RANGE))
        if depth:
            sized = _sized(counts)
            ranked = sized.where(_most_frequent(sized, RANKED)).select("h", "n").toArrow().to_pandas()  # at most RANKED rows
            code = share(Code(ranked.sort_values("n", ascending=False)["h"].to_numpy(np.int64).view(np.uint64)))
            found = counted([1], *filters)
        for done in filters:  # each would stay on the disk of every executor
            done.destroy()
        for k in range(1, depth + 1):
            if k == 2:
                pairs = _keyed(found.where("x IS NOT NULL").where(F.col("x") != end).withColumn("log_ratio", F.lit(0.0)), "pairs")
                filters = [share(rows.bit_filter(pairs.where(F.col("n") >= least), "key", BITS)) for least in (max(min_context, min_pair), BUSY)]
                found = counted([*range(2, depth + 1)], *filters)
                for done in filters:
                    done.destroy()
            level = rows.written(states(found.where(F.col("k") == k), parents, min_context, gain), "states")
            terms += [_keyed(level, kind).withColumn("word", F.lit(0)) for kind in ("pairs", "states")]
            parents = level.select(F.col("s").alias("p"), "x", F.col("prob").alias("below"))
        if depth:
            code.destroy()
    table = rows.written(_sized(functools.reduce(DataFrame.unionByName, terms)), "terms")
    scratch.remove(docs.sparkSession, folder)  # all that was kept to make the terms
    top = _most_frequent(table, head)
    held = table.where(top).select("key", "value").toArrow().to_pandas()  # at most ``head`` rows
    heavy = share(Table(held["key"].to_numpy().view(np.uint64), held["value"].to_numpy()))
    tail = table.where(~top)
    twice = tail.select(F.explode(F.array("key", F.shiftright("key", 32))).alias("key"))  # two bits a term
    light = share(rows.bit_filter(twice, "key", BITS))
    ranges = max(RANGES, math.ceil(tail.count() / RANGE))
    numbered = rows.numbered(docs.select(key, text), key)
    texts = numbered.select(rows.ROW, F.col(text).cast("binary").alias("t"))
    summed = _added(_resolved(_first_sums(texts, depth, heavy, light, unknown, ranges), _packed(tail, ranges)))
    return summed.join(numbered.select(rows.ROW, key), rows.ROW).select(
        key, "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("base") + F.col("more")).alias("score"),
    )
