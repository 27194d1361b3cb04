"""Benchmark decontamination by canonical templates.

Numbers, names and units are replaced by typed placeholders. Windows of template tokens of
the benchmark are joined with those of the documents by hash, and the slots of an aligned
match must map item to document consistently and cover the item, so a question asked again
with other numbers or names is found and a chance meeting of templates is not. Windows of
plain words are joined as well, so a copy is found whatever its templates are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.llm import hashing, rows
from tonelab.llm.lexicon import Lexicon

WINDOW = 10
#: Items with fewer tokens than a window are matched whole; with other values down to this length.
SHORTEST = 5
#: Distinct literal tokens that a window met with other values must have, as a share of its length.
LITERAL = 0.4
#: Windows of an item that a match with other values must have, as a share; LONG times a window's length is always enough.
COVER, LONG = 0.5, 2
#: Plain words, and templates with a title-case word that begins a sentence as a literal and as a name.
PLAIN, AS_LITERAL, AS_NAME = 0, 1, 2
#: Bits of the filter that tasks hold; a fixed size, however large the benchmark is.
FILTER_BITS = 1 << 23
#: Texts that are looked up at once.
TEXTS = 256
# Number words and units of measure.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
)
UNITS = (
    "mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers inch inches foot feet yard yards mile miles "
    "mg g kg gram grams kilogram kilograms ounce ounces pound pounds tonne tonnes ton tons ml l litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees celsius fahrenheit mph kph km/h m/s"
)
NOTHING, LITERAL_KIND, NUMBER, UNIT, NAME = -1, 0, 1, 2, 3
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(%|st|nd|rd|th)?|" + "|".join(NUMBER_WORDS.split()))
_UNITS = frozenset(UNITS.split())
_EDGES = "!\"#&'()*,-./:;<=>?@[\\]^_`{|}~“”‘’«»¿¡…"
_ENDS = tuple(".!?:")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def describe(word: bytes) -> tuple[int, bytes, bool]:
    """Class, bare word in lower case and whether it ends a sentence."""
    raw = word.decode("utf-8", "replace")
    bare = raw.strip(_EDGES)
    low = bare.lower()
    if not bare:
        kind = NOTHING
    elif _NUMBER.fullmatch(low):
        kind = NUMBER
    elif low in _UNITS:
        kind = UNIT
    else:
        kind = NAME if bare[0].isupper() and bare[1:].islower() else LITERAL_KIND
    return kind, low.encode(), raw.rstrip("\"')”’»").endswith(_ENDS)


def _hashes(kind: np.ndarray, low: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    return [hashing.words([b" ".join(w or b"-" for w in low)])[0]]


def words() -> Lexicon:
    return Lexicon(describe, [np.int64, object, bool], more=_hashes, more_types=[np.uint64])


def _among(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[c for c in chars.encode() if c < 128] if isinstance(chars, str) else list(chars)] = True
    return out


_BLANK, _BREAK, _EDGE, _QUOTE, _END = map(_among, (b" \t\n\v\f\r", b"\n\r", _EDGES, "\"')", "".join(_ENDS)))
_LOWER, _UPPER, _DIGIT = _among(bytes(range(97, 123))), _among(bytes(range(65, 91))), _among(b"0123456789$+")
#: Characters that are taken off an end of a word at most; longer edges are left to ``describe``.
_OFF = 4
_FIXED = np.array([hashing.words([w.encode()])[0][0] for w in (*NUMBER_WORDS.split(), *UNITS.split())])
_FIXED_KIND = np.repeat([NUMBER, UNIT], [len(NUMBER_WORDS.split()), len(UNITS.split())])[np.argsort(_FIXED, kind="stable")]
_FIXED = np.sort(_FIXED, kind="stable")


def described(texts: list[bytes | None], known: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, hash, whether it ends a sentence or line, and text of all words: what ``describe`` tells, for ASCII words without calling it.

    Left to it are words with other characters, with digits or signs in front, and a few more.
    """
    whole = b"\n".join([*(t or b"" for t in texts), b""])
    data = np.frombuffer(whole, np.uint8)
    turn = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
    start, stop = turn[::2], turn[1::2]
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    text = np.searchsorted(ends, start, "right")
    breaks = np.searchsorted(np.flatnonzero(_BREAK[data]), np.append(start, len(data)))
    end = np.diff(breaks) > 0
    hard = np.zeros(len(start), bool)
    hard[np.searchsorted(start, np.flatnonzero(data >= 128), "right") - 1] = True

    def cut(first: np.ndarray, last: np.ndarray, chars: np.ndarray, step: int) -> np.ndarray:
        """Takes characters off one end; words with too many of them are hard."""
        ours = (first if step > 0 else last).copy()
        at = np.flatnonzero(last > first)
        for _ in range(_OFF + 1):
            at = at[chars[data[ours[at] - (step < 0)]]]
            ours[at] += step
            at = at[ours[at] != (last if step > 0 else first)[at]]
        hard[at] = True
        return ours

    before = cut(start, stop, _QUOTE, -1)
    end |= (before > start) & _END[data[before - 1]]
    first = cut(start, stop, _EDGE, 1)
    last = cut(first, stop, _EDGE, -1)
    bare = last > first
    head = data[first * bare]
    second = data[np.where(last - first > 1, first + 1, 0)]
    named = bare & _UPPER[head] & (last - first > 1)
    hard |= bare & _DIGIT[head] | named & ~(_LOWER | _UPPER)[second]
    named &= _LOWER[second]
    capitals, at = np.flatnonzero(_UPPER[data]), np.flatnonzero(named)
    named[at] = np.searchsorted(capitals, last[at]) - np.searchsorted(capitals, first[at]) == 1
    value = np.zeros(len(start), np.uint64)
    easy = np.flatnonzero(bare & ~hard)
    value[easy] = hashing.spans(data, first[easy], last[easy])
    place = np.minimum(np.searchsorted(_FIXED, value), len(_FIXED) - 1)
    kind = np.where(named, NAME, LITERAL_KIND)
    kind = np.where(bare, np.where(_FIXED[place] == value, _FIXED_KIND[place], kind), NOTHING)
    hard = np.flatnonzero(hard)
    if len(hard):
        kind[hard], _, ended, value[hard] = known.look_up([whole[a:z] for a, z in zip(start[hard].tolist(), stop[hard].tolist(), strict=True)])
        end[hard] = ended | (np.diff(breaks)[hard] > 0)
    return kind, value, end, text


class Reading:
    """Tokens of a list of texts: hashes (a placeholder's for slots), kinds, value hashes and text numbers.

    Names that follow each other are one, but not across the begin of a sentence. Words of
    punctuation alone are left out.
    """

    def __init__(self, reading: int, kind: np.ndarray, value: np.ndarray, begins: np.ndarray, text: np.ndarray, texts: int):
        self.reading = reading
        if reading == AS_LITERAL:
            kind = np.where((kind == NAME) & begins, LITERAL_KIND, kind)
        if reading != PLAIN and len(kind):
            first = np.ones(len(kind), bool)
            first[1:] = (kind[1:] != NAME) | (kind[:-1] != NAME) | begins[1:]
            starts = np.flatnonzero(first)
            place = np.arange(len(kind)) - np.repeat(starts, np.diff(np.append(starts, len(kind))))
            value = np.where(kind == NAME, value * (2 * place.astype(np.uint64) + np.uint64(1)), value)  # John Smith is not Smith John
            value, kind, text = np.add.reduceat(value, starts), kind[starts], text[starts]
        self.token = value if reading == PLAIN else np.where(kind == LITERAL_KIND, value, kind.astype(np.uint64))
        self.kind, self.value, self.text = kind, value, text
        self.length = np.bincount(text, minlength=texts)
        self.first = np.cumsum(self.length) - self.length

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which a window of one text starts, and its hash."""
        n = max(len(self.token) - size + 1, 0)
        out = np.full(n, np.uint64(size + (0 if self.reading == PLAIN else 1 << 32)))
        for i in range(size):
            out = out * _BASE + self.token[i : i + n]
            out ^= out >> np.uint64(29)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 : size - 1 + n])
        return at, out[at]


def readings(texts: list[bytes | None], known: Lexicon) -> Iterator[Reading]:
    """The plain words, and the two templates; one if no title-case word begins a sentence or line."""
    kind, value, end, text = described(texts, known)
    real = np.flatnonzero(kind != NOTHING)
    ended = np.append(0, np.cumsum(end))[real]  # a word begins if anything since the last one ended a sentence
    begins = np.diff(ended, prepend=-1) > 0
    kind, value, text = kind[real], value[real], text[real]
    for reading in (PLAIN, AS_LITERAL, AS_NAME):
        if reading != AS_NAME or (begins & (kind == NAME)).any():
            yield Reading(reading, kind, value, begins, text, len(texts))


def _hits(texts: DataFrame, sizes: list[tuple[bool, int]] | None, test, longest: int) -> DataFrame:
    """``id, h, reading, pos, size, slots, whole`` of windows that pass ``test``.

    ``slots``: kind and value in order; ``whole``: windows of the text. A plain window is there
    once a text. ``sizes``: whether of plain words, and length; None: each text's own.
    """

    def one(r: Reading, size: int, ids: np.ndarray) -> Iterator[tuple]:
        at, h = r.windows(size)
        fit = test(h)
        if sizes is None:
            fit &= np.minimum(r.length, longest)[r.text[at]] == size
        at, h = at[fit], h[fit]
        if r.reading == PLAIN:
            keep = ~pd.DataFrame({"t": r.text[at], "h": h}).duplicated().to_numpy()
            at, h = at[keep], h[keep]
        for p, own in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
            t = r.text[p]
            whole = r.length[t] - size + 1
            if r.reading == PLAIN:
                yield ids[t], own, PLAIN, p - r.first[t], size, [], whole
                continue
            literal = r.kind[p : p + size] == LITERAL_KIND
            if len(set(r.token[p : p + size][literal].tolist())) >= LITERAL * size:
                slots = np.flatnonzero(~literal) + p
                yield ids[t], own, r.reading, p - r.first[t], size, [f"{r.kind[s]}:{r.value[s]:x}" for s in slots], whole

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words()
        for b in batches:
            out = []
            for a in range(0, len(b), TEXTS):
                part = b.iloc[a : a + TEXTS]
                ids = part["id"].astype(object).to_numpy()
                for r in readings(list(part["t"]), known):
                    plain = r.reading == PLAIN
                    for size in range(1 if plain else SHORTEST, longest + 1):
                        if sizes is None or (plain, size) in sizes:
                            out += one(r, size, ids)
            yield pd.DataFrame(out, columns=["id", "h", "reading", "pos", "size", "slots", "whole"])

    kind = dict(texts.dtypes)["id"]
    return rows.map_frames(texts, run, f"id {kind}, h bigint, reading int, pos int, size int, slots array<string>, whole int")


class Stretch:
    """Slot pairs of consecutive windows: consistent if no value of the item became two and no two names or units one."""

    def __init__(self):
        self.pairs, self.images, self.sources = Counter(), Counter(), Counter()

    def add(self, pairs: set[tuple[str, str]]) -> None:
        for theirs, ours in pairs:
            if not self.pairs[theirs, ours]:
                self.images[theirs] += 1
                self.sources[ours] += 1
            self.pairs[theirs, ours] += 1

    def drop(self, pairs: set[tuple[str, str]]) -> None:
        for theirs, ours in pairs:
            self.pairs[theirs, ours] -= 1
            if not self.pairs[theirs, ours]:
                self.images[theirs] -= 1
                self.sources[ours] -= 1

    def takes(self, pairs: set[tuple[str, str]]) -> bool:
        number = f"{NUMBER}:"
        return all(self.images[t] == 1 and (o.startswith(number) or self.sources[o] == 1) for t, o in pairs)


def judge(found: list[tuple], whole: int, window: int) -> tuple[int, int, bool | None, int]:
    """Windows, tokens and whether all values are equal of the best stretch (None: there is none), and contradicted equal windows.

    ``found``: ``at, size, theirs, ours`` of the windows of one alignment, in order. Values that
    differ need a consistent map over all of the alignment that covers enough of the item,
    or a long stretch with one.
    """
    pairs = [set(zip(f[2], f[3], strict=True)) for f in found]
    same = [all(t == o for t, o in p) for p in pairs]
    held, start, best = Stretch(), 0, (0, 0)
    for i, p in enumerate(pairs):
        held.add(p)
        while not held.takes(p) and start <= i:
            held.drop(pairs[start])
            start += 1
        best = max(best, (i + 1 - start, -start))
    n, start = best[0], -best[1]
    equal = n > 0 and all(same[start : start + n])
    if n == len(found):
        again = any(len(set(f[2])) < len(f[2]) and not s for f, s in zip(found, same, strict=True))
        ends = found[0][0] == 0 and found[-1][0] == whole - 1
        fine = equal or ends or n >= min(COVER * whole, LONG * window) or (n > 1 and again)
    else:
        fine = n >= LONG * window
    if not fine:
        return 0, 0, None, 0 if n == len(found) else sum(same)
    return n, max(f[0] + f[1] for f in found[start : start + n]) - found[start][0], equal, 0 if n == len(found) else sum(same)


def _judged(runs: DataFrame, item: str, window: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, name, whole, found in zip(b["id"], b["name"].astype(object), b["whole"], b["found"], strict=True):
                n, size, equal, against = judge([(f["at"], f["size"], f["theirs"], f["slots"]) for f in found], whole, window)
                out.append((i, None if pd.isna(name) else name, n, size, equal, against))
            yield pd.DataFrame(out, columns=["id", "name", "n_windows", "n_tokens", "same", "against"])

    kinds = dict(runs.dtypes)
    schema = f"id {kinds['id']}, name {kinds[item]}, n_windows bigint, n_tokens int, same boolean, against int"
    return rows.map_frames(runs.select("id", F.col(item).alias("name"), "whole", "found"), run, schema).withColumnRenamed("name", item)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``key, item, n_windows, n_tokens, same_values``.

    Columns ``also`` of the documents are added.

    A match is a window of equal words, or an aligned run of windows with equal templates
    (several: the one with most windows counts) whose slot values map consistently and that
    covers enough of the item; ``same_values`` tells a copy from a question with other
    values. Equal windows inside a run whose values contradict each other count if they are
    many enough for themselves. Items with fewer tokens than ``window`` must be there whole;
    those under SHORTEST tokens, and windows with too few different literal tokens, match
    word for word only. Null and empty texts match nothing; null and repeated keys or items
    are matched as they are and returned once a row and item. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = benchmark.select(F.col(item).alias("id"), F.col(text).cast("binary").alias("t"))
    wanted = rows.written(_hits(asked, None, lambda h: np.ones(len(h), bool), window).distinct(), "benchmark-windows")
    plain = F.col("reading") == PLAIN
    sizes = [tuple(r) for r in wanted.select(plain, "size").distinct().collect()]
    share = spark.sparkContext.broadcast(rows.bit_filter(wanted, "h", FILTER_BITS))
    numbered = rows.numbered(docs.select(*dict.fromkeys((key, text, *also))), key)
    texts = numbered.select(F.col(rows.ROW).alias("id"), F.col(text).cast("binary").alias("t"))
    with rows.short_batches(spark):
        found = rows.written(_hits(texts, sizes, lambda h: rows.in_filter(share.value, h), window).drop("whole"), "document-windows")
    # Templates.
    asked_for = wanted.where(~plain).select(
        "h", "size", F.col("id").alias(item), F.col("pos").alias("at"), F.col("slots").alias("theirs"), F.col("reading").alias("read"), "whole"
    )
    met = found.where(~plain).join(rows.small(asked_for), ["h", "size"]).where(F.size("slots") == F.size("theirs"))
    aligned = met.groupBy("id", item, "read", "reading", "whole", (F.col("pos") - F.col("at")).alias("shift"))
    runs = aligned.agg(F.sort_array(F.collect_set(F.struct("at", "size", "theirs", "slots"))).alias("found"))
    sure = F.when(F.col("same").isNotNull(), F.struct("n_windows", "n_tokens", "same"))
    other = _judged(runs, item, window).select("id", item, sure.alias("run"), F.lit(None).alias("copy"), F.lit(None).alias("need"), "against")
    # Equal words.
    asked_for = wanted.where(plain).groupBy("h", "size", F.col("id").alias(item)).agg(F.min("pos").alias("at"), F.min("whole").alias("whole"))
    met = found.where(plain).select("id", "h", "size").join(rows.small(rows.written(asked_for, "benchmark-words")), ["h", "size"])
    span = (F.max(F.col("at") + F.col("size")) - F.min("at")).alias("n_tokens")
    need = F.least(F.min("whole") * COVER, F.lit(float(LONG * window))).alias("need")
    copies = met.groupBy("id", item).agg(F.count_distinct("h").alias("n_windows"), span, need)
    copy = F.struct("n_windows", "n_tokens", F.lit(True).alias("same")).alias("copy")
    equal = copies.select("id", item, F.lit(None).alias("run"), copy, "need", F.lit(0).alias("against"))
    every = other.unionByName(equal).groupBy("id", item)
    every = every.agg(F.max("run").alias("run"), F.max("copy").alias("copy"), F.max("need").alias("need"), F.max("against").alias("against"))
    enough = (F.col("copy.n_windows") > F.col("against")) | (F.col("copy.n_windows") >= F.col("need"))
    best = every.select("id", item, F.greatest("run", F.when(enough, F.col("copy"))).alias("best")).where("best IS NOT NULL")
    named = best.withColumnRenamed("id", rows.ROW).join(numbered.select(*dict.fromkeys((rows.ROW, key, *also))), rows.ROW)
    return named.select(key, *also, item, "best.n_windows", "best.n_tokens", F.col("best.same").alias("same_values"))
