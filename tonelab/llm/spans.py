"""Substring dedup by sliding runs of consecutive sentences.

A text is cut into sentences; long ones are cut further after words chosen by their hash, and
where none is chosen for a while, after the least of the last few words, so
copies of a passage are cut alike wherever it stands. Every run of consecutive sentences
with enough words is hashed, hashes are joined over the whole table, and the sentences
under a run that occurred before are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.llm import rows

#: A run: the fewest sentences from its start on with at least so many sentences and words.
SENTENCES, WORDS = 3, 24
#: Sentences with more words are cut after words whose hash is divisible by CUT, and after a word
#: whose hash is the least of the last LONG words if none of those is chosen.
LONG, CUT = 8, 3
#: Bits of the filter that tells in which texts a repeated run may be.
BITS = 1 << 27
#: Texts that are cut at once.
TEXTS = 256
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
BYTES, SEEN, KEPT = (rows.OWN + name for name in ("bytes", "seen", "kept"))
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(signs: bytes) -> np.ndarray:
    """Whether each byte is one of the signs."""
    out = np.zeros(256, bool)
    out[[*signs]] = True
    return out


_BLANK, _QUOTE, _STOP = _table(b"\t\n\v\f\r "), _table(b"\"')"), _table(b".!?")


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, text after text; whether a word ends a line or a sentence; number of words of each text.

    A word is hashed once for all texts; the rest is read off the bytes at once.
    """
    whole = b"\n".join([*(t or b"" for t in texts), b""]).lower()
    data = np.frombuffer(whole, np.uint8)
    place = np.arange(len(data))
    blank = _BLANK[data]
    turn = np.flatnonzero(np.diff(blank, prepend=True))
    begin, last = turn[::2], turn[1::2] - 1  # the last byte is blank
    letter = np.maximum.accumulate(np.where(_QUOTE[data], -1, place))[last]  # the last one that is no quote
    ends = (letter >= begin) & _STOP[data[letter]]
    before = np.searchsorted(last, np.flatnonzero(data == ord("\n")))  # words before each end of a line
    ends[before[before > 0] - 1] = True
    split = pc.ascii_split_whitespace(pa.array([whole], pa.large_binary()).view(pa.large_utf8())).flatten()
    coded = split.filter(pc.not_equal(pc.binary_length(split), 0)).dictionary_encode()
    met = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, met), np.uint64, len(met))[coded.indices.to_numpy()]
    upto = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    return hashes, ends, np.diff(np.searchsorted(begin, upto), prepend=0)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Cut:
    """Sentences and runs of a list of texts (bytes or None), ignoring case A-Z and white space.

    ``text``, ``first``, ``end``: number of the text and the words of each sentence, counted in the
    text; ``run_*``: text, first and end sentence, and hash of the run that starts at a sentence.
    """

    def __init__(self, texts: list[bytes | None], least: int, words: int):
        hashes, ends, per_text = _words(texts)
        # Long sentences end after chosen words as well.
        last = np.flatnonzero(ends)
        size = np.diff(last, prepend=-1)
        ends |= _cuts_inside(hashes, np.append(0, last[:-1] + 1)[: len(last)], size)
        last = np.flatnonzero(ends)
        begin = np.append(0, last[:-1] + 1) if len(last) else last
        size = last + 1 - begin
        within = np.arange(len(hashes)) - np.repeat(begin, size)
        spread = hashes * _powers(_BASE, int(size.max(initial=0)))[within]
        sentence = _mixed(np.add.reduceat(spread, begin)) if len(last) else hashes
        self.text = np.repeat(np.arange(len(texts)), per_text)[begin]
        offset = (np.cumsum(per_text) - per_text)[self.text]
        self.first, self.end = begin - offset, last + 1 - offset
        self.sentences = np.bincount(self.text, minlength=len(texts))
        # A run: sums of sentence hashes times powers by place, turned back to its start.
        n = len(last)
        upto = np.append(0, np.cumsum(size))
        start = np.arange(n)
        stop = np.maximum(np.searchsorted(upto, upto[:-1] + words), start + least)
        fit = stop <= np.searchsorted(self.text, self.text, "right")
        start, stop = start[fit], stop[fit]
        sums = np.append(np.uint64(0), np.cumsum(sentence * _powers(_BASE, n), dtype=np.uint64))
        self.run_hash = _mixed((sums[stop] - sums[start]) * _powers(_INVERSE, n)[start] + (stop - start).astype(np.uint64)).view(np.int64)
        self.run_text, self.run_first, self.run_end = self.text[start], start, stop


def _cuts_inside(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """After which words long sentences are cut; a word is judged by the LONG words up to it alone.

    In a run of one word every one is the least, in a repeated pattern its least word.
    """
    long = np.repeat(size > LONG, size)
    chosen = hashes % np.uint64(CUT) == 0
    least, upto = hashes.copy(), np.append(0, np.cumsum(chosen))
    for back in range(1, LONG):
        np.minimum(least[back:], hashes[:-back] if back < len(hashes) else hashes[:0], out=least[back:])
    within = np.arange(len(hashes)) - np.repeat(begin, size)
    at = np.arange(len(hashes)) + 1
    none = upto[at] == upto[np.maximum(at - LONG, 0)]
    return long & (chosen | ((within >= LONG - 1) & none & (hashes == least)))


def _hashes(whole: DataFrame, text: str, least: int, words: int) -> DataFrame:
    """``_row, hs``: the hashes of a row's runs, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), TEXTS):
                part = b.iloc[at : at + TEXTS]
                cut = Cut(list(part["t"]), least, words)
                met = pd.DataFrame({"t": cut.run_text, "h": cut.run_hash}).drop_duplicates()
                ends = np.searchsorted(met["t"].to_numpy(), np.arange(1, len(part)))
                yield pd.DataFrame({rows.ROW: part[rows.ROW].to_numpy(), "hs": np.split(met["h"].to_numpy(), ends)})

    return rows.map_frames(whole.select(rows.ROW, F.col(text).cast("binary").alias("t")), run, f"{rows.ROW} bigint, hs array<bigint>")


def _maybe_repeated(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """``h, _row``: the hashes that a filter of the repeated ones lets through; no repeated one is lost."""
    held = found.sparkSession.sparkContext.broadcast(rows.bit_filter(repeated, "h", BITS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.concatenate([np.zeros(0, np.int64), *b["hs"]])
            whose = np.repeat(b[rows.ROW].to_numpy(), b["hs"].map(len))
            may = rows.in_filter(held.value, h.view(np.uint64))
            yield pd.DataFrame({"h": h[may], rows.ROW: whose[may]})

    return rows.map_frames(found, run, f"h bigint, {rows.ROW} bigint")


def drop_repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS, limit: int = rows.BROADCAST_ROWS
) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``n_sentences``, ``n_removed``.

    A sentence goes if it lies under a run of at least ``least`` sentences and ``words`` words
    that occurred before: in a row with a smaller ``key`` (nulls last), or earlier in its
    own text. What is left keeps its bytes. Shorter texts have no run, very long ones are cut whole. A null text stays null.
    Rows are never dropped; a text may become empty. Equal rows: the first one stays whole.
    All other columns are returned as they are, but ``n_sentences`` and ``n_removed``, which
    are replaced. ``limit``: repeated hashes that may be broadcast.
    """
    whole = rows.numbered(docs, key)
    found = rows.written(_hashes(whole, text, least, words), "runs")
    counted = found.select(F.explode("hs").alias("h"), rows.ROW).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(rows.ROW).alias("first"))
    repeated = rows.written(counted.where("n > 1").select("h", "first"), "repeated-runs")
    later = _maybe_repeated(found, repeated).join(rows.small(repeated, limit=limit), "h").where(F.col(rows.ROW) > F.col("first"))
    seen = rows.written(later.groupBy(rows.ROW).agg(F.collect_list("h").alias(SEEN)), "seen")
    size = seen.agg(F.sum(F.size(SEEN) + 1)).first()[0] or 0
    joined = whole.withColumn(BYTES, F.col(text).cast("binary")).join(rows.small(seen, size, limit), rows.ROW, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), TEXTS):
                part = b.iloc[at : at + TEXTS]
                texts = list(part[BYTES])
                cut = Cut(texts, least, words)
                old = [np.zeros(0, np.int64) if s is None else s for s in part[SEEN]]
                seen = pd.DataFrame({"h": np.concatenate(old), "t": np.repeat(np.arange(len(old)), [len(s) for s in old]), "seen": True})
                met = pd.DataFrame({"h": cut.run_hash, "t": cut.run_text})
                again = met.duplicated().to_numpy() | met.merge(seen, "left", ["h", "t"])["seen"].notna().to_numpy()
                covered = np.zeros(len(cut.text) + 1, np.int64)
                np.add.at(covered, cut.run_first[again], 1)
                np.add.at(covered, cut.run_end[again], -1)
                gone = np.cumsum(covered)[:-1] > 0
                removed = np.bincount(cut.text[gone], minlength=len(texts))
                kept = list(texts)
                for i in np.flatnonzero(removed):
                    own = _own(cut, i, gone)
                    kept[i] = _left(texts[i], cut.first[own], cut.end[own])
                yield part.drop(columns=[BYTES, SEEN]).assign(**{KEPT: kept}, n_sentences=cut.sentences, n_removed=removed)

    kinds = dict(docs.dtypes)
    counts = ("n_sentences", "n_removed")
    others = [c for c in docs.columns if c not in (text, *counts)]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + [f"{KEPT} binary", "n_sentences int", "n_removed int"])
    cut = rows.map_frames(joined.select(*others, BYTES, SEEN), run, schema)
    return cut.select(*[F.col(KEPT).cast("string").alias(c) if c == text else F.col(c) for c in docs.columns if c not in counts], *counts)


def _own(cut: Cut, i: int, gone: np.ndarray) -> np.ndarray:
    a, b = np.searchsorted(cut.text, [i, i + 1])
    return a + np.flatnonzero(gone[a:b])


def _left(text: bytes, first: np.ndarray, end: np.ndarray) -> bytes:
    """The text without the words from ``first`` to ``end``; the white space around them stays."""
    places = [m.span() for m in _WORD.finditer(text)]
    at, out = 0, []
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])
