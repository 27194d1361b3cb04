"""Fill-in-middle transformation: texts cut twice between words and put in another order.

Every byte of a text gets a class of three bits: white space or not; line feed, or a byte that
continues a character; first of its run or not. A wavelet matrix over the classes answers how
many words, runs of white space and characters lie before any byte. Differences of such ranks
are the number of units of a text and the characters of its parts, and bisection on ranks finds
the byte at which a unit ends. Nothing is matched word by word, and all texts of a slice are
asked at once. Only texts go to Python, only numbers come back; the parts are put
together, hashed and taken apart again by Spark's own functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.llm import rows
from tonelab.llm.wavelet import WaveletMatrix

#: Percent of texts that are cut, and percent of those with the suffix first.
RATE, SPM = 50, 80
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of texts that share a wavelet matrix; a longer text has one of its own.
SLICE = 1 << 20
BITS = 3
_BLANK, _OTHER, _FIRST = 4, 2, 1
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[0x0A] |= _OTHER
_CLASS[0x80:0xC0] = _OTHER


class Units:
    """Words of some texts with the white space before them; white space at the end is a unit too.

    ``data`` holds the texts one after the other, text i the bytes from ``cuts[i]`` to ``cuts[i + 1]``.
    """

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        self.start, self.end = cuts[:-1], cuts[1:]
        symbols = _CLASS[data]
        blank = symbols >= _BLANK
        first = np.append(True, blank[1:] != blank[:-1])[: len(data)]
        filled = self.end > self.start
        first[self.start[filled]] = True
        self.matrix = WaveletMatrix(symbols | first, BITS)
        self.leads = np.zeros(len(self.start), np.int64)
        self.leads[filled] = blank[self.start[filled]]
        self.runs = self._runs(self.end) - self._runs(self.start)
        trails = np.zeros(len(self.start), np.int64)
        trails[filled] = blank[self.end[filled] - 1]
        self.n = self._words(self.end) - self._words(self.start) + trails

    def _words(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(_FIRST, at) + self.matrix.rank(_OTHER | _FIRST, at)

    def _runs(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(_BLANK | _FIRST, at) + self.matrix.rank(_BLANK | _OTHER | _FIRST, at)

    def ends(self, k: np.ndarray) -> np.ndarray:
        """Byte of each text at which its first ``k`` units end.

        The k-th word ends where the next run of white space begins: at the first byte behind which
        there are k such runs, one more if the text begins with one; without it, at the end.
        """
        wanted = k + self.leads
        inside = (k > 0) & (wanted <= self.runs)
        wanted = (wanted + self._runs(self.start))[inside]
        low, high = self.start[inside], self.end[inside]  # fewer runs up to low, enough up to high
        while (high - low > 1).any():
            middle = (low + high) // 2
            enough = self._runs(middle) >= wanted
            low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        out = np.where(k > 0, self.end, self.start)
        out[inside] = high - 1
        return out

    def characters(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points between two bytes: those that do not continue one."""
        more = self.matrix.rank(_OTHER >> 1, end, 2) - self.matrix.rank(_OTHER >> 1, start, 2)
        return end - start - more


CUT = "n bigint, prefix_bytes bigint, middle_bytes bigint, prefix_chars bigint, middle_chars bigint"


def _cut(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    names = [c.split()[0] for c in CUT.split(", ")]
    upto = np.zeros(1, np.int64)
    if len(text):
        kind = np.int64 if pa.types.is_large_binary(text.type) else np.int32
        upto = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    draws = [h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2)]
    parts, at = [], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE, "right")) - 1)
        units = Units(data[upto[at] : upto[to]], upto[at : to + 1] - upto[at])
        a, b = (d[at:to] % (units.n + 1) for d in draws)
        first, second = units.ends(np.minimum(a, b)), units.ends(np.maximum(a, b))
        chars = units.characters(units.start, first), units.characters(first, second)
        parts.append((units.n, first - units.start, second - first, *chars))
        at = to
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def draw(seed: int, key: Column, i: int) -> Column:
    """The i-th of eight draws below 2^32 that depend on seed and key alone; a null key is no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, seed: int = 42, rate: int = RATE, spm: int = SPM,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``docs`` with ``fim_text``, ``form``, ``n_units``, ``prefix_chars`` and ``middle_chars``.

    Of a text with n units two cuts from 0 to n are drawn. ``form`` ``psm``: prefix, suffix,
    middle, each after its mark; ``spm``: suffix, prefix, middle; ``plain``: the text as it is,
    if it is empty, holds a mark, or is not among the ``rate`` percent drawn, and then the characters
    are null. A null text is empty. Long texts are cut whole. Equal and null keys draw the same
    numbers; each row is a text of its own, and all other columns are returned, but those of
    the new names, which are replaced. An empty table gives an empty one. No mark may hold its
    first or last sign again, or it could arise anew where two parts meet.
    """
    if any(mark[0] in mark[1:] or mark[-1] in mark[:-1] for mark in marks):
        raise ValueError(f"the first or last sign of a mark occurs again in it: {marks}")
    cut = F.arrow_udf(_cut, CUT)
    own = {name: rows.OWN + name for name in ("text", "cut", "form")}
    body, place = F.col(own["text"]), F.col(own["cut"])
    plain = (F.octet_length(body) == 0) | (draw(seed, F.col(key), 2) % 100 >= rate)
    for mark in marks:
        plain |= F.contains(body, F.lit(mark))
    kind = F.when(plain, "plain").when(draw(seed, F.col(key), 3) % 100 < spm, "spm").otherwise("psm")
    held = docs.withColumn(own["text"], F.coalesce(F.col(text), F.lit("")))
    done = held.withColumns({own["cut"]: cut(body.cast("binary"), draw(seed, F.col(key), 0), draw(seed, F.col(key), 1)), own["form"]: kind})
    raw, first = body.cast("binary"), place["prefix_bytes"].cast("int")
    second = first + place["middle_bytes"].cast("int")
    prefix, middle, suffix = (
        part.cast("string")
        for part in (
            F.substring(raw, F.lit(1), first), F.substring(raw, first + 1, place["middle_bytes"].cast("int")),
            F.substring(raw, second + 1, F.octet_length(raw) - second),
        )
    )
    p, s, m = map(F.lit, marks)
    is_plain = F.col(own["form"]) == "plain"
    whole = F.when(is_plain, body).when(F.col(own["form"]) == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    new = {
        "fim_text": whole, "form": F.col(own["form"]), "n_units": place["n"],
        "prefix_chars": F.when(~is_plain, place["prefix_chars"]), "middle_chars": F.when(~is_plain, place["middle_chars"]),
    }
    return done.select(*[c for c in docs.columns if c not in new], *[c.alias(name) for name, c in new.items()])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from ``fim_text`` and ``form`` alone.

    A mark occurs once in a cut text: its first and last sign occur nowhere else in it.
    """
    p, s, m = marks
    until, behind = lambda mark, c: F.substring_index(c, mark, 1), lambda mark, c: F.substring_index(c, mark, -1)
    middle = behind(m, output)
    psm = F.concat(behind(p, until(s, output)), middle, behind(s, until(m, output)))
    spm = F.concat(behind(p, until(m, output)), middle, behind(s, until(p, output)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
