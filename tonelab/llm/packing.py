"""Bounded-space online packing of token ids into windows of fixed length.

Each task keeps a fixed number of open windows. A piece goes to the window it fills best;
if it fits none and no window may be opened, the fullest window is filled up with a part of
the piece and emitted. Windows still open at the end of a task are packed again in ever
fewer tasks; what is left in the last one ends in windows whose lengths are powers of two.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.llm import rows

LENGTH = 2048
OPEN = 16
#: Open windows of so many tasks are packed again in one task.
FAN_IN = 32
END = 1
#: Words whose ids a worker remembers: half of them met lately, half before that.
REMEMBERED = 1 << 18
ID_BYTES = 4
#: Bytes of texts that are taken at once, words that are looked up at once, and signs at their end: all of ASCII, but what begins or ends a special token.
BYTES, WORDS, SIGNS = 1 << 20, 1 << 12, b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
#: Words of these letters are the same after the tokenizer's normalising and splitting.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
ACCENTED = [*map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100)))]


class Known(dict):
    """Ids by word; one that is missing comes from ``older``, the words known before, or is learnt."""

    def __init__(self, learn: Callable[[bytes], bytes], older: Known | None = None):
        super().__init__()
        self.learn, self.older = learn, {} if older is None else older
        if older:
            older.older = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        self[word] = ids = self.learn(word) if ids is None else ids
        return ids


class Encoder:
    """Ids of a text as little-endian 32-bit numbers.

    The tokenizer lowers case and never joins characters across white space, nor a letter and
    a sign. So words are encoded one by one, without signs at their end, each once for many texts,
    and frequent ones are remembered.
    A word of plain letters goes to the tokenizer's model as it is, others through all its steps.
    A text is cut at special tokens as they are written, before lowering; each is its id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.without_special = Tokenizer.from_file(path)  # what lowering turns into special tokens is none
        self.without_special.encode_special_tokens = True
        special = {t.content.encode(): i for i, t in self.without_special.get_added_tokens_decoder().items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        longest = sorted(special, key=len, reverse=True)
        self.at_special = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if special else None
        self.tokenize = self.without_special.model.tokenize
        spell = self.without_special.pre_tokenizer.pre_tokenize_str
        self.spelling = str.maketrans({c: spell(c)[0][0] for c in ACCENTED})
        self.raw = [i.to_bytes(ID_BYTES, "little") for i in range(self.without_special.get_vocab_size())]
        self.forget()

    @functools.cached_property
    def tokenizer(self):
        """The tokenizer of the file, with its special tokens; tasks do not need it."""
        return type(self.without_special).from_file(self.path)

    def encode(self, text: bytes | None) -> bytes:
        if not text or not self.at_special or not self.at_special.search(text):
            return self.plain([text])[0]
        parts = self.at_special.split(text)
        return b"".join(self.special[p] if i % 2 else self.plain([p])[0] for i, p in enumerate(parts))

    def encode_all(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text; texts without special tokens are taken together, about BYTES bytes at once."""
        held, size = [], 0
        for t in texts:
            if t and self.at_special and self.at_special.search(t):
                yield from self.plain(held)
                yield self.encode(t)
                held, size = [], 0
                continue
            held.append(t)
            size += len(t or b"")
            if size > BYTES:
                yield from self.plain(held)
                held, size = [], 0
        yield from self.plain(held)

    def plain(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of texts without special tokens; those that lower case makes are no special tokens."""
        split = pc.ascii_split_whitespace(pa.array([(t or b"").lower() for t in texts], pa.large_binary()).view(pa.large_utf8()))
        words = split.flatten()
        there = pc.not_equal(pc.binary_length(words), 0)  # white space at the ends makes empty words
        upto = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))[split.offsets.to_numpy()]
        coded = words.filter(there).dictionary_encode()
        ids = self.look_up(coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // ID_BYTES
        flat, start, word = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size, coded.indices.to_numpy()
        out = []
        for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            parts = []
            for at in range(a, z, WORDS):
                some = word[at : min(at + WORDS, z)]
                n = size[some]
                to = np.cumsum(n)
                parts.append(flat[np.repeat(start[some] - to + n, n) + np.arange(to[-1])].tobytes())
            out.append(b"".join(parts))
        return out

    def look_up(self, words: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(words), WORDS):
            if len(self.known) + 3 * WORDS > REMEMBERED // 2:  # what was not met since the last time goes
                self.known = Known(self.learn, self.known)
            out.extend(map(self.known.__getitem__, words[at : at + WORDS]))
        return out

    def forget(self) -> None:
        self.known = Known(self.learn)

    def learn(self, w: bytes) -> bytes:
        """Ids of a word met first."""
        if w.isalpha():  # of bytes: letters a to z alone
            return b"".join([self.raw[t.id] for t in self.tokenize(w.decode("ascii"))])
        stem = w.rstrip(SIGNS)
        if len(stem) < len(w):
            signs = w[len(stem) :]
            if not stem:
                return self.ids(signs.decode("ascii")).tobytes()
            if stem.isalpha() or LETTERS.fullmatch(stem.decode("utf-8", "replace")):
                return self.known[stem] + self.known[signs]
        elif LETTERS.fullmatch(word := w.decode("utf-8", "replace")):
            return b"".join([self.raw[t.id] for t in self.tokenize(word.translate(self.spelling))])
        return self.ids(w.decode("utf-8", "replace")).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.without_special.encode(text, add_special_tokens=False).ids, "<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Windows of one task. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.windows, self.next_id = length, windows, first_id
        self.open: list[tuple[int, list]] = []  # tokens held, pieces
        self.done: list[tuple] = []

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) // ID_BYTES
            if n >= self.length:
                take, at = self.length, None
            else:
                fits = [(held, i) for i, (held, _) in enumerate(self.open) if held + n <= self.length]
                if fits:
                    take, at = n, max(fits)[1]
                elif len(self.open) < self.windows:
                    take, at = n, len(self.open)
                    self.open.append((0, []))
                else:
                    held, at = max((held, i) for i, (held, _) in enumerate(self.open))
                    take = self.length - held
            held, pieces = (0, []) if at is None else self.open[at]
            pieces.append((doc, start, ids[: take * ID_BYTES], total))
            if held + take == self.length:
                self.emit(pieces, True)
                if at is not None:
                    self.open.pop(at)
            else:
                self.open[at] = (held + take, pieces)
            start, ids = start + take, ids[take * ID_BYTES :]

    def emit(self, pieces: list, closed: bool) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // ID_BYTES
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, None if closed else ids))
            offset += n
        self.next_id += 1

    def leave(self) -> None:
        """Pass on what is open, with its ids."""
        for _, pieces in self.open:
            self.emit(pieces, False)
        self.open = []

    def finish(self) -> None:
        """Fill windows one after the other; cut the last one into powers of two."""
        rest = [p for _, pieces in self.open for p in pieces]
        self.open, left = [], sum(len(p[2]) for p in rest) // ID_BYTES
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc, start, ids, total = rest.pop(0)
                n = min(room, len(ids) // ID_BYTES)
                taken.append((doc, start, ids[: n * ID_BYTES], total))
                if n * ID_BYTES < len(ids):
                    rest.insert(0, (doc, start + n, ids[n * ID_BYTES :], total))
                room -= n
            self.emit(taken, True)

    def rows(self) -> pd.DataFrame:
        out, self.done = self.done, []
        return pd.DataFrame(out, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, windows: int = OPEN) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A text (null: empty) becomes its ids without special tokens and one end id; every id is
    in exactly one piece, pieces of a window follow each other without a gap, and windows
    hold ``length`` ids but for the few last ones, whose lengths are powers of two. Rows are
    packed as they are read; null and repeated keys are documents of their own. An empty
    table gives no piece. Other columns are ignored. ``path``: the tokenizer's file.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = dict(docs.dtypes)[key]
    schema = f"doc {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    end = np.array([END], "<u4").tobytes()

    def first_id(level: int) -> int:
        return (level << 56) + (TaskContext.get().partitionId() << 32)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(length, windows, first_id(0))
        code = encoder(path)
        for b in batches:
            for doc, ids in zip(b["doc"].astype(object), code.encode_all(list(b["text"])), strict=True):
                ids += end
                packer.add(doc, 0, ids, len(ids) // ID_BYTES)
            yield packer.rows()
        packer.leave()
        yield packer.rows()
        code.forget()  # the worker lives on, for other work

    def again(level: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            packer = Packer(length, windows, first_id(level))
            for b in batches:
                for r in b.itertuples():
                    packer.add(None if pd.isna(r.doc) else r.doc, r.start, r.ids, r.doc_tokens)
                yield packer.rows()
            packer.finish() if last else packer.leave()
            yield packer.rows()

        return run

    # Not pandas' guess: integers with nulls would become doubles.
    texts = docs.select(F.col(key).alias("doc"), F.col(text).cast("binary").alias("text"))
    with rows.short_batches(docs.sparkSession):
        out = rows.written(rows.map_frames(texts, encode, schema), "pieces")
    done, level = out.where("ids IS NULL").drop("ids"), 0
    tasks = out.where("ids IS NOT NULL").agg(F.max(F.col("sequence_id").bitwiseAND((1 << 56) - 1))).first()[0]
    tasks = None if tasks is None else (tasks >> 32) + 1
    while tasks is not None:
        level, tasks = level + 1, -(-tasks // FAN_IN)
        task = F.shiftright(F.col("sequence_id").bitwiseAND((1 << 56) - 1), 32)
        left = out.where("ids IS NOT NULL").repartition(tasks, F.floor(task / FAN_IN)).sortWithinPartitions("sequence_id", "offset")
        out = rows.written(rows.map_frames(left, again(level, tasks == 1), schema), "pieces")
        done = done.unionByName(out.where("ids IS NULL").drop("ids"))
        tasks = None if tasks == 1 else tasks
    return done.withColumnRenamed("doc", key)
