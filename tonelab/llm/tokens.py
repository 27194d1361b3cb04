"""Token counts of texts under a unigram vocabulary, by a trie of pre-tokens.

The distinct pre-tokens of a batch are the leaves of a trie. The best segmentation of a
prefix does not depend on what follows, so scores are computed once per node. Walking the
sorted pre-tokens visits the trie depth first: only the scores on the current branch are
held, and the score at a pre-token's last node is stored as its count.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.llm import rows

START = "▁"
#: Pre-tokens whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 1 << 20
#: Texts whose pre-tokens share a trie.
TEXTS = 1024
#: Frequent pieces come first in the file: piece number r has probability ~ 1 / (r + SHIFT).
SHIFT = 10


class Vocabulary:
    """Log scores of pieces; a character without a piece costs its bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): -math.log(r + SHIFT) for r, i in enumerate(plain)}
        self.byte = -math.log(size + SHIFT) - 1
        self.longest = max(map(len, self.score), default=1)
        self.known: dict[bytes, int] = {}

    def counts(self, sorted_words: list[str]) -> list[int]:
        """Number of pieces of the best segmentation of each word; words sorted and distinct.

        Highest score first, then fewest pieces.
        """
        get, longest, byte = self.score.get, self.longest, self.byte
        best: list[tuple[float, int]] = [(0.0, 0)]
        before, out = "", []
        for word in sorted_words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                score, n = best[end - 1]
                size = len(word[end - 1].encode("utf-8", "surrogateescape"))
                top = (score + size * byte, -n - size) if word[end - 1] not in self.score else (-math.inf, 0)
                for start in range(max(0, end - longest), end):
                    own = get(word[start:end])
                    if own is not None:
                        score, n = best[start]
                        if (score + own, -n - 1) > top:
                            top = (score + own, -n - 1)
                best.append((top[0], -top[1]))
            out.append(best[len(word)][1])
            before = word
        return out


    def look_up(self, texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [t.split() if t else [] for t in texts]
        met = set().union(*split)
        new = met.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, met
        # Sorted as text: prefixes of characters, not of bytes, are shared.
        order = sorted((START + w.decode("utf-8", "surrogateescape"), w) for w in new)
        self.known.update(zip((w for _, w in order), self.counts([s for s, _ in order]), strict=True))
        return ((len(w), sum(map(self.known.__getitem__, w))) for w in split)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_pretokens``, ``n_tokens``.

    Pre-tokens are runs without ASCII white space, each with a word-start sign in front. A
    null, empty or blank text has none. Null and repeated keys are rows of their own;
    other columns are ignored; an empty table gives none. No row is moved: tasks share
    work over the pre-tokens of a batch and remember a bounded number of counts.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x for at in range(0, len(b), TEXTS) for x in vocabulary(path).look_up(list(b["text"].iloc[at : at + TEXTS]))]
            yield pd.DataFrame({"key": b["key"].astype(object), "n_pretokens": [x for x, _ in found], "n_tokens": [y for _, y in found]})

    kind = dict(docs.dtypes)[key]
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.map_frames(texts, run, f"key {kind}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("key", key)
