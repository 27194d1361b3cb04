"""Words, sentence ends and hashes of many texts at once, against one text and word after the other."""

import sys

import numpy as np
import xxhash

from tonelab.llm import spans

TEXTS = [
    b"One two. Three!\" four?') five\n\n  six.\r\n seven \x0b\x0c\teight", None, b"", b" \n ", b"\n\nA", b"x", b"'\") \"\n. ')", b".", b"it's 'so'.\"",
    "É à\x85 b\xa0c \x1cd. ok ok OK".encode(), b"\xff\xfe. \x00 a\x00b", b"a" * 100_000 + b".", b"z \n", b"('.') a.'b ..." + b"'" * 5000 + b" end",
]


def one_by_one(texts):
    hashes, ends, sizes = [], [], []
    for t in texts:
        lines = [line.split() for line in (t or b"").lower().split(b"\n")]
        hashes += [xxhash.xxh64_intdigest(w) for line in lines for w in line]
        ends += [i == len(line) - 1 or w.rstrip(b"\"')").endswith((b".", b"!", b"?")) for line in lines for i, w in enumerate(line)]
        sizes.append(sum(map(len, lines)))
    return hashes, ends, sizes


def test_words():
    rng = np.random.default_rng(4)
    mixed = [bytes(rng.choice([*b"ab.!?\"') \n\t"], 60).tolist()) for _ in range(200)]
    for texts in (TEXTS, TEXTS[::-1], [], [None], [b"", b" "], mixed):
        assert tuple(x.tolist() for x in spans._words(texts)) == one_by_one(texts)


def test_calls_do_not_grow_with_lines():
    calls = []
    texts = [b"the same few words again.\n" * 50] * 100
    spans.Cut(texts, 3, 24)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        spans.Cut(texts, 3, 24)
    finally:
        sys.setprofile(None)
    assert len(calls) < 2000  # at least one a line before: 5000 lines
