"""Word hashes against a plain split."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelab.llm import hashing, suffix_tree

PIECES = st.lists(st.one_of(st.none(), st.lists(st.sampled_from([b"a", b"B", b"ab", b" ", b"\x0b", b"\t", b"\xc3\xa9", b"A" * 40000, b"z" * 9]), max_size=12).map(b"".join)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_words(texts):
    got, sizes = hashing.words(texts)
    split = [(t or b"").lower().split() for t in texts]
    assert sizes.tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    seen = dict(zip(flat, got.tolist(), strict=True))
    assert [seen[w] for w in flat] == got.tolist()
    assert len(set(seen.values())) == len(seen)


def test_many_words_do_not_meet():
    text = " ".join(f"{i:x}" for i in range(300_000)).encode()
    got, sizes = hashing.words([text])
    assert sizes.tolist() == [300_000] and len(np.unique(got)) == 300_000


def test_table():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    keys = np.unique(keys)
    table = suffix_tree.Table(keys, np.arange(len(keys), dtype=float))
    value, found = table.look_up(keys)
    assert found.all() and value.tolist() == list(range(len(keys)))
    assert not table.look_up(keys + np.uint64(1 << 63))[1].any()
    assert not suffix_tree.Table(keys[:0], np.zeros(0)).look_up(keys)[1].any()
