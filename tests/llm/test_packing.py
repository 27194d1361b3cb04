"""Ids against a tokenizer of our own from the file, with special tokens in the text."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tonelab.llm import packing

TEXTS = [
    "a <|endoftext|> b", "<|ENDOFTEXT|> x", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|<|endoftext|>|>", "End.<|endoftext|>Next one, 10 times",
    "<|EndOfText|><|endoftext|>", "<|endoftext|>", "no special ones here. It's 2024!", "",
]


def test_special_tokens():
    path = public_tokenizers.path("word_bpe_49k.json")
    fresh, code = Tokenizer.from_file(path), packing.Encoder(path)
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(code.encode(t.encode()), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids, t
    assert code.encode(None) == b""


def test_texts_are_taken_together(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    fresh, code = Tokenizer.from_file(path), packing.Encoder(path)
    odd = ["ab***,(c)", " ab*** ab' 'ab it's. ÉTÉ! été*** \x85x\xa0y \x1cz\n", "***", "\t\v\f ", "e\u0301= =\u0338 x=\u0338", "a.b. 12. <|a|>. a|. <."]
    texts = [t.encode() for t in (*TEXTS, *odd)] + [None, b"x \xff\xfe. y"]
    whole, looked_up = [], []
    ids, look_up = packing.Encoder.ids, packing.Encoder.look_up
    monkeypatch.setattr(packing.Encoder, "ids", lambda self, text: (whole.append(text), ids(self, text))[1])
    monkeypatch.setattr(packing.Encoder, "look_up", lambda self, words: (looked_up.append(len(words)), look_up(self, words))[1])
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(packing, "BYTES", size)
        got = [np.frombuffer(x, "<u4").tolist() for x in code.encode_all(texts)]
        assert got == [fresh.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
    assert list(code.encode_all([])) == []
    # A word of many texts is looked up once, and one that ends in any signs goes to the model without them.
    whole.clear(), looked_up.clear()
    list(code.encode_all([b"some words*** some more%%% (words)"] * 100))
    assert sum(looked_up) == 4 and set(whole) <= {"***", "%%%", "(words)"}


def test_known_words_are_bounded(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    fresh, code = Tokenizer.from_file(path), packing.Encoder(path)
    monkeypatch.setattr(packing, "WORDS", 8)
    monkeypatch.setattr(packing, "REMEMBERED", 128)
    text = " ".join(f"{a}{b}{c}," for a in "abcdefgh" for b in "xyzuvw" for c in "klm")
    for _ in range(2):
        assert np.frombuffer(code.encode(text.encode()), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids
        assert len(code.known) <= 64 and len(code.known.older) <= 64 and not code.known.older.older
