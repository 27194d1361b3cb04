"""op4 against letters and n-grams taken one by one, with plain dictionaries."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from tonelab.llm import language, queries

DIM, SEED = 1024, 20


def grams(text):
    if text is None or not any(c.isalpha() for c in text):
        return Counter()
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    line = re.sub(" +", " ", f" {low} ")
    return Counter(line[i : i + 3] for i in range(len(line) - 2))


class Vectors(dict):
    """n-gram -> product of its letters' random signs, each moved on by its place from the end."""

    def __missing__(self, gram):
        out = np.ones(DIM)
        for place, c in enumerate(reversed(gram)):
            signs = np.random.default_rng([SEED, ord(c)]).integers(0, 2, DIM, np.int8) * 2.0 - 1
            out *= np.roll(signs, place)
        self[gram] = out
        return out


def predicted(rows):
    """doc_id -> held out, language, cosine with it, and the lead over the next language."""
    vectors, counts = Vectors(), defaultdict(Counter)
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(grams(r["text"]))
    bundle = lambda c: sum((n * vectors[g] for g, n in c.items()), np.zeros(DIM))
    names = sorted(counts)
    prototypes = np.array([bundle(counts[n]) for n in names])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    out = {}
    for r in rows:
        x = bundle(grams(r["text"]))
        if not x.any():
            out[r["doc_id"]] = held[r["doc_id"]], "und", 0.0, 1.0
            continue
        cosine = prototypes @ x / np.linalg.norm(x)
        best = int(cosine.argmax())
        lead = cosine[best] - max(np.delete(cosine, best), default=-1.0)
        out[r["doc_id"]] = held[r["doc_id"]], names[best], max(cosine[best], 0.0), lead
    return out


def compare(rows, got):
    want = predicted(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        held, name, score, lead = want[r["doc_id"]]
        assert r["held_out"] == held and r["score"] == pytest.approx(score, abs=1e-4)
        assert r["lang_pred"] == name or lead < 1e-4


def test_whole_table(spark):
    compare(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), queries.op4_language_id(spark, SMALL).collect())


def test_blocks_of_a_long_text_and_odd_letters(spark, monkeypatch):
    long = "Ünïcode İstanbul ß 12 3 … ﬁn — straße " * 40
    code = lambda g: sum(ord(c) << (21 * (2 - i)) for i, c in enumerate(g))
    want = {code(g): c for g, c in grams(long).items()}
    for size in (1, 2, 3, 64, 1520, 1 << 20):
        monkeypatch.setattr(language, "CHARS", size)
        keys, n = language.grams(long)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want
    monkeypatch.undo()
    long *= 1 + (1 << 20) // len(long)  # more than a block, in the tasks too
    texts = {0: "der Hund und die Katze", 1: "the dog and the cat", 2: "le chien et le chat", 3: long, 4: "", 5: None, 6: "12 34 !", 7: "the"}
    langs = {0: "de", 1: "en", 2: "fr", 3: None, 7: "en"}
    docs = spark.createDataFrame([(i, t, langs.get(i)) for i, t in texts.items()], "doc_id bigint, text string, lang string")
    compare(docs.collect(), language.identify(docs).collect())
