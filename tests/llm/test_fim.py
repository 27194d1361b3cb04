"""op11 against a plain cutter: units by pattern, parts by slices, texts rebuilt."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from tonelab.llm import fim
from tonelab.llm.wavelet import WaveletMatrix

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


def found(docs, **kwargs):
    done = fim.fill_in_middle(docs, **kwargs).withColumn("back", fim.restored(F.col("fim_text"), F.col("form")))
    return done.select("doc_id", "text", "n_units", "form", "prefix_chars", "middle_chars", "fim_text", "back").collect()


def test_wavelet_ranks():
    rng = np.random.default_rng(6)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 3)
        at = np.arange(size + 1)
        for c in range(8):
            assert (matrix.rank(c, at) == np.append(0, np.cumsum(symbols == c))).all()
        for c in range(4):
            assert (matrix.rank(c, at, 2) == np.append(0, np.cumsum(symbols >> 1 == c))).all()


TEXTS = st.lists(st.text(st.sampled_from("ab ß中\U0001f600\t\n\x0b\x0c\r\x1c\x85 <S>"), max_size=30), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_every_unit_ends_where_the_pattern_says(texts):
    raw = [t.encode() for t in texts]
    cuts = np.cumsum([0, *map(len, raw)])
    units = fim.Units(np.frombuffer(b"".join(raw), np.uint8), cuts)
    split = [UNIT.findall(t) for t in texts]
    assert units.n.tolist() == [len(u) for u in split]
    for k in range(max(map(len, split)) + 1):
        ends = units.ends(np.minimum(k, units.n))
        assert (ends - units.start).tolist() == [len("".join(u[:k]).encode()) for u in split]
        assert units.characters(units.start, ends).tolist() == [len("".join(u[:k])) for u in split]


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_rows(spark, rate, spm):
    rng = np.random.default_rng(7)
    texts = {i: "".join(rng.choice([*"ab <", "\n", "ß", "中", "\t ", "<P", "M>"], rng.integers(0, 60))) for i in range(300)}
    texts |= {300: None, 301: "", 302: " \n ", 303: "a <P> b", 304: "<M>", 305: "<<S", 306: "wort " * 50000, 307: "x" * 3_000_000}
    for r in found(cases.plain(spark, texts), rate=rate, spm=spm):
        want = brute(r["doc_id"], texts[r["doc_id"]], rate, spm)
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) == want
        assert r["back"] == (texts[r["doc_id"]] or "")


def test_slices_do_not_matter(spark, monkeypatch):
    texts = {i: f"word {i} " * i for i in range(40)}
    want = sorted(found(cases.plain(spark, texts)))
    monkeypatch.setattr(fim, "SLICE", 16)
    raw = [t.encode() for t in texts.values()]
    import pyarrow as pa

    draws = pa.array([7 * i for i in texts]), pa.array([13 * i for i in texts])
    small = fim._cut(pa.array(raw), *draws)
    monkeypatch.setattr(fim, "SLICE", 1 << 20)
    assert small.equals(fim._cut(pa.array(raw), *draws)) and len(want) == 40
    assert fim._cut(pa.array(raw)[5:9], *(d[5:9] for d in draws)).equals(small[5:9])
    assert len(fim._cut(pa.array([], pa.binary()), draws[0][:0], draws[1][:0])) == 0


def test_edge_rows(spark):
    docs = cases.documents(spark).withColumn("form", F.lit("x")).withColumn("n_units", F.lit("y"))
    done = fim.fill_in_middle(docs)
    assert done.columns == [*[c for c in docs.columns if c not in ("form", "n_units")], "fim_text", "form", "n_units", "prefix_chars", "middle_chars"]
    got = found(docs)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in cases.ROWS)
    for r in got:
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert found(docs.limit(0)) == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, marks=("<<", "<S>", "<M>"))
