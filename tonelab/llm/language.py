"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its letters'
vectors, each rotated by its place; a text is the sum of its n-grams, a language the sum of
its texts. The language whose vector has the largest cosine with the text's is predicted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.llm import rows

DIM = 1024
GRAM = 3
SEED = 20
UNKNOWN = "und"
SPACE = 32
#: Characters whose n-grams are counted at once, texts whose vectors are summed at once.
CHARS, TEXTS = 1 << 20, 64
#: n-grams whose vectors are held at once; n-gram counts of a task before they are passed on.
GRAMS, HELD = 1 << 11, 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for everything that is no letter."""
    out = np.full(0x110000, SPACE, np.int32)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return out


@functools.lru_cache(1 << 15)
def _letter_vector(code: int, dim: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, dim, np.int8) * 2 - 1).astype(np.int8)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams (21 bits a place) and their counts; no letter: none.

    Runs of other characters count as one blank; a blank is put before and after the text.
    """
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return found, counts
    left = np.array([SPACE], np.int64)
    for at in range(0, len(text), CHARS):
        last = at + CHARS >= len(text)
        part = np.frombuffer(text[at : at + CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([left, _letters()[part], np.full(int(last), SPACE)])
        codes = codes[np.concatenate([[True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)])]
        left = codes[1 - GRAM :]
        if len(codes) < GRAM:
            left = codes
            continue
        keys = functools.reduce(lambda a, i: (a << 21) | codes[i : len(codes) - GRAM + 1 + i], range(1, GRAM), codes[: len(codes) - GRAM + 1])
        new, n = np.unique(keys, return_counts=True)
        found, counts = _merged([found, new], [counts, n]) if len(found) else (new, n)
    return found, counts


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


def gram_vectors(keys: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of n-grams: letters rotated by their place and multiplied."""
    out = None
    for place in range(GRAM):
        codes, at = np.unique((keys >> (21 * place)) & 0x1FFFFF, return_inverse=True)
        letters = np.stack([np.roll(_letter_vector(int(c), dim), place) for c in codes])[at]
        out = letters if out is None else out * letters
    return out


def text_vectors(texts: list[str | None], dim: int) -> np.ndarray:
    """Bundled vector of each text; zero if it has no letter."""
    counted = [grams(t) for t in texts]
    keys, place = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    who = np.repeat(np.arange(len(texts)), [len(k) for k, _ in counted])
    weight = np.concatenate([n for _, n in counted])
    out = np.zeros((len(texts), dim), np.float32)
    for at in range(0, len(keys), GRAMS):
        held = (place >= at) & (place < at + GRAMS)
        dense = np.zeros((len(texts), min(GRAMS, len(keys) - at)), np.float32)
        dense[who[held], place[held] - at] = weight[held]
        out += dense @ gram_vectors(keys[at : at + GRAMS], dim).astype(np.float32)
    return out


def fit(texts: DataFrame, text: str, lang: str, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their vectors, from all rows with a text and a language.

    n-grams are counted per language in tasks and summed in a shuffle; their vectors are
    added up where the counts are, so that one vector per language and task is moved. The
    number of languages is that of the label domain; the model is one vector for each.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pd.DataFrame]:
            for name, parts in held.items():
                keys, counts = _merged([p[0] for p in parts], [p[1] for p in parts])
                yield pd.DataFrame({"lang": name, "gram": keys, "n": counts})

        for b in batches:
            for name, t in zip(b["lang"], b["text"], strict=True):
                parts = held.setdefault(name, [])
                parts.append(grams(t))
                size += len(parts[-1][0])
                if size > HELD:
                    merged = {k: [_merged([p[0] for p in v], [p[1] for p in v])] for k, v in held.items()}
                    held.clear()
                    held.update(merged)
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD // 2:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, g in b.groupby("lang"):
                for at in range(0, len(g), GRAMS):
                    part = g.iloc[at : at + GRAMS]
                    vector = part["n"].to_numpy(float) @ gram_vectors(part["gram"].to_numpy(), dim).astype(float)
                    sums[name] = sums.get(name, 0) + vector
        yield pd.DataFrame({"lang": list(sums), "x": list(sums.values())})

    labelled = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.map_frames(labelled, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = rows.map_frames(counted, bundle, "lang string, x array<double>")
    flat = parts.select("lang", F.posexplode("x").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    with rows.short_batches(texts.sparkSession):
        model = flat.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x")).orderBy("lang").collect()
    vectors = np.array([[p["x"] for p in r["x"]] for r in model]).reshape(len(model), dim)
    return [r["lang"] for r in model], vectors


def predict(texts: DataFrame, text: str, languages: list[str], vectors: np.ndarray) -> DataFrame:
    """``texts`` without ``text``, with ``lang_pred`` and ``score`` (cosine, 0 if negative).

    A null text or one without a letter is ``und`` with score 0, and so is every text if no
    language was learned. Equal cosines: the first language in alphabetical order.
    """
    dim = vectors.shape[1]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = (vectors / np.where(norm, norm, 1)).astype(np.float32)
    others = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            named, scores = [], []
            for at in range(0, len(b), TEXTS):
                x = text_vectors(list(b[text].iloc[at : at + TEXTS]), dim)
                size = np.linalg.norm(x, axis=1)
                cosine = (x @ unit.T) / np.where(size, size, 1)[:, None] if languages else np.zeros((len(x), 1))
                best = cosine.argmax(axis=1)
                known = (size > 0) & bool(languages)
                named += [languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                scores += np.where(known, np.clip(cosine[np.arange(len(x)), best], 0, 1), 0).tolist()
            yield b[others].assign(lang_pred=named, score=scores)

    kinds = dict(texts.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["lang_pred string", "score double"])
    return rows.map_frames(texts.select(*others, text), run, schema)


def fold(key: str, folds: int, which: int) -> Column:
    """Whether the CRC-32 of the key as text has this remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == which, F.lit(False))


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", dim: int = DIM, also: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: ``key``, columns ``also``, ``held_out``, ``lang_pred``, ``score``.

    The model is learned from the rows with a text and a language whose key's CRC-32 does
    not leave 2 on division by 4 (rows with a null key teach nothing); prediction reads the
    text alone. Repeated rows are rows of their own; an empty table gives none. Very long texts
    are read whole, in blocks. Equal cosines: the first language in alphabetical order. Other
    columns are ignored.
    """
    held = fold(key, 4, 2)
    languages, vectors = fit(docs.where(~held & F.col(key).isNotNull()), text, lang, dim)
    return predict(docs.select(key, *also, held.alias("held_out"), text), text, languages, vectors)
