"""The count model against a plain Python version."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonelab.operators import naive_bayes
from tonelab.operators.naive_bayes import Candidate, Fit

ROWS = [
    ("a", "good good room", 1, "train"),
    ("b", "bad room", 0, "train"),
    ("c", "good stay", 1, "train"),
    ("d", "bad bad bad view now", 0, "val"),
    ("e", "Good unseen", 1, "test"),
    ("f", "", 0, "test"),
    ("g", "nothing known here", 1, "test"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "row_key string, text string, label int, role string")


def plain(train, texts, alpha=1.0, weight=1.0, limit=None):
    """Log odds of two classes against the first, from word lists."""
    words = {k: t.lower().split()[:limit] for k, t in texts.items()}
    counts = {c: Counter(w for k, y in train.items() if y == c for w in words[k]) for c in (0, 1)}
    vocabulary = set(counts[0]) | set(counts[1])
    n = len(train)
    out = {}
    for key, ws in words.items():
        logits = []
        for c in (0, 1):
            total = sum(counts[c].values()) + alpha * len(vocabulary)
            prior = weight * math.log((sum(y == c for y in train.values()) + 1) / (n + 2))
            logits.append(prior + sum(math.log((counts[c][w] + alpha) / total) for w in ws if w in vocabulary))
        out[key] = [0.0, logits[1] - logits[0]]
    return out


def scored(df, model, candidates, **kwargs):
    rows = naive_bayes.score(df, model, candidates, **kwargs).collect()
    return {m.name: {r["row_key"]: r[f"logits_{m.name}"] for r in rows} for m in candidates}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=2e-6)


FITS = [Fit("main", "role = 'train'"), Fit("all", "true"), Fit("two_words", "role <> 'test'", 2)]
CANDIDATES = [
    Candidate("add_one", "main"),
    Candidate("light", "main", 0.1, 0.5),
    Candidate("all", "all"),
    Candidate("short", "two_words", 0.3),
]


def expected():
    texts = {k: t for k, t, _, _ in ROWS}
    main = {k: y for k, _, y, r in ROWS if r == "train"}
    every = {k: y for k, _, y, _ in ROWS}
    seen = {k: y for k, _, y, r in ROWS if r != "test"}
    return {
        "add_one": plain(main, texts),
        "light": plain(main, texts, 0.1, 0.5),
        "all": plain(every, texts),
        "short": plain(seen, texts, 0.3, limit=2),
    }


def test_many_fits_in_one_job(rows):
    model = naive_bayes.fit(rows, FITS, (0, 1))
    assert model.documents == {"main": {0: 1, 1: 2}, "all": {0: 3, 1: 4}, "two_words": {0: 2, 1: 2}}
    assert model.vocabulary["main"] == 4
    got = scored(rows, model, CANDIDATES)
    for name, logits in expected().items():
        same(got[name], logits)


def test_large_vocabulary_route_gives_the_same(rows):
    model = naive_bayes.fit(rows, FITS, (0, 1))
    small = scored(rows, model, CANDIDATES)
    for budget in (0, 300, 500):
        assert scored(rows, model, CANDIDATES, broadcast_bytes=budget) == small


def test_scores_do_not_depend_on_partitioning(rows):
    model = naive_bayes.fit(rows.repartition(5), FITS, (0, 1))
    other = naive_bayes.fit(rows.coalesce(1), FITS, (0, 1))
    assert scored(rows.repartition(7), model, CANDIDATES) == scored(rows.coalesce(1), other, CANDIDATES)


def test_carried_columns_and_prior_only_rows(rows):
    model = naive_bayes.fit(rows, FITS[:1], (0, 1))
    out = naive_bayes.score(rows, model, CANDIDATES[:1], carry=["label", "role"])
    assert out.columns == ["row_key", "label", "role", "logits_add_one"]
    by_key = {r["row_key"]: r for r in out.collect()}
    assert len(by_key) == len(ROWS)
    prior = [0.0, math.log(3 / 5) - math.log(2 / 5)]
    assert by_key["f"]["logits_add_one"] == pytest.approx(prior, abs=1e-6)
    assert by_key["g"]["logits_add_one"] == pytest.approx(prior, abs=1e-6)


def test_log_probabilities_sum_to_one(rows):
    model = naive_bayes.fit(rows, FITS, (0, 1))
    table = naive_bayes.log_probabilities(model, CANDIDATES)
    sums = table.groupBy("model", "label").agg(F.sum(F.exp("log_prob")).alias("s")).collect()
    assert len(sums) == 8
    assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_save_and_load(rows, tmp_path):
    model = naive_bayes.fit(rows, FITS, (0, 1))
    naive_bayes.save(model, str(tmp_path / "model"))
    again = naive_bayes.load(rows.sparkSession, str(tmp_path / "model"))
    assert (again.documents, again.tokens, again.vocabulary, again.limits) == (
        model.documents,
        model.tokens,
        model.vocabulary,
        model.limits,
    )
    assert scored(rows, again, CANDIDATES) == scored(rows, model, CANDIDATES)


def test_hot_token_and_long_text(spark):
    """One word is nearly the whole corpus; one text is far longer than the rest."""
    data = [(f"r{i}", "the " * 50 + f"word{i}", i % 2, "train") for i in range(200)]
    data.append(("long", "the " * 20000 + "word1 end", 1, "train"))
    df = spark.createDataFrame(data, "row_key string, text string, label int, role string")
    model = naive_bayes.fit(df, FITS[:1], (0, 1))
    assert sum(model.tokens["main"].values()) == 200 * 51 + 20002
    wide = scored(df, model, CANDIDATES[:1])
    assert scored(df, model, CANDIDATES[:1], broadcast_bytes=1050) == wide
    # Weights are cut at nine decimals, so twenty thousand of them may differ by 1e-5.
    reference = plain({k: y for k, _, y, _ in data}, {k: t for k, t, _, _ in data})
    assert wide["add_one"]["long"] == pytest.approx(reference["long"], abs=5e-5)
    assert wide["add_one"]["r7"] == pytest.approx(reference["r7"], abs=2e-6)


def test_hot_unknown_and_overlong_tokens(spark):
    """Tokens that no training row has, and tokens of any length, on the large route."""
    junk = "x" * 5000
    data = [(f"t{i}", f"known{i % 3} plain", i % 2, "train") for i in range(30)]
    data += [(f"u{i}", "flood " * 40 + junk + f" known{i % 3}", i % 2, "test") for i in range(60)]
    df = spark.createDataFrame(data, "row_key string, text string, label int, role string")
    model = naive_bayes.fit(df, FITS[:1], (0, 1))
    assert model.vocabulary["main"] == 4
    frequent = model.counts.filter(f"n_total * 10 >= {model.n_tokens}").collect()
    assert {r["token"] for r in frequent} == {"flood"}
    assert naive_bayes._head_share(1050, CANDIDATES[:1], (0, 1)) == 10
    small = scored(df, model, CANDIDATES[:1])
    assert scored(df, model, CANDIDATES[:1], broadcast_bytes=1050) == small
    train = {k: y for k, _, y, r in data if r == "train"}
    same(small["add_one"], plain(train, {k: t for k, t, _, _ in data}))


def test_broadcast_words_fill_the_budget(rows):
    """Words that occur so often fit the measured size, and the next power of two down would not."""
    model = naive_bayes.fit(rows, FITS[:1], (0, 1))
    sizes = [(r["n_total"], len(r["token"].encode()) + naive_bayes._row_bytes(CANDIDATES[:1], (0, 1))) for r in model.counts.collect()]
    for budget in (0, 60, 150, 400, 10_000):
        least = naive_bayes._least_held(model, CANDIDATES[:1], budget)
        assert sum(size for n, size in sizes if n >= least) <= budget
        assert least == 1 or sum(size for n, size in sizes if n >= least // 2) > budget
