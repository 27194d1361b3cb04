"""What the suffix tree sends and keeps: words as ranks, no second copy of the n-grams, no finished shuffles."""

import numpy as np

from tests.llm import cases
from tonelab.llm import rows, suffix_tree
from tonelab.sources import scratch


def test_code():
    rng = np.random.default_rng(3)
    known = rng.integers(1, 1 << 63, 100_000).astype(np.uint64)
    code = suffix_tree.Code(known)
    for k in (1, 2, 3):
        words = known[rng.integers(0, 300, (4000, k + 1)) ** 2]
        words[::7, 0] = rng.integers(1, 1 << 63, len(words[::7])).astype(np.uint64)
        n = np.where(np.arange(4000) % 50, 3, 1 << 40)
        first, more, to = code.write(code.rank(words.ravel()).reshape(words.shape), words, n)
        assert to[0] == 0 and to[-1] == len(more) and first.nbytes + more.nbytes < 5 * words.size  # eight bytes a word before
        got, counts = code.read(k, first.tobytes(), more.tobytes())
        assert (got.T == words).all() and (counts == n).all()
        part = slice(1000, 3000)
        got, counts = code.read(k, first[part].tobytes(), more[to[1000] : to[3000]].tobytes())
        assert (got.T == words[part]).all() and (counts == n[part]).all()
    none = suffix_tree.Code(known[:0])
    first, more, _ = none.write(none.rank(known[:2])[None], known[:2][None], np.array([255]))
    assert (none.read(1, first.tobytes(), more.tobytes())[0].T == known[:2]).all()


def test_what_is_written(spark, monkeypatch):
    names, written, removed, remove = [], rows.written, [], scratch.remove
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)

    def note(df, name):
        names.append((name, spark.conf.get(setting)))
        return written(df, name)

    monkeypatch.setattr(rows, "written", note)
    monkeypatch.setattr(scratch, "remove", lambda spark, path: (removed.append(path), remove(spark, path)))
    texts = cases.plain(spark, {i: "a b c d e f g " * 20 for i in range(8)})
    found = suffix_tree.score(texts, texts, min_context=20, head=4).collect()
    assert len(found) == 8 and len({round(r["score"], 6) for r in found}) == 1
    assert len(removed) == 1 and "/model-" in removed[0] and [name for name, _ in names][-1] == "terms"
    assert "scored" not in dict(names) and {on for _, on in names} == {"true"} and spark.conf.get(setting) == before


def test_sums_are_laid_out_short(spark):
    for numbers in ([0, 0], [1, 255], [0, 256], [3, 1 << 16], [1 << 33, 0]):
        data = suffix_tree._laid_out(np.array(numbers))
        assert suffix_tree._numbers(data, 2).tolist() == numbers
    assert suffix_tree._laid_out(np.zeros(3)) is None and len(suffix_tree._laid_out(np.arange(256))) == 256
    assert suffix_tree._doubles(suffix_tree._laid_out(np.array([0.5, -2.0])), 2).tolist() == [0.5, -2.0]
    # Texts that stand first, last and alone in a batch, with no term held by tasks and all.
    texts = cases.plain(spark, {i: ["", None, "a b c d " * 30, "x"][i % 4] for i in range(40)})
    one, all_ = ({r["doc_id"]: r for r in suffix_tree.score(texts, texts, min_context=20, head=h).collect()} for h in (0, 1 << 20))
    for i, r in one.items():
        assert r[:4] == all_[i][:4] and np.allclose(r[4:], all_[i][4:], rtol=1e-12), i


def test_filters_are_destroyed(spark, monkeypatch):
    gone, kind = [], type(spark.sparkContext.broadcast(0))
    destroy = kind.destroy
    monkeypatch.setattr(kind, "destroy", lambda self, *a: (gone.append(self), destroy(self, *a)))
    texts = cases.plain(spark, {i: "a b c d e f g " * 20 for i in range(8)})
    assert suffix_tree.score(texts, texts, min_context=20).count() == 8 and len(gone) == 5  # none before
