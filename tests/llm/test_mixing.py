"""op13: targets, order and slots by plain search; accounts of hot and odd tables."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tonelab.llm import mixing, order


def water(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    wanted, above = share * sum(sizes.values()), set()
    while True:
        left = wanted - sum(repeats * sizes[s] for s in above)
        rest = sum(w for s, w in weight.items() if s not in above)
        part = {s: repeats * sizes[s] if s in above else left * weight[s] / rest for s in names}
        more = {s for s in names if part[s] > repeats * sizes[s]}
        if not more:
            return names, part
        above |= more


def brute(docs, block):
    """``taken`` by position, and the mix as a list of (slot, place, offset, doc, start, length)."""
    size = lambda t: len((t or "").split())
    sizes = collections.Counter()
    for d, (t, s) in docs.items():
        sizes[s] += size(t)
    names, target = water(sizes)
    rank = {d: i for i, d in enumerate(sorted(docs))}
    quota = {s: int(np.floor(target[s] + 0.5)) for s in names}
    slots = -(-sum(quota.values()) // block)
    total, upto, bounds = sum(quota.values()), 0, []
    for s in names:
        bounds.append((round(upto / total * 2**32), round(upto / total * 2**32 + quota[s] / total * 2**32), s))
        upto += quota[s]
    given = collections.defaultdict(list)
    for i in range(slots):
        p = i * mixing.STEP % 2**32
        given[next((s for a, b, s in bounds if a <= p < b), names[-1])].append(i)
    out, taken, end = [], collections.Counter(), max(map(max, given.values()), default=-1) + 1
    for place, s in enumerate(names):
        own = sorted((d for d in docs if docs[d][1] == s), key=lambda d: hashlib.md5(f"42:{rank[d]}".encode()).hexdigest())
        words = [(d, i) for d in own for i in range(size(docs[d][0]))] * 2
        for turn in range(-(-quota[s] // block)):
            slot = given[s][turn] if turn < len(given[s]) else end + turn
            for offset, (d, i) in enumerate(words[: quota[s]][turn * block : (turn + 1) * block]):
                out.append((slot, place, offset, d, i))
                taken[d] += 1
    return out, taken, sizes, target


def sample(rng, n):
    names = ["b", "a", "c", None, "é", "big"]
    return {int(d): (" ".join(["w"] * int(rng.integers(0, 30))), names[i % 6] if i % 3 else "big") for i, d in enumerate(rng.permutation(n) * 7)}


@pytest.mark.parametrize("block, window", [(16, 1024), (7, 4)])
def test_mix(spark, block, window, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW", window)  # a window for all, and several levels of windows
    docs = sample(np.random.default_rng(8), 400)
    table = spark.createDataFrame([(d, t, s) for d, (t, s) in docs.items()], "doc_id bigint, text string, source string")
    mixed, accounts = mixing.mix(table, block=block)
    want, taken, sizes, target = brute(docs, block)
    spans = mixed.collect()
    got = [(r["slot"], r["place"], r["offset"] + i, r["doc_id"], r["start"] + i) for r in spans for i in range(r["length"])]
    assert sorted(got) == sorted(want)
    for r in accounts.collect():
        t, s = docs[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (len(t.split()), sizes[s], taken[r["doc_id"]])
        assert r["target"] == pytest.approx(target[s], rel=1e-12) and r["taken"] <= 2 * r["size"]


def test_schedule_keeps_shares_everywhere(spark):
    """Each run of slots from the start holds a source within a few slots of its share."""
    shares = [0.6, 0.25, 0.1, 0.05]
    table = spark.createDataFrame([(i, s, float(sum(shares[:i]))) for i, s in enumerate(shares)], "place bigint, share double, upto double")
    got = mixing.schedule(table, 4, 20000).toPandas().sort_values("slot")
    assert len(got) == 20000
    for i, s in enumerate(shares):
        held = np.cumsum(got["place"] == i)
        assert np.abs(held - s * np.arange(1, 20001)).max() < 5
        assert got.loc[got["place"] == i, "turn"].tolist() == list(range(int(held.iloc[-1])))


def test_running_totals_of_a_hot_group(spark):
    rng = np.random.default_rng(9)
    rows = [("hot" if i % 3 else None, f"{i:04x}", int(v)) for i, v in enumerate(rng.integers(0, 9, 6000))]
    table = spark.createDataFrame(rows, "g string, h string, v int")
    for digits in (0, 1, 4):
        got = {r["h"]: r["t"] for r in order.before(table, ["g"], "h", F.col("v"), digits, "t").collect()}
        upto = collections.Counter()
        for g, h, v in rows:
            assert got[h] == upto[g]
            upto[g] += v
    ranks = order.ranked(table, ["g"], ["v", "h"]).collect()
    for g in ("hot", None):
        own = sorted((r["v"], r["h"], r["rank"]) for r in ranks if r["g"] == g)
        assert [r[2] for r in own] == list(range(len(own)))


def test_edge_rows(spark):
    docs = cases.documents(spark).withColumn("source", F.when(F.col("doc_id") < 8, "s")).withColumns({"place": F.lit("x"), "size": F.lit("y")})
    mixed, accounts = mixing.mix(docs)
    got = accounts.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in cases.ROWS)
    total = sum(len((r[1] or "").split()) for r in cases.ROWS)
    assert sum(r["size"] for r in got) == total
    per = {r["source_size"]: r["target"] for r in got}
    taken = collections.Counter()
    for r in got:
        taken[r["source_size"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in per.items()) and sum(per.values()) == pytest.approx(1.5 * total)
    empty = mixing.mix(docs.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0
    nothing = mixing.mix(docs.withColumn("text", F.lit(" ")))[1].collect()
    assert len(nothing) == len(cases.ROWS) and all((r["taken"], r["target"]) == (0, 0) for r in nothing)


def test_layout_does_not_matter(spark):
    rows = [(i % 5 if i % 4 else None, f"w {i % 9} " * (i % 9), ["x", None][i % 2]) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    narrow = lambda d: sorted(map(str, (tuple(r)[1:] for r in mixing.mix(d, block=8)[1].collect())))
    assert narrow(table) == narrow(table.repartition(7, "text"))
