"""op12: digests, proofs and folded roots against a plain tree."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tonelab.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fan_out=8):
    """Levels of a tree over digests, and the siblings (before, after) of each leaf per level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p // fan_out * fan_out
            paths[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + fan_out])))
        nodes = [h(*nodes[i : i + fan_out]) for i in range(0, len(nodes), fan_out)]
        at = [p // fan_out for p in at]
    return nodes[0], paths


def brute(docs, fan_out=8):
    """Per row: (key, leaf, subroot, root, path)."""
    trees = {}
    for r in docs:
        trees.setdefault(r["lang"], []).append((r["doc_id"], h(*[field(r[f]) for f in manifest.FIELDS])))
    order = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    subroots, found = [], []
    for lang in order:
        own = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subroot, paths = climb([d for _, d in own], fan_out)
        subroots.append(subroot)
        found.append([(k, d, subroot, p) for (k, d), p in zip(own, paths, strict=True)])
    root, above = climb(subroots, fan_out)
    return [(k, d, s, root, [*p, *above[i]]) for i, own in enumerate(found) for k, d, s, p in own]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


def rows_of(n, langs, rng):
    return [(int(i), None if i % 7 == 0 else f"s{i % 3}", langs[int(rng.integers(len(langs)))], None if i % 11 == 0 else int(i), f"Tëxt {i % 4}" * int(i % 3)) for i in range(n)]


@pytest.mark.parametrize("n, langs, fan_out", [(1, ["en"], 8), (9, ["en", None], 8), (700, ["en", None, "de", "é", "z"], 8), (60, [f"l{i}" for i in range(30)], 3)])
def test_proofs(spark, n, langs, fan_out):
    docs = table(spark, rows_of(n, langs, np.random.default_rng(n)))
    want = brute([r.asDict() for r in docs.collect()], fan_out)
    m = manifest.build(docs, fan_out=fan_out)
    found = manifest.prove(m)
    got = found.withColumns({"proof": manifest.proof(F.col("path")), "folded": manifest.fold(F.col("leaf"), F.col("path"))}).collect()
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in got) == sorted(want)
    assert all(r["folded"] == r["root"] == m.root for r in got)
    assert {r["doc_id"]: r["proof"] for r in got} == {k: h(*[x for s in p for x in s]) for k, _, _, _, p in want}


def test_some_leaves_and_damage(spark):
    docs = table(spark, rows_of(300, ["en", "de"], np.random.default_rng(3)))
    m = manifest.build(docs)
    every = {r["doc_id"]: r for r in manifest.prove(m).collect()}
    wanted = m.leaves.where("rank % 50 = 9").select("tree", "rank")
    some = manifest.prove(m, wanted).collect()
    assert len(some) == wanted.count() > 2 and all(r == every[r["doc_id"]] for r in some)
    hurt = manifest.fold(F.lit(h("other")), F.col("path")) == F.col("root")
    assert manifest.prove(m, wanted).where(hurt).count() == 0


def test_edge_rows(spark):
    docs = cases.documents(spark).withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint"), "tree": F.lit("x"), "leaf": F.lit(1)})
    want = brute([r.asDict() for r in docs.collect()])
    m = manifest.build(docs)
    got = manifest.prove(m).withColumn("folded", manifest.fold(F.col("leaf"), F.col("path"))).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted((key((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]])) for r in got)) == sorted(map(key, want))
    assert all(r["folded"] == r["root"] for r in got)
    empty = manifest.build(docs.limit(0))
    assert empty.root is None and manifest.prove(empty).count() == 0


def test_equal_rows_share_records(spark):
    docs = table(spark, [(1, "s", "en", 4, "same")] * 200 + [(i, "s", "en", 4, "own") for i in range(2, 60)])
    m = manifest.build(docs)
    assert m.nodes[0].count() < 15  # 33 runs, of which 25 are equal
    want = brute([r.asDict() for r in docs.collect()])
    got = manifest.prove(m).collect()
    assert sorted((r["doc_id"], r["leaf"], [tuple(s) for s in r["path"]]) for r in got) == sorted((k, d, p) for k, d, _, _, p in want)
