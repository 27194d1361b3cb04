"""Split sizes, completeness and independence of the layout."""

from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelab.operators import keys, stratified
from tonelab.operators.stratified import fit_cuts, held_out, kfold, nested, train_test, train_val_test


def rows(spark, counts, partitions=3):
    total = [(i, c) for c, n in counts.items() for i in range(n)]
    data = [(f"r{c}-{i}", c) for i, c in total]
    return spark.createDataFrame(data, "row_key string, label int").repartition(partitions)


def sizes(df, column="role"):
    return Counter(r[column] for r in df.select(column).collect())


@pytest.fixture(scope="module")
def reviews(spark):
    return rows(spark, {0: 285, 1: 1340}).persist()


def test_published_sizes(reviews):
    cuts = fit_cuts(reviews, stratified.fold_layouts((1, 3)), (0, 1))
    out = cuts.assign(reviews, {"k1": "k1", "k3": "k3"})
    assert sizes(out, "k1") == {"train": 1040, "val": 260, "test": 325}
    assert sizes(out, "k3") == {"fold1": 434, "fold2": 433, "fold3": 433, "test": 325}
    test = Counter(r["label"] for r in out.filter("k1 = 'test'").collect())
    assert test == {1: 268, 0: 57}
    assert out.filter("(k1 = 'test') <> (k3 = 'test')").count() == 0
    runs = stratified.fold_runs((1, 3))
    assert [run.sizes(cuts) for run in runs] == [
        {"train_n": 1040, "val_n": 260, "test_n": 325},
        {"train_n": 866, "val_n": 434, "test_n": 325},
        {"train_n": 867, "val_n": 433, "test_n": 325},
        {"train_n": 867, "val_n": 433, "test_n": 325},
    ]


def test_sizes_of_all_runs(reviews):
    cuts = fit_cuts(reviews, stratified.fold_layouts(), (0, 1))
    assigned = stratified.role_rows(reviews, cuts, stratified.fold_runs(), ["row_key", "label"])
    got = {(r["K"], r["fold"], r["role"]): r["n"] for r in stratified.split_sizes(assigned).collect()}
    assert got[3, 1, "val"] == 434 and got[3, 2, "train"] == 867 and got[1, 1, "train"] == 1040
    assert sum(got.values()) == 4 * 1625
    vals = assigned.filter("K = 3 AND role = 'val'").groupBy("row_key").count()
    assert vals.count() == 1300 and vals.filter("count > 1").count() == 0


def test_80_10_10(reviews):
    cuts = fit_cuts(reviews, {"s": train_val_test()}, (0, 1))
    assert sizes(cuts.assign(reviews, {"s": "role"})) == {"train": 1300, "val": 162, "test": 163}


def test_does_not_depend_on_layout_or_other_layouts(spark):
    counts = {0: 40, 1: 7, 2: 90}
    a, b = rows(spark, counts, 1), rows(spark, counts, 7)
    alone = fit_cuts(a, {"s": nested()}, (0, 1, 2)).assign(a, {"s": "role"})
    together = fit_cuts(b, {"s": nested(), "t": kfold(5)}, (0, 1, 2), prefix_digits=1).assign(b, {"s": "role"})
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, together.collect()))


def test_equals_a_full_ranking(spark):
    df = rows(spark, {0: 63, 1: 200})
    out = fit_cuts(df, {"s": nested()}, (0, 1)).assign(df, {"s": "role"})
    got = {r["row_key"]: r["role"] for r in out.collect()}
    hashed = df.select("row_key", "label", F.expr(stratified.order_hash("row_key", 42)).alias("h")).collect()
    counts = {0: 63, 1: 200}
    outer = held_out(counts, Fraction(1, 5))
    inner = held_out({c: counts[c] - outer[c] for c in counts}, Fraction(1, 5))
    for c in counts:
        ranked = sorted((r["h"], r["row_key"]) for r in hashed if r["label"] == c)
        for rank, (_, key) in enumerate(ranked):
            role = "test" if rank < outer[c] else "val" if rank < outer[c] + inner[c] else "train"
            assert got[key] == role


def test_empty_class_and_unknown_label(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 9)], "row_key string, label int")
    out = fit_cuts(df, {"s": train_test()}, (0, 1)).assign(df, {"s": "role"})
    got = {r["row_key"]: r["role"] for r in out.collect()}
    assert got["c"] is None and sorted([got["a"], got["b"]]) == ["test", "train"]


def test_copies_of_one_row_get_keys_of_their_own(spark):
    hot = spark.range(9000).select(F.lit(1).alias("id"), F.lit("same").alias("text"), F.lit(1).alias("label"))
    rest = spark.range(1000).select(F.lit(2).alias("id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(0).alias("label"))
    keyed = keys.with_occurrence_key(hot.unionByName(rest), ["id", "text", "label"])
    assert keyed.count() == 10000
    assert keyed.select("row_key").distinct().count() == 10000
    out = fit_cuts(keyed, {"s": train_test()}, (0, 1)).assign(keyed, {"s": "role"})
    assert sizes(out) == {"train": 8000, "test": 2000}


def test_copies_without_own_key_stay_together(spark):
    df = spark.createDataFrame([("same", 0)] * 50 + [(f"k{i}", 0) for i in range(50)], "row_key string, label int")
    out = fit_cuts(df, {"s": train_test()}, (0,)).assign(df, {"s": "role"})
    assert len({r["role"] for r in out.filter("row_key = 'same'").collect()}) == 1
    assert out.filter("role IS NULL").count() == 0


class_counts = st.dictionaries(st.integers(0, 3), st.integers(0, 500), min_size=1, max_size=3)


@settings(max_examples=200, deadline=None)
@given(class_counts, st.integers(1, 9))
def test_held_out_is_exact_and_fair(counts, tenths):
    fraction = Fraction(tenths, 10)
    quota = held_out(counts, fraction)
    n = sum(counts.values())
    total = -(-n * tenths // 10)
    assert sum(quota.values()) == total
    for c, m in counts.items():
        assert 0 <= quota[c] <= m
        if n:
            assert abs(quota[c] - m * total / n) < 1


@settings(max_examples=200, deadline=None)
@given(class_counts, st.integers(2, 7))
def test_folds_are_complete_and_even(counts, k):
    segments = dict(kfold(k)(counts))
    folds = [segments[f"fold{i + 1}"] for i in range(k)]
    for c, n in counts.items():
        parts = [f[c] for f in folds]
        assert sum(parts) + segments["test"][c] == n
        assert max(parts) - min(parts) <= 1
    totals = [sum(f.values()) for f in folds]
    assert max(totals) - min(totals) <= 1


@settings(max_examples=100, deadline=None)
@given(class_counts)
def test_every_layout_uses_every_row(counts):
    for layout in (train_test(), train_val_test(), nested(), kfold(3)):
        segments = layout(counts)
        for c, n in counts.items():
            assert sum(s[c] for _, s in segments) == n
            assert all(s[c] >= 0 for _, s in segments)


def test_occurrence_keys_of_many_repeated_rows(spark, monkeypatch):
    """More repeated digests than may be broadcast: the keys of the other route, without a join of the rows."""
    rows = [(i % 40, f"t{i % 40}", i % 2) for i in range(130)] + [(None, None, None)] * 3 + [(99, "x", 1)] * 20
    table = spark.createDataFrame(rows, "id int, text string, label int").repartition(3)
    monkeypatch.setattr(keys, "CHUNK", 8)
    want = keys.with_occurrence_key(table, table.columns)
    monkeypatch.setattr(keys, "BROADCAST_ROWS", 2)
    got = keys.with_occurrence_key(table, table.columns)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.select("row_key").distinct().count() == len(rows)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
