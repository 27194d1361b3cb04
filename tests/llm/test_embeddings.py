"""Many small tiles against all pairs, and what their comparison writes."""

import numpy as np
import pytest

from tests.llm import cases
from tonelab.llm import embeddings, rows

WIDTH = 12


def table(spark, kind):
    """Fresh vectors, near copies, a group whose vectors are all linked, copies, and shorter vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(420, WIDTH))
    x[100:150] = x[:50] + 0.12 * rng.normal(size=(50, WIDTH))
    x[200:360] = x[200] + 0.05 * rng.normal(size=(160, WIDTH))
    x[400:410] = x[390:400]
    listed = [(i, x[i, : WIDTH - 3 * (i % 20 == 7)].astype(np.float32 if kind == "float" else float).tolist()) for i in range(len(x))]
    return spark.createDataFrame(listed, f"vec_id bigint, embedding array<{kind}>"), dict(listed)


def seen(monkeypatch):
    """The plan and the rows of each table that is written, by its name."""
    found, written = {}, rows.written

    def kept(df, name, **options):
        found[name] = df._jdf.queryExecution().executedPlan().toString(), written(df, name, **options)
        return found[name][1]

    monkeypatch.setattr(rows, "written", kept)
    return found


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_pairs(spark, kind):
    vectors, listed = table(spark, kind)
    ids = sorted(listed)

    def linked(a, b):
        x, y = np.array(listed[a]), np.array(listed[b])
        return len(x) == len(y) and x @ y >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y)

    links = {a: sum(linked(a, b) for b in ids if a != b) for a in ids}
    assert max(links.values()) > 140 and sum(n == 1 for n in links.values()) > 20
    group = cases.groups(ids, linked)
    for tile in (16, embeddings.TILE):
        got = embeddings.near_duplicates(vectors, tile=tile).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], group[i]) for i in ids}


def test_pairs_of_tiles_are_not_shuffled(spark, monkeypatch):
    """Vectors that are sent once for each partner tile fill the disks with the square of the table."""
    found = seen(monkeypatch)
    embeddings.near_duplicates(table(spark, "float")[0], tile=16)
    plan, _ = found["pairs"]
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_rows_of_links_are_bounded(spark, monkeypatch):
    """A vector of a large group has a row for each task that meets it, not for each tile with links."""
    found = seen(monkeypatch)
    monkeypatch.setattr(embeddings, "PIECES", 4, raising=False)
    embeddings.near_duplicates(table(spark, "float")[0], tile=16)
    counts = [r["count"] for r in found["pairs"][1].groupBy("u").count().collect()]
    assert len(counts) > 200 and max(counts) <= 2 * 4


def test_vectors_are_kept_once(spark, monkeypatch):
    """Tables that hold the vectors go as soon as the next one is written, and single precision stays so."""
    found = seen(monkeypatch)
    assert embeddings.near_duplicates(table(spark, "float")[0], tile=16).count() == 420
    assert found["classes"][1].selectExpr("max(octet_length(v))").first()[0] == 4 * WIDTH
    for name in ("vectors", "tiles"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
            found[name][1].count()
