"""Nulls, empty and long texts, repeats, empty tables and clashing names: one row each, defined results."""

import pytest

import corpus_pipeline
from tests.llm import cases
from tonelab.llm import embeddings, fixity, language, lines, packing, simhash, spans, suffix_tree, templates, tokens

PER_ROW = {
    "suffix_tree": lambda d: suffix_tree.score(d, d),
    "language": language.identify,
    "spans": spans.drop_repeated_spans,
    "lines": lines.drop_repeated_lines,
    "simhash": simhash.near_duplicates,
    "tokens": tokens.count_tokens,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(spark, name):
    docs = cases.documents(spark)
    found = PER_ROW[name](docs).select("doc_id").collect()
    assert sorted(str(r[0]) for r in found) == sorted(str(r[0]) for r in cases.ROWS)
    assert PER_ROW[name](docs.limit(0)).count() == 0


def test_defined_values(spark):
    docs = cases.documents(spark)
    named = {r["doc_id"]: r for r in language.identify(docs).where("doc_id IS NOT NULL").collect()}
    assert [named[i]["lang_pred"] for i in (5, 6, 7)] == ["und"] * 3 and named[5]["score"] == 0
    counted = {r["doc_id"]: r for r in tokens.count_tokens(docs).where("doc_id IS NOT NULL").collect()}
    assert (counted[5]["n_pretokens"], counted[6]["n_tokens"], counted[9]["n_pretokens"]) == (0, 0, 30000)
    near = simhash.near_duplicates(docs).collect()
    zero = [r for r in near if r["fp"] == 0]
    assert {r["component_id"] for r in zero} == {5} and sum(r["kept"] for r in zero) == 1 and len(zero) == 3
    copies = [r for r in near if r["component_id"] == 1]
    assert len(copies) >= 3 and sum(r["kept"] for r in copies) == 1
    scored = suffix_tree.score(docs, docs).collect()
    assert all(r["n_tokens"] >= 1 and r["n_known"] == r["n_tokens"] for r in scored)
    assert all(r["score"] == 0 for r in suffix_tree.score(docs, docs.limit(0)).collect())


def test_lines_with_repeated_and_null_ids(spark):
    got = lines.drop_repeated_lines(cases.documents(spark)).collect()
    whole = [r for r in got if r["text"] == cases.TEXT]
    assert len(whole) == 1 and whole[0]["doc_id"] == 1
    near = next(r for r in got if r["doc_id"] == 11)
    assert near["text"] == "" and near["n_removed"] == 1  # one character less than an earlier line
    assert [r["key"] for r in got] == ["k"] * len(got)
    assert next(r for r in got if r["doc_id"] == 6)["text"] == " \t\n\n "


def test_pack_keeps_every_id(spark):
    docs = cases.documents(spark)
    pieces = packing.pack(docs).collect()
    held = sum(r["length"] for r in pieces)
    whole = {(r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0}
    assert held >= 30000 and (5, 1) in whole
    assert sum(r["start"] == 0 for r in pieces) == len(cases.ROWS)
    assert packing.pack(docs.limit(0)).count() == 0


def test_contamination(spark):
    docs = cases.documents(spark)
    asked = spark.createDataFrame([(1, cases.TEXT), (1, cases.TEXT), (2, None), (3, ""), (None, "one two")], "item_id bigint, text string")
    found = templates.contaminated(docs, asked).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "2", "None"] and {r["item_id"] for r in found} == {1}
    assert templates.contaminated(docs, asked.limit(0)).count() == 0 and templates.contaminated(docs.limit(0), asked).count() == 0


def test_embeddings(spark):
    nan, big = float("nan"), 1e300
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, []),
        (8, [1.0, 0.0, 0.0]), (None, [0.99, 0.1]), (9, [-1.0, 0.0]), (10, [big, 0.0]),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, id string, v int")
    got = embeddings.near_duplicates(table).collect()
    assert len(got) == len(rows)
    linked = [r for r in got if r["component_id"] == 1]
    assert len(linked) == 5 and all(r["n_links"] == 4 for r in linked)
    alone = {r["vec_id"]: r for r in got if r["component_id"] != 1}
    assert set(alone) == {3, 4, 5, 6, 7, 8, 9} and all(r["n_links"] == 0 and r["kept"] for r in alone.values())
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_fixity(spark):
    columns = "archive string, offset bigint, length bigint, digest string, page_id bigint, node string"
    ours = [("a", 0, 5, "x", 1, "n"), ("a", 0, 5, "x", 1, "n"), ("a", 5, 5, "y", 2, "n"), ("a", 1 << 40, 5, "z", 3, "n"), (None, 1, 1, "q", 4, "n")]
    theirs = [("a", 0, 5, "x", 1, "n"), ("a", 5, 5, "Y", 2, "n"), ("b", 7, 5, "e", 9, "n"), (None, 1, 1, "r", 4, "n")]
    a, b = spark.createDataFrame(ours, columns), spark.createDataFrame(theirs, columns)
    got = {(r["archive"], r["offset"], r["kind"], r["page_id"]) for r in fixity.audit(a, b, "page_id").collect()}
    assert got == {("a", 5, "changed", 2), ("a", 1 << 40, "missing", 3), ("b", 7, "extra", 9)}
    assert fixity.audit(a, a, "page_id").count() == 0 and fixity.audit(a.limit(0), b.limit(0), "page_id").count() == 0
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (None, None, None), (2000, "u", "")], "page_id bigint, url string, html string")
    named = pages.select("page_id", fixity.warc_record(pages.page_id, pages.url, pages.html).alias("record"))
    placed = fixity.layout(named, "page_id", "record").collect()
    assert len(placed) == 4 and len({(r["archive"], r["offset"]) for r in placed}) == 4


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages(spark, tmp_path, stage):
    cases.plain(spark, {1: cases.TEXT}).selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = cases.documents(spark)
    got = stage[1](spark, docs, str(tmp_path))
    assert stage[0] == "packing" or got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    expected = {
        "language_id": [1, 2, 2, 8, 9, 10, 11, None], "line_dedup": [1, 5, 6, 7, 8, 9, 10, None],
        "simhash_near_dedup": [1, 5, 7, 8, 9, 10, 11, None], "benchmark_decontamination": [5, 6, 7, 8, 9, 10, 11, None],
    }.get(stage[0])
    assert expected is None or sorted(kept, key=str) == sorted(expected, key=str)
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0
