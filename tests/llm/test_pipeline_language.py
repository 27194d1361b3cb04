"""The language stage: rows without a language, and predictions against what is recorded."""

import corpus_pipeline
from tests.conftest import SMALL
from tonelab.llm import rows


def test_no_language_learned(spark, tmp_path):
    texts = [(1, "Clean words.", None), (2, "", None), (3, None, None), (4, "12 + 3", None), (5, "слово", None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    got = corpus_pipeline.known_language(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 5]


def test_prediction_decides(spark, tmp_path):
    """A long English text recorded as German goes; short, unlabelled and rightly labelled texts stay."""
    docs = rows.table(spark, SMALL, "documents")
    long = docs.where("lang = 'en' AND n_chars > 2000").orderBy("doc_id").first()["text"]
    more = [(10**6, long, "de", "s", 1), (10**6 + 1, long, "en", "s", 1), (10**6 + 2, long, None, "s", 1), (10**6 + 3, "Hm.", "de", "s", 1)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = {r["doc_id"] for r in corpus_pipeline.known_language(spark, both, str(tmp_path)).select("doc_id").collect()}
    want = {r["doc_id"] for r in both.select("doc_id").collect()} - {10**6}
    assert got == want
