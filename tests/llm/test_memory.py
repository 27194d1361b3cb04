"""What a Python worker is sent at once and keeps, in the steps of the pipeline that read texts."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.accumulators import AccumulatorParam

import corpus_pipeline
from tests.conftest import SMALL
from tonelab.llm import language, packing, rows, simhash

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
STEPS = {
    "language_id": lambda spark, docs: language.fit(docs, "text", "lang"),
    "simhash_near_dedup": lambda spark, docs: simhash.near_duplicates(docs),
    "benchmark_decontamination": lambda spark, docs: corpus_pipeline.decontaminated(spark, docs, SMALL),
    "packing": lambda spark, docs: packing.pack(docs),
}


class Lists(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return [*a, *b]


@pytest.mark.parametrize("name", sorted(STEPS))
def test_texts_are_sent_in_short_batches(spark, monkeypatch, name):
    """The bytes of each batch with texts that is sent, counted where it arrives."""
    docs = rows.table(spark, SMALL, "documents").coalesce(1)
    most, largest = 1 << 16, spark.sparkContext.accumulator([], Lists())
    longest = max(len((r["text"] or "").encode()) for r in docs.select("text").collect())
    map_in_arrow = type(docs).mapInArrow

    def counted(self, func, schema, *args, **more):
        texts = any(t in ("string", "binary") and c in ("t", "text") for c, t in self.dtypes)

        def run(batches):
            def seen():
                for b in batches:
                    if texts:
                        largest.add([b.nbytes])
                    yield b

            yield from func(seen())

        return map_in_arrow(self, run, schema, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    monkeypatch.setattr(rows, "BATCH_BYTES", most)
    before = spark.conf.get(SETTING)
    STEPS[name](spark, docs)
    read = [n for n in largest.value if n]
    assert len(read) > 1 and sum(read) > 2 * most
    assert max(read) <= most + longest + (1 << 14)
    assert spark.conf.get(SETTING) == before


def test_prediction_is_sent_short_batches(spark, monkeypatch):
    """The language stage writes what it predicts while batches are short."""
    docs = rows.table(spark, SMALL, "documents")
    held, written = {}, rows.written
    monkeypatch.setattr(rows, "written", lambda df, name: (held.setdefault(name, spark.conf.get(SETTING)), written(df, name))[1])
    before = spark.conf.get(SETTING)
    want = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, SMALL).select("doc_id").collect()}
    assert held["gone"] == str(rows.BATCH_BYTES) and spark.conf.get(SETTING) == before
    monkeypatch.setattr(rows, "BATCH_BYTES", 1)  # rows one by one: the same documents
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, SMALL).select("doc_id").collect()} == want


def test_the_setting_comes_back_after_an_error(spark):
    before = spark.conf.get(SETTING)
    with pytest.raises(ZeroDivisionError), rows.short_batches(spark):
        1 / 0
    assert spark.conf.get(SETTING) == before


def test_a_task_loads_one_tokenizer():
    code = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    list(code.encode_all([b"Some words, <|endoftext|> and \xc3\xa9t\xc3\xa9."]))
    assert "tokenizer" not in vars(code)
    assert code.tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids != code.ids("<|endoftext|>").tolist()


def test_a_task_gives_memory_back():
    given = []

    class Pool:
        def release_unused(self):
            given.append(True)

    class Frame:
        def __init__(self):
            self.run = None

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    taken = rows.map_frames(Frame(), lambda frames: frames, "x bigint")
    pool, pa.default_memory_pool = pa.default_memory_pool, Pool
    try:
        out = list(taken.run(iter([pa.RecordBatch.from_pydict({"x": [1, 2]})])))
    finally:
        pa.default_memory_pool = pool
    assert [b.num_rows for b in out] == [2] and given == [True]
