"""Column functions on hand-made edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from tonelab.functions import durations, generated, prompts, scores, text, tokens
from tonelab.functions.labels import THREE_CLASS, TWO_CLASS
from tonelab.operators import clean


def column(spark, values, expr, kind="string"):
    """Apply ``expr`` to column ``c`` and return the values in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_strip_equals_python_on_every_white_space(spark):
    values = [f"{chr(i)}a{chr(i)}b{chr(i)}" for i in range(1, 0x3100)] + [text.WHITESPACE, "", "x"]
    assert column(spark, values, text.strip(F.col("c"))) == [v.strip() for v in values]


def test_clean_text(spark):
    values = [" \t a\nb \n", "\n", "a\r\nb", " a ", None, "a\n\nb"]
    assert column(spark, values, text.clean_text(F.col("c"))) == ["a b", "", "a\r b", "a", None, "a  b"]


def test_clean_text_of_numbers(spark):
    assert column(spark, [12], text.clean_text(F.col("c")), "int") == ["12"]


def test_missing_label_becomes_off(spark):
    label = text.missing_to_off(text.normalise_label(F.col("c")))
    values = [None, "", "  ", " NaN ", "None", "Positive\n", "OFF", "other"]
    assert column(spark, values, label) == ["off", "off", "off", "off", "off", "positive", "off", "other"]


def test_encode_and_decode(spark):
    assert column(spark, ["negative", "off", "positive", "x", None], THREE_CLASS.encode(F.col("c"))) == [0, 1, 2, None, None]
    assert column(spark, ["negative", "off", "positive"], TWO_CLASS.encode(F.col("c"))) == [0, None, 1]
    assert column(spark, [0, 1, 2, 3, None], THREE_CLASS.decode(F.col("c")), "int") == ["Negative", "Off", "Positive", None, None]
    assert column(spark, [0, 1], TWO_CLASS.decode(F.col("c")), "int") == ["Negative", "Positive"]


def test_three_and_two_class_datasets(spark):
    rows = [
        (1, " good\n", "Positive"),
        (2, "bad", " negative "),
        (3, "so so", None),
        (4, "none", "None"),
        (5, "\n \t", "positive"),
        (6, None, "positive"),
        (None, "no id", "positive"),
        (7, "other", "neutral"),
        (8, "off", "Off"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, sentiment string")
    three = {r["id"]: (r["text"], r["sentiment"], r["label"]) for r in clean.dataset_with_off(df).collect()}
    assert three == {
        1: ("good", "positive", 2),
        2: ("bad", "negative", 0),
        3: ("so so", "off", 1),
        4: ("none", "off", 1),
        8: ("off", "off", 1),
    }
    two = {r["id"]: r["label"] for r in clean.dataset_remove_off(df).collect()}
    assert two == {1: 1, 2: 0}


def test_search_variant_keeps_empty_text_and_needs_a_label(spark):
    df = spark.createDataFrame([(None, " ", "positive"), (1, "a", None)], "id int, text string, sentiment string")
    out = clean.prepare_reviews(df, TWO_CLASS, required=("text", "sentiment"), drop_empty=False)
    assert [(r["id"], r["text"], r["label"]) for r in out.collect()] == [(None, "", 1)]


@pytest.mark.parametrize(
    ("policy", "label", "ids"),
    [
        ("three_class", ["positive", "negative", "off", "off", "off", "off", "positive"], [2, 0, 1, 1, 1, 1, 2]),
        ("remove_off", ["positive", "negative", "off", "off", "off", "off", "positive"], [1, 0, 1, 1, 1, 1, 1]),
        ("two_class", ["positive", "negative", "negative", "negative", "negative", "negative", "positive"], [1, 0, 0, 0, 0, 0, 1]),
    ],
)
def test_generated_text_and_fallback(spark, policy, label, ids):
    values = [" Positive!", "neg 1", "OFF.", "maybe", None, "", "1. po-S"]
    policy = generated.FALLBACKS[policy]
    assert column(spark, values, generated.text_to_label(F.col("c"), policy)) == label
    assert column(spark, values, generated.text_to_id(F.col("c"), policy)) == ids


def test_letters_beyond_ascii(spark):
    assert column(spark, ["É1ç", "中文 a_b", "²³"], generated.letters_only(F.col("c"))) == ["éç", "中文ab", ""]


def test_duration(spark):
    values = [0.0, 59.9, 3661.0, 86399.99, 90061.0, 172800.0, 1e6]
    expected = ["0:00:00", "0:00:59", "1:01:01", "23:59:59", "1 day, 1:01:01", "2 days, 0:00:00", "11 days, 13:46:40"]
    assert column(spark, values, durations.format_duration(F.col("c")), "double") == expected


def test_softmax_and_argmax(spark):
    vectors = [[1.0, 2.0, 2.0], [1000.0, 0.0, -1000.0], [0.0, 0.0, 0.0]]
    probabilities = column(spark, vectors, scores.softmax(F.col("c")), "array<double>")
    for v, p in zip(vectors, probabilities, strict=True):
        total = sum(math.exp(x - max(v)) for x in v)
        assert p == pytest.approx([math.exp(x - max(v)) / total for x in v], abs=1e-12)
        assert sum(p) == pytest.approx(1.0)
    assert column(spark, vectors, scores.argmax(F.col("c")), "array<double>") == [1, 0, 0]


def test_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 3.0], 0), ([1.0, 3.0], 1)], "v array<double>, y int")
    got = [r[0] for r in df.select(scores.cross_entropy("v", "y", 2)).collect()]
    total = math.log(math.exp(1) + math.exp(3))
    assert got == pytest.approx([total - 1, total - 3])


def test_tokens(spark):
    values = ["A b  C", "", "one"]
    assert column(spark, values, tokens.bounded_tokens(F.col("c"), 2)) == [["a", "b"], [], ["one"]]
    padded = tokens.pad_tokens(tokens.bounded_tokens(F.col("c")), 2, "_")
    assert column(spark, values, padded) == [["a", "b"], ["_", "_"], ["one", "_"]]
    mask = tokens.token_mask(tokens.bounded_tokens(F.col("c")), 2)
    assert column(spark, values, mask) == [[1, 1], [0, 0], [1, 0]]


def test_sentiment_prompts(spark):
    got = column(spark, [" a\nb "], prompts.sentiment_prompt(F.col("c"), "two_class_short"))
    assert got == ["sentiment (negative or positive): a b"]


def test_multitask_examples(spark):
    df = spark.createDataFrame([("t", "Positive", "room", "Nice Bed")], "text string, sentiment string, topic string, selected_text string")
    rows = {(r["task"], r["style"]): (r["input_text"], r["target_text"]) for r in prompts.multitask_examples(df).collect()}
    assert len(rows) == 6
    assert rows["sentiment", "prefix"] == ("sentiment classification: t", "Positive")
    assert rows["topic", "prompt"] == (
        "Task: Identify the topic of the following review.\nReview: t\nTopic:",
        "room",
    )
    assert rows["selected", "prompt"] == (
        "Task: Generate the selected content that supports the opinion.\nReview: t\nAnswer:",
        "Nice Bed",
    )
    one = prompts.multitask_examples(df, [("sentiment", "prompt")], normalise_target=True).collect()
    assert [r["target_text"] for r in one] == ["positive"]
