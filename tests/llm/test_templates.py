"""Cases of the reviewer for op3: thin and short items, sentence starts, chance meetings, contradictions."""

import numpy as np

from tests.llm import cases
from tonelab.llm import hashing, templates


def found(spark, item, *texts):
    asked = spark.createDataFrame([(7, item)], "item_id int, text string")
    got = templates.contaminated(cases.plain(spark, dict(enumerate(texts))), asked).collect()
    return {r["doc_id"]: r["same_values"] for r in got}


def test_thin_and_short_items(spark):
    sums = "Compute 12 + 15 + 18 + 21 + 24 + 27."
    assert found(spark, sums, "So here: " + sums + " Well.", sums.replace("12", "13").replace("24", "25"), "nothing") == {0: True}
    assert found(spark, "Define photosynthesis.", "Please define photosynthesis now.", "define it") == {0: True}


def test_sentence_starts(spark):
    item = "Tom has 12 pears. Tom eats 4 pears. How many are left?"
    assert found(spark, item, "Ask this. Ida has 15 pears. Ida eats 6 pears. How many are left?") == {0: False}
    item = "What is the capital of Peru in winter?"
    assert found(spark, item, "Quiz page\n" + item, "Quiz page\n" + item.replace("Peru", "Chile"), "- " + item) == {0: True, 1: False, 2: True}


def test_chance_meeting(spark):
    item = "He wrote a long history of the North and the South in the War of those years which nobody has read since then at all"
    text = "She left some money of the Bank and the Court in the City of her birth to a cousin"
    assert found(spark, item, text, item.replace("North", "East").replace("South", "West")) == {1: False}


def test_contradictions(spark):
    item = "The old mill has 12 wheels and " + " ".join(f"w{i}x" for i in range(40)) + " and then the new mill got 12 more of them"
    assert set(found(spark, item, item.replace("12", "31", 1))) == {0}
    item = "A farmer sells 3 geese and 5 ducks at the market"
    assert found(spark, item, item.replace("3", "4").replace("5", "4")) == {0: False}


def test_words_are_read_together():
    """ASCII words without digits are not described one by one, and are read as ``describe`` reads them."""
    known = templates.words()
    plain = b"Plain words, (and) km/h twelve USA Bern I end here.\nAnd \"there!\" --- a_b's "
    kind, value, end, text = templates.described([plain, None, b"", plain], known)
    assert not known.place and (text == np.repeat([0, 3], len(kind) // 2)).all() and len(kind) == 28
    odd = plain + "O'Neil $5 3rd 7 été Été. ”quoted.” ......... x.\" ('Zoë') 5% ..........end.......... X1 K\r\n12".encode() + b" \xff \xc3"
    kind, value, end, _ = templates.described([odd], known)
    asked = [templates.describe(w) for line in odd.splitlines() for w in line.split()]
    assert kind.tolist() == [k for k, _, _ in asked] and known.place
    closing = np.cumsum([len(line.split()) for line in odd.splitlines()]) - 1
    assert end.tolist() == [e or i in closing for i, (_, _, e) in enumerate(asked)]
    low = [w for k, w, _ in asked if k != templates.NOTHING]
    same = {h: w for h, w in zip(value[kind != templates.NOTHING].tolist(), low, strict=True)}
    assert len(same) == len(set(low)) and [same[h] for h in value[kind != templates.NOTHING].tolist()] == low
    assert (value[kind != templates.NOTHING] == hashing.words([b" ".join(low)])[0]).all()
