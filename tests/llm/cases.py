"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXT = "The quick brown fox jumps over the lazy dog while twelve tired hens sleep. It rains on the old red barn all day. Nobody goes out.\nA second line stands here."
ROWS = [
    (1, TEXT, "en"),
    (2, TEXT, "en"),
    (2, TEXT, "en"),
    (None, TEXT.replace("second", "sekond"), "en"),
    (None, None, None),
    (5, "", "de"),
    (6, " \t\n\n ", "de"),
    (7, "1234 !!! 5678", "en"),
    (8, "der die das und nicht mit ein eine auf von zu ist im den des sich\n" * 3, "de"),
    (9, "wort " * 30000, "de"),
    (10, "x" * 70000, None),
    (11, "A second line stands her.", "en"),
]
SCHEMA = "doc_id bigint, text string, lang string, h bigint, key string, n_lines int, n_removed int, kept boolean, score string, fp string, n bigint"


def documents(spark: SparkSession) -> DataFrame:
    """With extra columns whose names the operators use."""
    return spark.createDataFrame([(*r, 3, "k", -1, -2, None, "s", None, 7) for r in ROWS], SCHEMA)


def plain(spark: SparkSession, texts: dict) -> DataFrame:
    return spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id bigint, text string, lang string")


def groups(nodes, linked) -> dict:
    """Node -> smallest node reachable, by plain search."""
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo = [n]
        while todo:
            m = todo.pop()
            if m not in out:
                out[m] = n
                todo += [x for x in nodes if linked(m, x)]
    return out
