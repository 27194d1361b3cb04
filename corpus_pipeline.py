"""From raw documents to packed sequences: five stages, each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. Rows with null ids and repeated rows are
documents of their own; other columns are passed on. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelab.llm import language, lines, packing, rows, simhash, templates


#: Cosine from which a predicted language that contradicts the recorded one is believed.
SURE = 0.9


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found, and those whose text is surely of another than the recorded one.

    Null texts and texts without a letter have none. Another language counts from a cosine of SURE
    on, so short texts, of which little can be told, stay. Texts without a recorded language stay,
    and so do all texts with a letter if no row has taught a language.
    """
    letter = rows.OWN + "letter"
    whole = rows.numbered(docs, "doc_id")
    told = whole.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.identify(told, also=(rows.ROW, letter, "lang"))
    none = (F.col("lang_pred") == language.UNKNOWN) & ~F.col(letter)
    other = (F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_pred") != F.col("lang")) & (F.col("score") >= SURE)
    with rows.short_batches(spark):
        return rows.without(whole, found.where(none | other)).select(docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out repeated lines; documents of which nothing is left go.

    ``n_chars``, if there, is the length of what is left.
    """
    counts = (rows.OWN + "n_lines", rows.OWN + "n_removed")
    cut = lines.drop_repeated_lines(docs, counts=counts)
    left = (F.col(counts[1]) == 0) | (F.trim("text", F.lit(lines.BLANKS + "\n")) != "")
    kept = cut.where(left).select(docs.columns)
    changed = F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return kept.withColumn("n_chars", changed) if "n_chars" in docs.columns else kept


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id."""
    whole = rows.numbered(docs, "doc_id")
    found = simhash.near_duplicates(whole)
    return rows.without(whole, found.where(~F.col("kept"))).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other numbers or names."""
    whole = rows.numbered(docs, "doc_id")
    found = templates.contaminated(whole, rows.table(spark, sf_dir, "benchmark"), also=(rows.ROW,))
    return rows.without(whole, found.select(rows.ROW).distinct()).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: see ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]
#: Language vectors, fingerprints and subword ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = rows.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
