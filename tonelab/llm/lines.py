"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines within one edit are equal outside the edited place. Lines are cut into a few
pieces, counted from both ends, for their own length and for the length of a line with one
character more; the pieces outside the edit then hash alike. Only lines whose outside is
shared by a different line emit deletion variants, and only of the piece in question: the
piece without one character, with its position (one character replaced) and without it
(one character inserted or deleted). Lines with an equal variant are one edit apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelab.llm import rows

PIECES = 3
#: Shorter lines are repeats only if they are equal.
NEAR_CHARS = 20
BLANKS = " \t\r"


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """``_row``, ``no``, ``line`` (outer blanks off) and its two hashes; blank lines left out."""
    split = docs.select(rows.ROW, F.posexplode(F.split(text, "\n")).alias("no", "raw"))
    cut = split.select(rows.ROW, "no", F.trim("raw", F.lit(BLANKS)).alias("line")).where("line != ''")
    return cut.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _outsides(near_chars: int) -> Column:
    """For each length (own, one more) and piece: hash of what lies outside, and the place of the piece."""
    n = F.length("line")
    out = []
    for more in (0, 1):
        whole = n + more
        for i in range(PIECES):
            start, end = F.floor(whole * i / PIECES).cast("int"), F.floor(whole * (i + 1) / PIECES).cast("int")
            key = F.xxhash64(whole, F.lit(i), F.left(F.col("line"), start), F.lit("\n"), F.right(F.col("line"), whole - end))
            out.append(F.struct(key.alias("key"), F.lit(more).alias("more"), start.alias("start"), (end - more - start).alias("size")))
    return F.when(n >= near_chars, F.array(*out))


def _shared(lines: DataFrame, near_chars: int) -> DataFrame:
    """Outsides that belong to at least two different lines."""
    keys = lines.select("h1", F.explode(_outsides(near_chars)).alias("o")).select("h1", F.col("o.key").alias("key"))
    counted = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    return rows.written(counted.where("low < high").select("key"), "outsides")


def _candidates(docs: DataFrame, lines: DataFrame, text: str, near_chars: int, limit: int) -> DataFrame:
    """One row per different line and shared outside, with the line's text.

    If the shared outsides are few, they are sent to the lines; else places are joined
    first, without texts, and the texts of documents that have a hit are fetched by row.
    """
    shared = _shared(lines, near_chars)
    n = shared.count()
    if n <= limit:
        opened = lines.select("*", F.explode(_outsides(near_chars)).alias("o")).select("*", F.col("o.key").alias("key"))
        found = opened.join(F.broadcast(shared), "key")
    else:
        places = lines.select(rows.ROW, "no", F.explode(_outsides(near_chars)).alias("o")).select(rows.ROW, "no", "o", F.col("o.key").alias("key"))
        hits = rows.written(places.join(shared, "key", "left_semi").select(rows.ROW, "no", "o"), "places")
        texts = docs.join(hits.select(rows.ROW).distinct(), rows.ROW, "left_semi")
        found = _lines(texts, text).join(hits, [rows.ROW, "no"]).withColumn("key", F.col("o.key"))
    same = found.groupBy("h1", "h2", "key", F.col("o.more").alias("more"))
    return rows.written(
        same.agg(F.first("line").alias("line"), F.min(F.struct(rows.ROW, "no")).alias("place"), F.first("o.start").alias("start"), F.first("o.size").alias("size")),
        "candidates",
    )


def _near(candidates: DataFrame) -> DataFrame:
    """``h1``, ``h2`` of lines that have an earlier line within one edit."""
    piece = F.substring("line", F.col("start") + 1, F.col("size"))
    cut = candidates.select("h1", "h2", "key", "more", "place", piece.alias("piece"), "size")
    without = lambda j: F.concat(F.left(F.col("piece"), j - 1), F.substring(F.col("piece"), j + 1, F.col("size")))
    # Rows of two kinds: at >= 0, the place of a replaced character; at = -1, inserted or deleted.
    own = cut.where("more = 0 AND size > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("j"))
    own = own.select("h1", "h2", "place", "key", without(F.col("j")).alias("rest"), F.explode(F.array(F.col("j"), F.lit(-1))).alias("at"))
    own = own.select("h1", "h2", "place", F.xxhash64("key", "rest", "at").alias("v"), (F.col("at") < 0).cast("int").alias("side"))
    whole = cut.where("more = 1").select("h1", "h2", "place", F.xxhash64("key", "piece", F.lit(-1)).alias("v"), F.lit(2).alias("side"))
    # side 0: replaced, any two lines fit; side 1 and 2: a longer line fits a shorter one.
    # A group holds lines that differ in one place: at most as many as there are characters
    # (times the length for sides 1 and 2), however often they occur.
    first = F.struct("place", "h1", "h2")
    variants = own.unionByName(whole).distinct()
    least = variants.groupBy("v").agg(
        F.min(F.when(F.col("side") < 2, first)).alias("low"), F.min(F.when(F.col("side") == 2, first)).alias("high"),
        F.count(F.lit(1)).alias("n"),
    ).where("n > 1")
    met = variants.join(rows.written(least, "variants"), "v")
    other = F.when(F.col("side") == 1, F.col("high")).otherwise(F.col("low"))
    earlier = met.select("h1", "h2", "place", other.alias("other")).where(F.col("other.place") < F.col("place"))
    pairs = earlier.select("h1", "h2", F.col("other.h1").alias("g1"), F.col("other.h2").alias("g2")).distinct()
    texts = candidates.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    both = pairs.join(texts, ["h1", "h2"]).join(
        texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("kept")), ["g1", "g2"]
    )
    sure = F.levenshtein("line", "kept", 1).between(0, 1)
    return both.where(sure).select("h1", "h2").distinct()


def repeated_lines(docs: DataFrame, text: str = "text", near_chars: int = NEAR_CHARS, limit: int = rows.BROADCAST_ROWS) -> DataFrame:
    """Numbered rows -> ``_row``, ``gone``: sorted numbers of the lines to take out, for rows that have some."""
    lines = _lines(docs, text)
    place = F.struct(rows.ROW, "no")
    uniq = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    near = _near(_candidates(docs, lines, text, near_chars, limit)).withColumn("near", F.lit(True))
    marked = uniq.join(near, ["h1", "h2"], "left").where("n > 1 OR near")
    marked = rows.written(marked.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "marked")
    found = lines.select("h1", "h2", rows.ROW, "no").join(marked, ["h1", "h2"])
    gone = found.where(F.col("near") | (place > F.col("first")))
    return gone.groupBy(rows.ROW).agg(F.sort_array(F.collect_list("no")).alias("gone"))


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", near_chars: int = NEAR_CHARS, limit: int = rows.BROADCAST_ROWS,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and the columns ``counts``: lines, lines removed.

    Lines are compared without outer blanks over the whole table. In the order of ``key``
    (nulls last) and line number, a line goes if an equal line stands before it, or, from
    ``near_chars`` characters on, a line within one edit: one character replaced, inserted or
    deleted. A line counts as standing before it even if it goes itself, so of a chain of
    near copies the earliest line stays. Blank lines stay and are not counted. A null text
    stays null with 0 lines. Rows are never dropped; ``text`` may become empty. All other
    columns are returned as they are, but those named as ``counts``, which are replaced.
    ``limit``: rows that may be broadcast.
    """
    held, gone_in = rows.OWN + "lines", rows.OWN + "gone"
    whole = rows.numbered(docs, key)
    gone = rows.written(repeated_lines(whole, text, near_chars, limit).withColumnRenamed("gone", gone_in), "gone")
    size = gone.agg(F.sum(F.size(gone_in) + 1)).first()[0] or 0
    cut = whole.withColumn(held, F.split(text, "\n")).join(rows.small(gone, size, limit), rows.ROW, "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), gone_in)
    left = F.array_join(F.transform(keep, lambda i: F.get(held, i)), "\n")
    filled = F.filter(held, lambda x: F.trim(x, F.lit(BLANKS)) != "")
    return cut.select(
        *[F.when(F.col(gone_in).isNull(), F.col(text)).otherwise(left).alias(c) if c == text else F.col(c) for c in docs.columns if c not in counts],
        F.coalesce(F.size(filled), F.lit(0)).alias(counts[0]),
        F.coalesce(F.size(gone_in), F.lit(0)).alias(counts[1]),
    )
