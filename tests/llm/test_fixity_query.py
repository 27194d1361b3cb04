"""op9 on pages with null and repeated ids, and layouts in which one archive holds all rows."""

import hashlib
from itertools import accumulate

from pyspark.sql import functions as F

from tonelab.llm import fixity, queries


def test_null_and_repeated_ids(spark, tmp_path):
    pages = [(None, "u", "sound"), (None, "v", "sound too"), (5, "u", "one"), (5, "u", "two"), (5, "u", "two"), (97, "u", "hurt")]
    pages += [(n * 1024 + 7, "u", "near") for n in range(1, 4)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["page_id"], r["kind"]) for r in queries.op9_warc_fixity(spark, str(tmp_path)).collect()]
    assert got == [(97, "changed")]


def plain(page: int, url: str, html: str) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Target-URI: {url}"
    return f"{head}\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n{html}\r\n\r\n".encode()


def placed(records: list[tuple[int, bytes]]) -> dict:
    out, end = {}, {}
    for page, digest, size in sorted((p, hashlib.sha256(r).hexdigest(), len(r)) for p, r in records):
        archive = f"pages-{page // 1024}"
        out[archive, end.get(archive, 0)] = (page, digest)
        end[archive] = end.get(archive, 0) + size
    return out


def test_lost_cut_and_added_records_shift_their_archive_only(spark, tmp_path):
    pages = [(i, "u", "x" * (20 + i)) for i in (10, 41, 43, 45, 48, 50, 1030)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    theirs = [(p, plain(p, u, h)[: 100 if p == 48 else None]) for p, u, h in pages if p != 45] + [(41, plain(41, "u", ""))]
    a, b = placed([(p, plain(p, u, h)) for p, u, h in pages]), placed(theirs)
    want = set()
    for at in a.keys() | b.keys():
        if a.get(at) != b.get(at):
            kind = "missing" if at not in b else "extra" if at not in a else "changed"
            want.add((*at, a.get(at, b.get(at))[0], kind))
    got = [(r["archive"], r["offset"], r["page_id"], r["kind"]) for r in queries.op9_warc_fixity(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {kind for *_, kind in want} == {"missing", "extra", "changed"} and not {p for *_, p, _ in want} & {10, 1030}


def test_one_archive_of_one_repeated_key(spark):
    records = spark.range(9000).select(F.lit(3).cast("bigint").alias("page_id"), F.repeat(F.lit("a"), (F.col("id") % 50).cast("int")).alias("record"))
    placed = sorted((r["digest"], r["offset"], r["length"]) for r in fixity.layout(records, "page_id", "record").collect())
    starts = [0, *accumulate(length for *_, length in placed)]
    assert [at for _, at, _ in placed] == starts[:-1] and len(placed) == 9000
