"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelab.llm import embeddings, fim, fixity, language, lines, manifest, mixing, packing, rows, simhash, spans, suffix_tree, templates, tokens
from tonelab.llm.rows import table


def op1_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = language.fold("doc_id", 5, 1)
    found = suffix_tree.score(docs, docs.where(~held))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings"), threshold=0.9)


#: Every pair compared, and whatever is reachable by links.
VECTOR_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c != 0)) > 0),
near AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id != b.vec_id
  WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) END >= 0.9),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT vec_id, v FROM reach JOIN near ON u = other)
SELECT vec_id, (SELECT count(*) FROM near WHERE u = vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reach GROUP BY vec_id
"""


def op3_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return templates.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that lost a passage, and what is left of them."""
    cut = spans.drop_repeated_spans(table(spark, sf, "documents")).where("n_removed > 0")
    return cut.select("doc_id", "n_sentences", "n_removed", F.md5("text").alias("text_md5"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = lines.drop_repeated_lines(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


#: Two lines within one edit agree in the first or the second half of the longer one's length.
LINE_SQL = """
WITH raws AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
cut AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM raws),
uniq AS (
  SELECT line, length(line) AS n, min(struct_pack(doc_id := doc_id, no := no)) AS place
  FROM cut WHERE line != '' GROUP BY line),
halves AS (
  SELECT line, place, n + more AS whole, half, CASE half WHEN 0 THEN left(line, (n + more) // 2)
         ELSE right(line, n + more - (n + more) // 2) END AS part
  FROM uniq, (VALUES (0), (1)) AS m(more), (VALUES (0), (1)) AS h(half) WHERE n >= 20),
near AS (
  SELECT DISTINCT b.line FROM halves a JOIN halves b USING (whole, half, part)
  WHERE a.place < b.place AND levenshtein(a.line, b.line) = 1),
marked AS (
  SELECT doc_id, no, raw, line != '' AS filled,
         line != '' AND (line IN (FROM near) OR struct_pack(doc_id := doc_id, no := no) > place) AS gone
  FROM cut LEFT JOIN uniq USING (line)),
done AS (
  SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, md5(kept) AS text_md5
FROM documents LEFT JOIN done USING (doc_id)
"""


def op7_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), shingle=4, radius=4)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", digits, "component_id", "kept")


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op9_warc_fixity(spark: SparkSession, sf: str) -> DataFrame:
    """Audit of a second replica that is laid out from its own records.

    By rule, records are damaged in place, and seldom one is lost, cut off or added: what follows
    it in its archive then starts elsewhere and is reported as well.
    """
    pages = table(spark, sf, "pages")
    ours = pages.select("page_id", fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    often, seldom = (F.coalesce(F.col("page_id") % n, F.lit(-1)) for n in (97, 20011))
    body = F.when(often == 0, F.overlay("html", F.lit("\0"), F.lit(1))).otherwise(F.col("html"))
    record = fixity.warc_record(F.col("page_id"), F.col("url"), body)
    added = fixity.warc_record(F.col("page_id"), F.col("url"), F.lit(""))
    held = F.when(seldom == 41, F.array(record, added)).when(seldom == 45, F.array().cast("array<string>"))
    held = held.when(seldom == 48, F.array(F.left(record, F.lit(100)))).otherwise(F.array(record))
    theirs = pages.select("page_id", F.explode(held).alias("record"))
    return fixity.audit(fixity.layout(ours, "page_id", "record"), fixity.layout(theirs, "page_id", "record"), "page_id")


#: Both replicas laid out whole, and every record compared with the one at its offset.
FIXITY_SQL = """
WITH cut AS (
  SELECT page_id, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Date: 2024-01-01T00:00:00Z' || e || 'WARC-Record-ID: <urn:page:'
         || page_id || '>' || e || 'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' AS head,
         e || e AS gap, html
  FROM pages, (SELECT chr(13) || chr(10) AS e)),
hurt AS (
  SELECT page_id, head || strlen(html) || gap || CASE WHEN page_id % 97 = 0 THEN chr(0) || substr(html, 2) ELSE html END || gap AS record FROM cut),
sides AS (
  SELECT 0 AS side, page_id, head || strlen(html) || gap || html || gap AS record FROM cut
  UNION ALL
  SELECT 1, page_id, CASE WHEN page_id % 20011 = 48 THEN left(record, 100) ELSE record END FROM hurt WHERE page_id % 20011 != 45
  UNION ALL
  SELECT 1, page_id, head || '0' || gap || gap FROM cut WHERE page_id % 20011 = 41),
placed AS (
  SELECT side, 'pages-' || (page_id // 1024) AS archive, page_id, strlen(record) AS length, sha256(record) AS digest,
         coalesce(sum(strlen(record)) OVER (PARTITION BY side, page_id // 1024 ORDER BY page_id, sha256(record)
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM sides)
SELECT archive, "offset", coalesce(p.page_id, t.page_id) AS page_id,
       CASE WHEN t.digest IS NULL THEN 'missing' WHEN p.digest IS NULL THEN 'extra' ELSE 'changed' END AS kind,
       p.length, p.digest, t.length AS their_length, t.digest AS their_digest
FROM (FROM placed WHERE side = 0) p FULL JOIN (FROM placed WHERE side = 1) t USING (archive, "offset")
WHERE p.digest IS DISTINCT FROM t.digest
"""


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts of all texts, and digests of the new text and of the text rebuilt from it."""
    done = fim.fill_in_middle(table(spark, sf, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("fim_text")).alias("output_sha256"),
        digest(fim.restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"),
    )


#: The units as a list, cut in three.
MIDDLE_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS digest FROM documents),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(digest, i, 8))::BIGINT) AS h FROM drawn),
placed AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of all documents; of a third of them the text is lower-cased before it is verified."""
    docs = table(spark, sf, "documents")
    hurt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    other = rows.OWN + "other"
    told = docs.withColumn(other, manifest.leaf(docs, text=F.when(hurt, lowered).otherwise(F.col("text"))))
    made = manifest.build(told, also=other)
    found = manifest.prove(made)
    folded = manifest.fold(F.col("other"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def op13_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    _, accounts = mixing.mix(table(spark, sf, "documents"))
    return accounts.select("doc_id", "size", "source_size", "target", "taken")


#: The trees level by level; siblings of every node on a leaf's path; the damaged leaf folded up again.
MANIFEST_SQL = """
WITH RECURSIVE told AS (
  SELECT *, doc_id::VARCHAR AS id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM documents),
coded AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], range(8 * strlen(id))::BIGINT[]), lambda c, i:
    CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ord(substr(id, (i // 8)::INT + 1, 1)) ELSE 0 END) % 2 = 1
         THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ord(substr(id, (i // 8)::INT + 1, 1)) ELSE 0 END) // 2, 3988292384)
         ELSE xor(c, CASE WHEN i % 8 = 0 THEN ord(substr(id, (i // 8)::INT + 1, 1)) ELSE 0 END) // 2 END) AS crc FROM told),
leaves AS (
  SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n,
         head, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN xor(crc, 4294967295) % 3 = 0
                THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS other
  FROM (SELECT *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
               || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM coded)),
low AS (
  SELECT 0 AS h, tree, rank AS pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT h + 1, tree, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY h, tree, pos // 8, n),
high AS (
  SELECT 0 AS h, tree AS pos, digest, count(*) OVER () AS n FROM low WHERE n = 1
  UNION ALL
  SELECT h + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY h, pos // 8, n),
all_nodes AS (SELECT 0 AS part, h, tree, pos, digest, n FROM low UNION ALL SELECT 1, h, 0, pos, digest, n FROM high),
climb AS (
  SELECT doc_id, tree AS home, 0 AS part, 0 AS h, tree, rank AS pos, other AS mine, n FROM leaves
  UNION ALL
  SELECT doc_id, home, CASE WHEN n = 1 THEN 1 ELSE part END, CASE WHEN n = 1 THEN 0 ELSE h + 1 END, CASE WHEN n = 1 THEN 0 ELSE tree END,
         CASE WHEN n = 1 THEN home ELSE pos // 8 END,
         CASE WHEN n = 1 THEN mine ELSE (
           SELECT sha256(string_agg(CASE WHEN a.pos = c.pos THEN c.mine ELSE a.digest END, '' ORDER BY a.pos))
           FROM all_nodes a WHERE a.part = c.part AND a.h = c.h AND a.tree = c.tree AND a.pos // 8 = c.pos // 8) END,
         CASE WHEN n = 1 THEN (SELECT max(n) FROM high) ELSE (n + 7) // 8 END
  FROM climb c WHERE part = 0 OR n > 1),
proofs AS (
  SELECT doc_id, sha256(coalesce(string_agg(a.digest, '' ORDER BY c.part, c.h, a.pos) FILTER (a.pos != c.pos), '')) AS proof_sha256
  FROM climb c LEFT JOIN all_nodes a ON c.n > 1 AND a.part = c.part AND a.h = c.h AND a.tree = c.tree AND a.pos // 8 = c.pos // 8 GROUP BY doc_id)
SELECT doc_id, leaf, low.digest AS subroot, high.digest AS root, proof_sha256, climb.mine AS folded_root, climb.mine = high.digest AS verified
FROM leaves JOIN low ON low.tree = leaves.tree AND low.n = 1 JOIN high ON high.n = 1 JOIN proofs USING (doc_id)
JOIN climb USING (doc_id) WHERE climb.part = 1 AND climb.n = 1
"""


#: Targets by taking the fullest sources out one after the other; words taken as stretches of a line.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('42:' || (row_number() OVER (ORDER BY doc_id) - 1)) AS h FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER below, 0) AS used, sum(w) OVER rest AS left_w, 1.5::DOUBLE * sum(source_size) OVER () AS wanted
  FROM sources WINDOW below AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      rest AS (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
stop AS (
  SELECT wanted - used AS remaining, left_w FROM filled WHERE (wanted - used) * w / left_w <= 2 * source_size ORDER BY used, left_w DESC LIMIT 1),
aims AS (
  SELECT source, source_size, coalesce(least(remaining * w / left_w, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target
  FROM sources LEFT JOIN stop ON true),
line AS (
  SELECT doc_id, size, s.source, sum(size) OVER (PARTITION BY s.source ORDER BY h) - size AS a FROM sized s)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, round(target)::BIGINT) - a) + greatest(0, least(a + size + source_size, round(target)::BIGINT) - a - source_size))::BIGINT AS taken
FROM line JOIN aims ON line.source IS NOT DISTINCT FROM aims.source
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_lm_scoring, op2_embedding_near_dedup, op3_benchmark_decontamination, op4_language_id, op5_substring_dedup, op6_line_dedup,
        op7_simhash_near_dedup, op8_packing, op9_warc_fixity, op10_token_counts, op11_fill_in_middle, op12_merkle_manifest, op13_source_mix,
    )

}
ORACLE: dict[str, str] = {"op2_embedding_near_dedup": VECTOR_SQL, "op6_line_dedup": LINE_SQL, "op9_warc_fixity": FIXITY_SQL, "op11_fill_in_middle": MIDDLE_SQL, "op12_merkle_manifest": MANIFEST_SQL, "op13_source_mix": MIX_SQL}
