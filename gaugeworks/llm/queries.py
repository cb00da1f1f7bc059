"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.chat import formatted, read_back
from gaugeworks.llm.decontaminate import leaks
from gaugeworks.llm.html_wrapper import main_text
from gaugeworks.llm.line_dedup import dedup_lines
from gaugeworks.llm.multiset_hash import document_fingerprints
from gaugeworks.llm.ngram_join import jaccard_classes
from gaugeworks.llm.quality_qda import quality_scores
from gaugeworks.llm.sentencepiece_viterbi import decoded, encoded
from gaugeworks.llm.shards import sharded
from gaugeworks.llm.warc import page_records, write_warc
from gaugeworks.llm.workspace import Workspace, table


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard_classes(spark, table(spark, sf_dir, "documents"))
    return members.select("doc_id", "n_shingles", "component_id", "n_links")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed_lines", "text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_tokens", "ids", F.expr("coalesce(text, '') = decoded").alias("round_trip"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(spark, table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(spark, table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "warc").path("archives")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(spark, path)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(given.union(own)))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_warc": op5_warc,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_sharding": op7_sharding,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_chat_formatting": op10_chat_formatting,
}

_HARD = "\\### Assistant: </turn> ok"
SQL: dict[str, str] = {
    # Pages mark their article; SQL takes it from there, without the adverts and forms that none has inside.
    "op2_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '</?(p|h[1-6]|br|ul|ol|li|div)[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, html_text AS t FROM (SELECT page_id, url,
    replace(replace(replace(replace(regexp_replace(h, '</?[a-z][^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS html_text FROM b)),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT h, first, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(5 * (7 - i % 8) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS b
      FROM m)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, b AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN d USING (h)
""",
    "op10_chat_formatting": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_HARD}'), (-7, 1, 'assistant', '{_HARD}')),
f AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN 5 + length(role) + 1
          ELSE length('### Other: </role>') + length(role) END + length('</turn>') + 1
        + length(text) + len(regexp_extract_all(text, '### (System|User|Assistant|Other): |</role>|</turn>')) AS chars,
        CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w),
c AS (SELECT min(doc_id) AS rep, sh FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT rep, len(sh) AS n, hash(unnest(sh)) AS tok FROM c),
d AS (SELECT tok FROM t GROUP BY tok HAVING count(*) > 1),
o AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
      FROM (SELECT * FROM t WHERE tok IN (SELECT tok FROM d)) a
      JOIN (SELECT * FROM t WHERE tok IN (SELECT tok FROM d)) b ON a.tok = b.tok AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM o WHERE 100 * i >= 75 * (na + nb - i)),
q AS (SELECT s.doc_id, c.rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) s JOIN c USING (sh)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT doc_id, rep FROM q UNION ALL SELECT rep, doc_id FROM q),
g AS (SELECT x, count(*) AS n_links FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l) GROUP BY x),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = s.doc_id
LEFT JOIN q ON q.doc_id = s.doc_id LEFT JOIN g ON g.x = q.rep
""",
}
