"""The operators' queries over their whole tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, chat_tools, divergence, fingerprints, hnsw, lsm_dedup, mixing, ngram_join, quality_gam, secret_scan, sharding, toxicity, whitening


#: Bytes of a shard: little enough that the small tables split as well.
OP7_LIMIT = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_table(spark, sf_dir, "documents"))


def op4_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.link(_table(spark, sf_dir, "conversations"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), limit=OP7_LIMIT)


def op8_hnsw_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ones = (op1_quality_gam, op2_toxicity_ordinal, op3_ngram_jaccard, op4_chat_tools, op5_mixing_sources, op6_secret_scan, op7_extendible_sharding, op8_hnsw_embeddings)
    return {f.__name__: f for f in (*ones, op9_exact_dedup, op10_byte_bpe, op11_embedding_whitening, op12_document_fingerprints, op13_source_divergence)}


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents
), ranked AS (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size,
         row_number() OVER w = 1 AS kept, sha256(normal) AS text_sha256
  FROM docs WINDOW w AS (PARTITION BY normal ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked
"""


#: The synthetic conversations hold plain turns only; JSON messages are tested on fixtures.
OP4_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(conv_id::VARCHAR, 'null') AS conv FROM conversations
), calls AS (
  SELECT conv, id, min(r) AS r, count(*) AS n_calls FROM (
    SELECT conv, conv || ':' || coalesce(turn::VARCHAR, 'null') AS id, {'turn': turn, 'body': to_json(text)::VARCHAR, 'empty': text = '', 'conv_id': conv_id} AS r FROM m WHERE role = 'user') GROUP BY ALL
), results AS (
  SELECT conv, id, min(r) AS r, count(*) AS n_results FROM (
    SELECT conv, coalesce(conv || ':' || (turn - 1)::VARCHAR, '') AS id, {'turn': turn, 'content': text, 'conv_id': conv_id} AS r FROM m WHERE role = 'assistant') GROUP BY ALL
)
SELECT coalesce(c.r.conv_id, s.r.conv_id) AS conv_id, CASE WHEN c.id IS NULL THEN s.r.turn ELSE c.r.turn END AS turn, id AS call_id,
       CASE WHEN c.id IS NOT NULL THEN 'respond' END AS name,
       CASE WHEN c.id IS NULL THEN 'orphan' WHEN s.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       0 AS level, CASE WHEN c.r.empty THEN 'prompt: empty' ELSE '' END AS problems, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       '{"arguments":' || coalesce('{"prompt":' || c.r.body || '}', 'null') || ',"id":' || to_json(id)::VARCHAR || ',"name":' || CASE WHEN c.id IS NULL THEN 'null' ELSE '"respond"' END
         || ',"result":' || coalesce(to_json(s.r.content)::VARCHAR, 'null') || '}' AS record
FROM calls c FULL OUTER JOIN results s USING (conv, id)
UNION ALL
SELECT conv_id, turn, NULL, NULL, 'message', 0, '', 0, 0, '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM m WHERE coalesce(role NOT IN ('user', 'assistant'), true)
"""
OP7_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents
), level(doc_id, bytes, key, bits, prefix, shard_bytes) AS (
  SELECT doc_id, bytes, key, 0, 0::BIGINT, (sum(bytes) OVER ())::BIGINT FROM rows
  UNION ALL
  SELECT doc_id, bytes, key, bits + 1, key >> (59 - bits), (sum(bytes) OVER (PARTITION BY key >> (59 - bits)))::BIGINT
  FROM level WHERE shard_bytes > 1048576 AND bits < 60
)
SELECT doc_id, bytes, CASE WHEN bits = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), bits) END AS shard, bits AS shard_bits, shard_bytes, shard_bytes > 1048576 AS oversized
FROM level WHERE shard_bytes <= 1048576 OR bits = 60
"""

#: Every group against every kept term of its language, without the sparse form.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT doc, lang, source, unnest(terms) AS item FROM d),
kept AS (SELECT lang, item, count(*)::HUGEINT AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, item, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.item, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, item)),
shares AS (
  SELECT lang, source, item, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (total + 5 * v) AS q
  FROM dense JOIN langs USING (lang)
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, (p - q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, item) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_tools": OP4_SQL, "op7_extendible_sharding": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op13_source_divergence": OP13_SQL}
