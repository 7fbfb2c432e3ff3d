"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.find(_table(spark, sf_dir, "documents"))


def op3_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wavelet

    return wavelet.encode_and_read(_table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing
    from .common import written

    docs = _table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "sized")
    return mixing.plan(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_rules

    return url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.perspectives(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_secret_scans, op3_token_wavelet, op4_exact_top_k, op5_ngram_join,
        op6_mixing, op7_nearest_neighbours, op8_url_rules, op9_packing, op10_chat_perspectives,
    )
}

ORACLE_SQL = {
    "op4_exact_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_mixing": r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
  sum(weight) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM c),
g AS (SELECT *, (total - before) / rest AS water FROM f),
h AS (SELECT *, (SELECT water FROM g WHERE water <= level ORDER BY level, source ASC NULLS LAST LIMIT 1) AS found FROM g),
r AS (SELECT source, source_size, CASE WHEN found IS NULL THEN cap ELSE least(cap, weight * found) END AS target FROM h),
d AS (SELECT sized.doc_id, sized.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('17:' || coalesce(sized.doc_id::VARCHAR, 'null:' || sized.size)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM d""",
    "op8_url_rules": r"""
WITH rules(verdict, rule) AS (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
p AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules ON ('.' || p.host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(p.path, substr(rule, instr(rule, '/'))) GROUP BY p.n)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)""",
    "op10_chat_perspectives": r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS NOT NULL AND role <> 'system'),
j AS (SELECT t.*, s.speaker, '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system' WHEN t.role IS NULL THEN 'user' ELSE 'user name=' || t.role END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
k AS (SELECT *, length(head) + length(text) + 11 AS len FROM j),
o AS (SELECT *, row_number() OVER w AS seat, sum(len) OVER w - len AS start FROM k WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, seat::BIGINT AS seat, turn, role, head || text || '<|im_end|>' || chr(10) AS segment, start::BIGINT AS start, len::BIGINT AS length,
  (start + length(head))::BIGINT AS mask_start, (CASE WHEN role = speaker THEN length(text) + 11 ELSE 0 END)::BIGINT AS mask_length FROM o""",
}
