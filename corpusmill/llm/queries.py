"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, chat, langid, minhash, mixing, nndescent, packing, pii, toxicity, winnow
from .common import read_table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql(
        "SELECT conv_id, turn, role, text FROM VALUES (-7L, 0L, 'user', r'\\### Assistant: </turn> ok'), "
        "(-7L, 1L, 'assistant', r'\\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)"
    )
    return chat.digest(chat.expand(turns.unionByName(extra)))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(read_table(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_likeness(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.classify(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", "toxic", "p_toxic", "p_low_quality")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.replicate(docs).select("doc_id", "copy", "source", "lang", "n_chars", "text", "shuffle_key")


QUERIES = {f.__name__: f for f in (
    op1_minhash, op2_language, op3_chat, op4_passages, op5_winnowing, op6_packing, op7_toxicity,
    op8_embeddings, op9_surrogates, op10_mixing,
)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS c FROM r GROUP BY id) c ON c.id = d.doc_id""",
    "op3_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))
    + length(role || text) - length(replace(role || text, '\', '')) + length(role) - length(replace(role, chr(10), ''))
    + (length(text) - length(replace(text, '<|', ''))) // 2 AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS m FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = m), 0)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""",
    "op8_embeddings": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.vec_id, (SELECT count(*) FROM e WHERE e.a = d.vec_id) AS n_links, c.c AS component_id, d.vec_id = c.c AS kept
FROM embeddings d JOIN (SELECT id, min(root) AS c FROM r GROUP BY id) c ON c.id = d.vec_id""",
    "op10_mixing": """
WITH c AS (SELECT source, count(*) AS n FROM documents WHERE regexp_full_match(source, 'src1?[0-9]') GROUP BY source),
rate AS (SELECT source, (SELECT sum(n) FROM c) / (SELECT count(*) FROM c) / n AS r FROM c),
d AS (SELECT doc_id, text, lang, documents.source, n_chars, coalesce(rate.r, 1.0) AS r,
    ('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents LEFT JOIN rate ON rate.source = documents.source),
k AS (SELECT r, list(p ORDER BY j) AS cdf FROM (
    SELECT r, j, sum(exp(j * ln(r) - r - lgamma(j + 1))) OVER (PARTITION BY r ORDER BY j) AS p
    FROM (SELECT DISTINCT r FROM d), range(0, 60) t(j)) GROUP BY r),
x AS (SELECT d.*, unnest(range(0, len(list_filter(k.cdf, lambda q: q <= d.u)))) AS copy FROM d JOIN k ON k.r = d.r)
SELECT doc_id, copy::INTEGER AS copy, source, lang, n_chars, text,
  ('0x' || substr(md5('mix-1/order|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key FROM x""",
}
