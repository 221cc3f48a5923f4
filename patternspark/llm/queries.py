"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lm_scoring, mixing, near_dedup, pii, quality, secret_scan, sharding, token_codes, vector_dedup
from .scratch import Scratch

#: Names of public vocabulary files; public_tokenizers.path() finds them on the machine that a task runs on.
BPE = "byte_bpe_50k.json"
SUBWORDS = "piece_bpe_32k.model"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path
    token_codes.write_tokens(_table(spark, sf_dir, "documents"), path, BPE, END_ID)
    return token_codes.read_tokens(spark, path)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


#: Setting that holds the key of surrogates; without it every run draws a key, and surrogates differ between runs.
PII_KEY = "spark.patternspark.pii.key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, "") or secrets.token_hex(32)
    out = pii.pseudonymise(_table(spark, sf_dir, "documents"), key)
    return out.select("doc_id", "text", F.col("_pii_count").alias("pii_count"), F.col("_pii_kinds").alias("pii_kinds"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), repetition=2.0)
    names = {
        "_mix_tokens": "n_tokens",
        "_mix_weight": "weight",
        "_mix_epoch": "epoch",
        "_mix_block": "block",
        "_mix_position": "position",
    }
    return mixed.select("doc_id", "source", *(F.col(a).alias(b) for a, b in names.items()))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), n_shards=40, overhead=16)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), SUBWORDS)


def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"), least=0.9).drop("reached", "recall")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_token_codes, op3_quality, op4_near_duplicates, op5_pii, op6_secrets, op7_mixing, op8_sharding, op9_lm_scoring, op10_embedding_duplicates, pipeline)
}

_REACH = """
reach AS (
  SELECT a, b FROM link
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
),
lowest AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
"""

ORACLES = {
    "op4_near_duplicates": rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM word)
),
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest ON lowest.a = d.doc_id
""",
    "op7_mixing": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    (('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 6))::BIGINT % 256)::INTEGER AS block
  FROM documents
),
src AS (SELECT s, sum(n_tokens)::BIGINT AS tokens FROM doc GROUP BY s),
share AS (SELECT s, tokens, tokens / sum(tokens) OVER () AS p FROM src),
step AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT max(pow(p, (lo + hi) / 2 - 1)) <= 2 * min(pow(p, (lo + hi) / 2 - 1)) FROM share WHERE p > 0) AS ok FROM step WHERE i < 50)
),
t AS (SELECT CASE WHEN (SELECT max(pow(p, -1)) <= 2 * min(pow(p, -1)) FROM share WHERE p > 0) THEN 0.0 ELSE round(hi, 6) END AS t FROM step WHERE i = 50),
weighed AS (
  SELECT s, tokens,
    CASE WHEN tokens > 0 THEN round(pow(p, t) / (SELECT sum(pow(p, t)) FROM share, t WHERE p > 0), 9) ELSE 0.0 END AS weight,
    CASE WHEN tokens > 0 THEN greatest(1.0, round(pow(p, t - 1) / (SELECT min(pow(p, t - 1)) FROM share, t WHERE p > 0), 6)) ELSE 1.0 END AS repeats
  FROM share, t
),
blk AS (SELECT s, block, sum(n_tokens)::BIGINT AS n FROM doc GROUP BY s, block),
ep AS (SELECT s, tokens, weight, repeats, unnest(range(0, ceil(repeats)::BIGINT))::INTEGER AS epoch FROM weighed),
turn AS (
  SELECT s, block, epoch, tokens, weight, repeats,
    coalesce(sum(n) OVER (PARTITION BY s, epoch ORDER BY md5('42|' || epoch || '|' || s || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM blk JOIN ep USING (s)
)
SELECT doc.doc_id, doc.source, doc.n_tokens, weight, epoch, doc.block, round((epoch + before / greatest(tokens, 1)) / repeats, 9) AS position
FROM doc JOIN turn USING (s, block)
WHERE epoch < floor(repeats) OR before < round((repeats - floor(repeats)) * tokens)
""",
    "op10_embedding_duplicates": rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings
),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND x.n > 0 AND y.n > 0
  WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.9
),
{_REACH},
k AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN k ON k.a = vec_id LEFT JOIN lowest ON lowest.a = vec_id
""",
}
