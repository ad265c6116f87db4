"""The queries of the training-data operators and their SQL, each a thin call of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, filters, jaccard, licenses, passages, pii, quality, secrets, sharding, toxicity, turns
from .common import documents, table

def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find(documents(spark, sf_dir)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(documents(spark, sf_dir)))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(sharding.reshard(documents(spark, sf_dir)))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.report(bpe.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = turns.read(table(spark, sf_dir, "conversations"))
    return turns.report(conversations, turns.damaged(conversations))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(filters.labelled(filters.failures(documents(spark, sf_dir)), table(spark, sf_dir, "labels")))


#: A conversation of which both turns hold what the template must escape.
PLANTED_ID, PLANTED_TEXT = -7, r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    planted = spark.range(2).select(F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"))
    return chat.digests(chat.pieces(conversations.select("conv_id", "turn", "role", "text").unionByName(planted)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_toxicity, op3_secret_scan, op4_substring_dedup, op5_license_scan, op6_benchmark_decontamination, op7_pii, op8_sharding, op9_byte_bpe, op10_quality_rules, op11_turn_repair, op12_filter_audit, op13_chat_format)}


#: All pairs of different sets that share a shingle, then the smallest id that each reaches. Equal sets are one node.
LINKED = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM words),
nodes AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT id, n, unnest(s) AS t FROM nodes),
shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
least AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(l.component, n.id) END AS component_id
FROM sets s LEFT JOIN nodes n ON n.s = s.s LEFT JOIN least l ON l.id = n.id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express."""
    return {"op1_ngram_jaccard_join": LINKED, "op11_turn_repair": turns.SQL, "op12_filter_audit": filters.SQL, "op13_chat_format": chat.SQL}
