"""A training corpus from raw documents: toxic texts, near copies and test items go, secrets are masked, the rest is tokenised.

Every stage takes whole texts, however long; an empty table stays empty; columns besides id and text, nulls in them and any
names pass through, up to the last stage. What a stage does with null ids, null or empty texts, ties and repeated rows is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, decontaminate, jaccard, secrets, toxicity
from recollect.llm.common import documents, stored, table

#: The vocabulary file of the last stage.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    A null or empty text is scored by the bias alone; a score of just the threshold goes. Null and repeated ids are no
    obstacle: each row is scored by its own text, and repeated rows go or stay together.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Texts that are null, empty or without words link with nothing and stay, as do rows without an id; a similarity of just 0.75
    links. Rows of one id stay or go together.
    """
    return jaccard.representatives(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds none and stays; an item of no words is in no text. Rows of one id stay or go together; rows
    without an id stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; ``n_chars`` is that of the masked text.

    No row goes. A null text stays null with its ``n_chars``, an empty one stays empty; overlapping secrets are one mark;
    ids aren't looked at, so equal texts are masked alike.
    """
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests, with what decoding gives back.

    A null text counts as empty and has no tokens; null and repeated ids are passed on, one row each.
    """
    return bpe.report(bpe.round_trip(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_test_items),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokenised),
]

#: SQL can't express the learned and the hashed stages; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
