"""Streams of queries and of training rows, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.statistics import occurrences
from ..model import MemoryBasedLearner
from ..operators.versions import VersionedBase


def classify(learner: MemoryBasedLearner, queries: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers each micro-batch of ``queries`` with a fitted learner, as Parquet below ``target``.

    A batch's folder is overwritten when the batch is run again, so a restart leaves no answer twice.
    """

    def answer(rows: DataFrame, number: int) -> None:
        out = learner.transform(rows)
        out.drop("votes").write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def maintain(base: VersionedBase, rows: DataFrame, checkpoint: str, sign: int = 1, once: bool = False) -> StreamingQuery:
    """Adds each micro-batch of training rows to a versioned base (or takes it away), once even after a restart."""
    writer = rows.writeStream.foreachBatch(base.writer(sign)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def patterns(rows: DataFrame, features: list[str]) -> DataFrame:
    """The table of patterns of a stream of training rows: counts that grow (or fall, with negative ``occ``)."""
    return rows.groupBy(*features, "class").agg(F.min("iid").alias("iid"), F.sum(occurrences(rows)).alias("occ"))


def recent_patterns(rows: DataFrame, features: list[str], at: str, width: str, late: str) -> DataFrame:
    """Patterns by window of event time ``at``; rows later than ``late`` are dropped by the watermark."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), *features, "class").agg(F.sum(occurrences(rows)).alias("occ"))
