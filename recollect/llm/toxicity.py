"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of its pairs of neighbours and of its pairs
with one word between. Each coordinate has its own learning rate, and L1 keeps most weights at zero,
so what is broadcast is small: at most 2**BITS weights, whatever the data.

Labels are learned from a bounded sample of rows that aren't held out. The sample is dealt into a
few parts that learn on their own; their weights are averaged per coordinate.

A null text counts as empty and gets the model's bias; null ids are never in the held-out part nor
in the sample; repeated rows each get their score; without labels every score is 0; an empty table gives
an empty table. Whole texts are scored, however long, one CHUNK_BYTES of texts (or one text) at a time.
Other columns, whatever their names, aren't read; ``clean`` passes them on. Labels, language, source and
id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, map_batches, quoted

BITS = 20
#: Labelled rows learned from at most, rows of a part that learns on its own (about), and passes over each part.
SAMPLE, PART_ROWS, EPOCHS = 24_000, 8_000, 4
#: FTRL: rate, its offset and L2.
ALPHA, BETA, L2 = 0.5, 1.0, 1.0
#: L1 is the number of toxic rows of a part over PER_L1, within these bounds; features in fewer rows than
#: the toxic rows over PER_LEAST, within bounds, aren't learned: they would only recall single texts.
PER_L1, L1_BOUNDS = 30, (1.0, 12.0)
PER_LEAST, LEAST_BOUNDS = 40, (2, 8)
#: A row is called toxic from this score on.
THRESHOLD = 0.3
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hashed(words: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a run of documents, with repeats, and the document of each."""
    h, doc, shift = words.hash, words.doc, np.uint64(64 - BITS)
    parts, docs = [h >> shift], [doc]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            inside = doc[:-gap] == doc[gap:]
            parts.append((tv.mix(h[:-gap] * factor + h[gap:]) >> shift)[inside])
            docs.append(doc[:-gap][inside])
    return np.concatenate(parts).astype(np.int64), np.concatenate(docs)


def _each(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct buckets of each text."""
    for _, _, data, start in tv.chunks(texts):
        bucket, doc = hashed(tv.Words(data, start))
        order = np.argsort(doc, kind="stable")
        at = np.searchsorted(doc[order], np.arange(len(start)))
        for d in range(len(start) - 1):
            yield np.unique(bucket[order[at[d] : at[d + 1]]]).astype(np.int32)


class Ftrl:
    """State of one learner: per coordinate the adjusted gradient sum z and the squared gradient sum n; the last one is the bias."""

    def __init__(self, l1: float):
        self.l1 = l1
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(i == 1 << BITS, 0.0, self.l1), 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)

    def learn(self, i: np.ndarray, label: float) -> None:
        w = self.weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def _learner(part: pd.DataFrame) -> pd.DataFrame:
    """Weights that aren't zero, learned from one part of the sample; rows in the order of their hash."""
    part = part.sort_values(["at", "doc_id"])
    labels = part["label"].to_numpy(dtype=float)
    toxic = float((labels > 0).sum())
    model, bias = Ftrl(float(np.clip(toxic / PER_L1, *L1_BOUNDS))), np.array([1 << BITS])
    rows, often = list(_each(pa.array(part["text"], pa.string()))), np.zeros(1 << BITS, dtype=np.int64)
    for x in rows:
        often[x] += 1
    common = often >= np.clip(toxic / PER_LEAST, *LEAST_BOUNDS)
    rows = [np.append(x[common[x]], bias) for x in rows]
    for _ in range(EPOCHS):
        for x, y in zip(rows, labels, strict=True):
            model.learn(x, y)
    w = model.weights(np.arange((1 << BITS) + 1))
    some = np.flatnonzero(w)
    return pd.DataFrame({"bucket": some, "weight": w[some]})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Averaged weights of the parts; the last one is the bias."""
    known = labels.where(quoted(label).isNotNull() & quoted(doc_id).isNotNull()).groupBy(quoted(doc_id).alias("doc_id")).agg(F.max(quoted(label)).cast("double").alias("label"))
    chosen = known.where(~held_out(F.col("doc_id"))).withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(sample)
    chosen = cut(chosen)
    known_rows = chosen.count()
    if not known_rows:
        return np.append(np.zeros(1 << BITS, dtype=np.float32), np.float32(-np.inf))
    parts = max(1, round(known_rows / PART_ROWS))
    texts = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.shiftright("at", 7), F.lit(parts)))  # at most ``sample`` rows are broadcast
    learned = rows.groupBy("part").applyInPandas(_learner, "bucket long, weight double")
    averaged = learned.groupBy("bucket").agg((F.sum("weight") / parts).alias("weight")).toPandas()
    out = np.zeros((1 << BITS) + 1, dtype=np.float32)
    out[averaged["bucket"].to_numpy(dtype=np.int64)] = averaged["weight"].to_numpy()
    return out


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The score of each text, 0 to 1."""
    out = [np.zeros(0)]
    for _, _, data, start in tv.chunks(texts):
        bucket, doc = hashed(tv.Words(data, start))
        some = np.flatnonzero(weights[bucket])
        bucket, doc = bucket[some], doc[some]
        once = np.unique(bucket + (doc << (BITS + 1)))
        total = np.bincount(once >> (BITS + 1), weights=weights[once & ((1 << (BITS + 1)) - 1)], minlength=len(start) - 1)
        out.append(1.0 / (1.0 + np.exp(-np.clip(total + weights[-1], -35, 35))))
    return np.concatenate(out)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id=doc_id, text=text))
    df = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), shared.value))], ["doc_id", "score"])

    scored = map_batches(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that aren't called toxic, with all their columns; whole rows pass through the Python task in small batches."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id=doc_id, text=text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), shared.value) < THRESHOLD))

    return map_batches(docs, run, docs.schema)
