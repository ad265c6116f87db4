"""Quality rules: rule statistics of whole texts, and an isolation forest over them.

The statistics are exact counts over all documents (equal lines and word windows are found by 64-bit
hashes). The forest is fitted on a bounded sample of rows labelled good; how easily random splits isolate a
document is its anomaly score, counted in BINS steps, and the cut-off is calibrated on all labelled rows.
Documents at the cut-off are kept.

A null text counts as empty; null or repeated ids are passed on; an empty table gives an empty table;
without labels only the base rules decide. Whole texts are counted, however long. Other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, map_batches, quoted

SYMBOLS = b"#*$%&|<>"
#: Base rules: the least number of words, and the largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Rows labelled good that fit the forest at most; trees, rows of a tree, and the seed.
SAMPLE, TREES, TREE_ROWS, SEED = 20_000, 100, 256, 7
#: The share of labelled good documents that the cut-off must keep at least.
KEEP_GOOD = 0.98
#: Steps of the anomaly score.
BINS = 4096

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_distinct")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "digits", "upper", "distinct", "line_words")


def _flags(letters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(letters)] = True
    return out


_SYMBOL, _DIGIT, _UPPER = _flags(SYMBOLS), _flags(b"0123456789"), _flags(bytes(range(65, 91)))
_BREAK = _flags(b"\n")


def _per_doc(flag: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=total[1:])
    return total[start[1:]] - total[start[:-1]]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element, whether it is the first of its value in sorted order, and how often its value occurs."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(key), dtype=bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    first, often = np.empty(len(key), dtype=bool), np.empty(len(key), dtype=np.int64)
    first[order] = new
    often[order] = np.repeat(size, size)
    return first, often


def _of_doc(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return tv.mix(key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def counts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """COUNTS of each document of a run, one row per document."""
    words = tv.Words(data, start, lower=False)
    lines = tv.Words(data, start, is_space=_BREAK, lower=False)
    n = words.n_docs
    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    out[:, 0] = np.diff(words.first)
    out[:, 1] = _per_doc(((data & 0xC0) != 0x80) & ~tv._SPACE[data], start)
    out[:, 2] = _per_doc(_SYMBOL[data], start)
    worded = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    doc = lines.doc[worded]
    if len(doc):
        first, _ = _groups(_of_doc(lines.hash[worded], doc))
        out[:, 3] = np.bincount(doc[~first], minlength=n)
        out[:, 5] = np.bincount(doc, minlength=n)
    if len(words.hash) >= WINDOW:
        m = len(words.hash) - WINDOW + 1
        hashes, doc = tv.windows(words, WINDOW)
        at = np.flatnonzero(words.doc[:m] == words.doc[WINDOW - 1 :])
        if len(doc):
            _, often = _groups(_of_doc(hashes, doc))
            edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
            again = at[often > 1]
            np.add.at(edge, again, 1)
            np.add.at(edge, again + WINDOW, -1)
            out[:, 4] = np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    out[:, 6] = _per_doc(_DIGIT[data], start)
    out[:, 7] = _per_doc(_UPPER[data], start)
    if len(words.hash):
        first, _ = _groups(_of_doc(words.hash, words.doc))
        out[:, 8] = np.bincount(words.doc[first], minlength=n)
    return out


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and COUNTS as long."""
    df = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, start in tv.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(c) for c in counts(data, start).T.copy())], ["doc_id", *COUNTS])

    kind = df.schema["doc_id"].dataType.simpleString()
    return map_batches(df, run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES from COUNTS."""
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    chars = np.maximum(c["word_chars"], 1)
    return np.column_stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_digits"] / chars, c["n_upper"] / words, c["n_distinct"] / words, c["n_words"] / lines])


def _unsuccessful(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a failed search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: the feature and value a node splits by, its left child, and its path length if a leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(self.rows, 2)))))
        self.trees = [self._grow(x[random.choice(len(x), self.rows, replace=False)], random) for _ in range(trees)]

    def _grow(self, x: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, left, length = [], [], [], []

        def node() -> int:
            for column, empty in ((feature, -1), (value, 0.0), (left, 0), (length, 0.0)):
                column.append(empty)
            return len(feature) - 1

        waiting = [(node(), x, 0)]
        while waiting:
            k, rows, depth = waiting.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth >= self.depth or len(rows) < 2 or not len(varied):
                length[k] = depth + float(_unsuccessful(len(rows)))
                continue
            f = int(random.choice(varied))
            v = float(random.uniform(low[f], high[f]))
            feature[k], value[k], left[k] = f, v, node()
            node()
            below = rows[:, f] <= v
            waiting += [(left[k], rows[below], depth + 1), (left[k] + 1, rows[~below], depth + 1)]
        return np.array(feature), np.array(value), np.array(left), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: near 1 where few random splits isolate it."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[every, np.maximum(f, 0)] > value[at]))
            total += length[at]
        norm = max(float(_unsuccessful(self.rows)), 1e-9)
        return np.exp2(-total / len(self.trees) / norm)


def calibrate(step: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = KEEP_GOOD) -> int:
    """From counts of good and bad rows at each step, in order: the step up to which rows are kept.

    It has the largest share of bad rows above it less that of good ones, keeping ``keep`` of the good.
    """
    if not good.sum() or not bad.sum():
        return BINS
    kept_good, kept_bad = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    return int(step[int(np.argmax(np.where(kept_good >= keep, kept_good - kept_bad, -1.0)))])


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: COUNTS, ``base_failed``, ``anomaly`` and ``kept``.

    The forest is fitted on at most ``sample`` rows labelled good, chosen by a hash of their id (on all labelled rows
    where none is good): what good rows isn't like is odd, however many bad rows are alike. Calibration
    counts all labelled rows that pass the base rules, since it decides for those only.
    """
    stats = cut(statistics(docs, doc_id, text)).withColumn("base_failed", base_failed())
    known = labels.where(quoted(label).isNotNull()).groupBy(quoted(doc_id).alias("doc_id")).agg(F.max(quoted(label)).alias("label"))
    labelled = cut(stats.join(known, "doc_id"))
    some = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(*COUNTS).toPandas()
    fit = some(labelled.where("label > 0"))
    fit = fit if len(fit) else some(labelled)
    forest = Forest(features({c: fit[c].to_numpy() for c in COUNTS})) if len(fit) else None
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(*columns: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.zeros(len(columns[0])))
        return pd.Series(shared.value.score(features({c: s.to_numpy() for c, s in zip(COUNTS, columns, strict=True)})))

    step = F.floor(F.col("anomaly") * BINS).cast("int")
    counted = labelled.where("not base_failed").withColumn("anomaly", anomaly(*COUNTS)).groupBy(step.alias("step"))
    bins = counted.agg(F.sum((F.col("label") > 0).cast("long")).alias("good"), F.sum((F.col("label") <= 0).cast("long")).alias("bad")).orderBy("step").collect() if forest else []
    cutoff = calibrate(*(np.array([r[c] for r in bins]) for c in ("step", "good", "bad"))) if bins else BINS
    return stats.withColumn("anomaly", anomaly(*COUNTS)).withColumn("kept", ~F.col("base_failed") & (step <= cutoff))


def report(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
