"""Benchmark decontamination: BM25 over test items with block-max upper bounds, then question and answer overlap.

Test items are put in an inverted index. Impacts are divided by the item's threshold, a share of the
score that the item gives itself, so that an item is retrieved when its sum reaches 1. Postings are
cut into blocks of items, and each term keeps its largest impact overall and per block. Passages are
queries: windows of a text's words, wide enough for the longest item, half a window apart. A passage
goes on only if its terms' upper bounds reach 1, then only into blocks whose bounds reach 1; there all
items at or above the threshold are retrieved, not only the best. What is retrieved is verified on
five-word shingles: either shares of the item's question and of its answer (the last sentences, LEAST_ANSWER
words or more) stand in the text, or a share of all the item's shingles does, wherever they are.

Statistics are those of all items, so an item's score doesn't depend on how items are dealt. Items of
like length (classes of a factor of two) form an index of their own, whose windows are as wide as the
longest of its class, so that one long item doesn't widen the windows of the others. Indexes are
broadcast; those of one reading of the documents hold INDEX_BYTES of text at most (or one item), and
with more items the documents are read again.

Shingles are looked for in the whole text, not only in the passage retrieved. Null texts have no words;
items without words are never found; null or repeated document ids are passed on; items that occur more
than once count once; items with the same score or at a threshold are all returned; an empty table gives
an empty table; texts of any length are taken whole, window by window; columns are those named, whatever
the names of others (``clean`` passes all on).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, map_batches, quoted

K1, B = 1.2, 0.75
#: The share of an item's own score that a passage must reach; items of a block; words of half a window at least.
SHARE, BLOCK, HALF = 0.4, 16, 64
#: The shares of a question's and of an answer's shingles that must stand in the text.
QUESTION, ANSWER, WORDS = 0.5, 0.5, 5
#: The share of all an item's shingles that is enough by itself; words of an answer at least, where the item has twice as many.
WHOLE, LEAST_ANSWER = 0.5, 8
#: Bytes of the items of one reading, and upper bounds or postings expanded at once.
INDEX_BYTES, EXPANDED = 8 << 20, 2_000_000
_SLOTS = 20

#: Bytes that aren't part of a word: ASCII other than letters and digits.
_APART = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def _words(texts: list[str]) -> tv.Words:
    raw = [t.encode() for t in texts]
    return tv.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))).astype(np.int64), is_space=_APART)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start[i] .. start[i] + size[i] - 1 for all i, and the i of each."""
    owner = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    return np.arange(len(owner)) - first[owner] + start[owner], owner


class Index:
    """Inverted index of test items with upper bounds by term and by block, and the shingles of each item."""

    def __init__(self, ids: list, texts: list[str], half: int, often: dict[int, int], n_all: int, mean_length: float):
        """``half``: half a window's words, as many as the longest item has; of all items: in how many a term occurs, their number and mean length."""
        words = _words(texts)
        length = np.diff(words.first)
        keep = np.flatnonzero(length > 0)
        self.ids = [ids[i] for i in keep]
        self.half = half
        n = len(keep)
        number = np.full(len(texts), -1)
        number[keep] = np.arange(n)
        self.terms, term = np.unique(words.hash, return_inverse=True)
        both, count = np.unique(term * max(n, 1) + number[words.doc], return_counts=True)
        term, item = both // max(n, 1), both % max(n, 1)
        within = np.array([often[t] for t in self.terms.tolist()], dtype=float)
        size = length[keep] / max(mean_length, 1e-9)
        impact = np.log1p((n_all - within[term] + 0.5) / (within[term] + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * size[item]))
        own = np.bincount(item, weights=impact, minlength=n)
        self.weight = impact / (SHARE * own[item])
        self.item = item
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.bound = np.maximum.reduceat(self.weight, self.start[:-1]) if len(term) else np.empty(0)
        self.n_blocks = n // BLOCK + 1
        block = term * self.n_blocks + item // BLOCK
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.empty(0, dtype=np.int64)
        self.block = block[first] % self.n_blocks
        self.block_bound = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.block_start = np.searchsorted(block[first] // self.n_blocks, np.arange(len(self.terms) + 1))
        self.slot = np.zeros(1 << _SLOTS, dtype=bool)
        self.slot[self.terms >> np.uint64(64 - _SLOTS)] = True
        self.question, self.answer, self.whole = [], [], []
        for i in keep:
            own_words = words.hash[words.first[i] : words.first[i + 1]]
            asked = self._asked(texts[i], len(own_words))
            shingles = _shingles(own_words)
            cut = max(0, min(asked - WORDS + 1, len(shingles)))
            self.question.append(np.unique(shingles[:cut]))
            self.answer.append(np.unique(shingles[cut:]))
            self.whole.append(np.unique(shingles))

    @staticmethod
    def _asked(text: str, n: int) -> int:
        """Words of the question: all but the last sentences that have LEAST_ANSWER words together, or two thirds without such sentences."""
        text = text.strip()
        for end in reversed([m.end() for m in re.finditer(r"[.!?]+\s+|\n", text)]):
            asked = len(_words([text[:end]]).hash)
            if 0 < asked <= n - LEAST_ANSWER:
                return asked
        return min(n * 2 // 3, max(n - LEAST_ANSWER, n // 2))

    def passages(self, words: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, score) of all that reaches the threshold, best passage of each."""
        none = np.empty(0, dtype=np.int64)
        at = np.flatnonzero(self.slot[words.hash >> np.uint64(64 - _SLOTS)])
        if not len(at) or not self.ids:
            return none, none, none.astype(float)
        term = np.minimum(np.searchsorted(self.terms, words.hash[at]), len(self.terms) - 1)
        real = self.terms[term] == words.hash[at]
        at, term = at[real], term[real]
        doc = words.doc[at]
        part = (at - words.first[doc]) // self.half
        parts = np.diff(words.first) // self.half + 1
        base = np.cumsum(parts) - parts
        window = base[doc] + part
        second = part > 0
        key = np.unique(np.concatenate((window, window[second] - 1)) * len(self.terms) + np.concatenate((term, term[second])))
        window, term = key // len(self.terms), key % len(self.terms)
        may = np.bincount(window, weights=self.bound[term], minlength=int(parts.sum())) >= 1 - 1e-9
        on = may[window]
        window, term = window[on], term[on]
        owner = np.repeat(np.arange(words.n_docs), parts)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cost = np.cumsum(self.start[term + 1] - self.start[term] + self.block_start[term + 1] - self.block_start[term])
        begin = 0
        while begin < len(term):
            end = int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + EXPANDED, side="right"))
            end = max(end, begin + 1)
            if end < len(term):  # whole windows only
                back = int(np.searchsorted(window, window[end], side="left"))
                end = back if back > begin else int(np.searchsorted(window, window[begin], side="right"))
            found.append(self._scored(window[begin:end], term[begin:end]))
            begin = end
        if not found:
            return none, none, none.astype(float)
        window, item, score = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = owner[window] * len(self.ids) + item
        order = np.lexsort((-score, pair))
        first = np.concatenate(([True], pair[order][1:] != pair[order][:-1])) if len(pair) else np.empty(0, dtype=bool)
        pair, score = pair[order][first], score[order][first]
        return pair // len(self.ids), pair % len(self.ids), score

    def _scored(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks whose bounds reach the threshold, then their items."""
        names, row = np.unique(window, return_inverse=True)
        at, owner = _spread(self.block_start[term], self.block_start[term + 1] - self.block_start[term])
        reach = np.bincount(row[owner] * self.n_blocks + self.block[at], weights=self.block_bound[at], minlength=len(names) * self.n_blocks) >= 1 - 1e-9
        at, owner = _spread(self.start[term], self.start[term + 1] - self.start[term])
        on = reach[row[owner] * self.n_blocks + self.item[at] // BLOCK]
        at, owner = at[on], owner[on]
        key, which = np.unique(row[owner] * len(self.ids) + self.item[at], return_inverse=True)
        score = np.bincount(which, weights=self.weight[at], minlength=len(key))
        good = score >= 1 - 1e-9
        return names[key[good] // len(self.ids)], key[good] % len(self.ids), score[good]

    def verified(self, words: tv.Words) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) of what holds."""
        last, own = -1, np.empty(0, dtype=np.uint64)
        for doc, item, score in zip(*(x.tolist() for x in self.passages(words)), strict=True):
            if doc != last:
                last, own = doc, np.unique(_shingles(words.hash[words.first[doc] : words.first[doc + 1]]))
            asked, answered = (float(np.isin(x, own).mean()) if len(x) else 1.0 for x in (self.question[item], self.answer[item]))
            if (asked >= QUESTION and answered >= ANSWER) or float(np.isin(self.whole[item], own).mean()) >= WHOLE:
                yield doc, item, score * SHARE, asked, answered


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of five words in a row; of the whole sequence if it is shorter."""
    size = min(WORDS, len(h))
    total = np.zeros(len(h) - size + 1 if size else 0, dtype=np.uint64)
    for k in range(size):
        total += h[k : len(h) - size + 1 + k] * tv._POSITION[k]
    return tv.mix(total + np.uint64(size))


def _half(n: int) -> int:
    """Half a window's words for an item of n words: the upper end of its class of lengths."""
    return max(HALF, 1 << max(n - 1, 0).bit_length())


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = INDEX_BYTES) -> Iterator[list[Index]]:
    """The indexes of each reading of the documents; those of one reading at a time reach the driver, and the statistics of their terms."""
    rows = items.where(quoted(text).isNotNull()).select(quoted(item_id).alias("id"), quoted(text).alias("text")).distinct()
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, start in tv.chunks(batch.column(1)):
                words = tv.Words(data, start, is_space=_APART)
                length = np.diff(words.first)
                own = [np.unique(words.hash[a:b]).view(np.int64) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(length), pa.array([_half(n) for n in length.tolist()]), pa.array(own, pa.list_(pa.int64()))], ["id", "text", "n", "half", "terms"])

    known = cut(map_batches(rows, run, f"id {kind}, text string, n long, half long, terms array<long>").where("n > 0"))
    classes = known.groupBy("half").agg(F.count("*").alias("n"), F.sum("n").alias("words"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("half").collect()
    n_all, mean = sum(r["n"] for r in classes), sum(r["words"] for r in classes) / max(1, sum(r["n"] for r in classes))
    often = known.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("often"))
    readings: list[list[tuple[int, int, int]]] = []
    room = 0
    for r in classes:
        parts = -(-r["bytes"] // most)
        for k in range(parts):
            if r["bytes"] // parts > room or not readings:
                readings.append([])
                room = most
            room -= r["bytes"] // parts
            readings[-1].append((r["half"], k, parts))
    for reading in readings:
        out = []
        for half, k, parts in reading:
            part = known.where((F.col("half") == half) & (F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k))
            own = part.select("id", "text").orderBy("id", "text").collect()
            terms = part.select(F.explode("terms").alias("term")).distinct().join(often, "term").collect()
            out.append(Index([r["id"] for r in own], [r["text"] for r in own], half, {r["term"] % (1 << 64): r["often"] for r in terms}, n_all, mean))
        yield out


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = INDEX_BYTES) -> DataFrame:
    """One row per document and test item that it holds: ids, ``score`` (share of the item's own BM25), overlaps."""
    df = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    names, kinds = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"], [df.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString(), "double", "double", "double"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    out = None
    for reading in indexes(items, item_id, item_text, most):
        shared = df.sparkSession.sparkContext.broadcast(reading)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, start in tv.chunks(batch.column(1)):
                    words = tv.Words(data, start, is_space=_APART)
                    for index in shared.value:
                        rows = list(index.verified(words))
                        if rows:
                            doc, item, *rest = zip(*rows, strict=True)
                            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(doc)), pa.array([index.ids[k] for k in item], pa.array(index.ids).type), *(pa.array(x, pa.float64()) for x in rest)], names)

        part = map_batches(df, run, schema)
        out = part if out is None else out.union(part)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = INDEX_BYTES) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    at = docs.columns.index(text)
    for reading in indexes(items, item_id, item_text, most):
        shared = docs.sparkSession.sparkContext.broadcast(reading)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for i, _, data, start in tv.chunks(batch.column(at)):
                    words = tv.Words(data, start, is_space=_APART)
                    for index in shared.value:
                        for doc, *_ in index.verified(words):
                            keep[i + doc] = False
                yield batch.filter(pa.array(keep))

        docs = map_batches(docs, run, docs.schema)
    return docs
