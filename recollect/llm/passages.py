"""Substring dedup: MinHash banding over short paragraphs, verified by exact Jaccard, clustered by components.

A paragraph here is a window of WINDOW words that begins at an anchor: a sentence's first word, or, of
SPAN places in a row without one, the place of the smallest shingle hash, so that every stretch of SPAN +
WINDOW - 1 words that two texts share has a paragraph in common. Each has BANDS keys of ROWS minima over
its shingles, tuned by ``tune`` to find similar paragraphs with high probability, and a key of all its
shingles, its content, by which equal ones always meet. Keys are packed by bucket for the shuffle. In a bucket, paragraphs of one
content give a star; different contents under a band's key are all compared, a paragraph standing for
each. Under a key with more than CROWD contents (a frequent phrase) similar paragraphs aren't paired but
connected: all that keep the same shingles when SPARE are left out are similar, and go with a representative
of them. The Jaccard similarity of the shingles is then computed from both paragraphs. Verified paragraphs that follow each other form
runs, extended word by word; runs of ``least`` words that overlap on the compared side, directly or through
another text, form a component, of which the run in the smallest document is kept.

Passages that a text repeats within itself aren't sought: only what stands in different texts. Equal texts
are one node until the result, where each copy gets its runs. Shingles have five words and
are compared by 32-bit hashes within one comparison; a similarity of just SIMILAR counts. Null and empty
texts have no paragraphs, texts shorter than WINDOW words neither; texts of any length are taken whole;
rows without an id take no part; repeated rows count once; an empty
table gives an empty table; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, map_batches, quoted, stored
from .components import components

WORDS, WINDOW, SIMILAR = 5, 24, 0.75
SHINGLES = WINDOW - WORDS + 1
#: Shingles that may be left out of a whole paragraph's set so that it's still similar: two sets of n with i in common have i / (2n - i).
SPARE = SHINGLES - math.ceil(2 * SHINGLES * SIMILAR / (1 + SIMILAR))
#: Words of a passage that is reported at least, where nothing else is asked for.
LEAST = WINDOW
#: Places in a row of which one is an anchor; the step between anchors where one word is repeated.
SPAN, GAP = 16, 8
#: The least probability that a pair of similar paragraphs collides, and keys of a paragraph at most.
RECALL, MOST_BANDS = 0.98, 6
#: Contents under a key that are all compared; with more, the prefix filter finds the similar ones.
CROWD = 12
#: Cells in which the shingles of crowds are counted.
CELLS = 1 << 18
#: Entries of a batch, and of a bucket (about); partitions that buckets are dealt to at most (a task takes one bucket after the other).
BATCH_ENTRIES, BUCKET_ENTRIES, MOST_PARTITIONS = 1_000_000, 1_400_000, 20_000
#: Partners of a text that are verified in one group.
PARTNERS = 64
#: Parts that the rows of a component are dealt to.
SALTS = 32
#: Paragraphs that follow each other within so many words, on both sides, belong to one run.
NEAR = 16
#: Bytes of text that are hashed together (their arrays stay in the processor's cache), and paragraphs that are compared together, about.
TEXT_BYTES, COMPARED = 1 << 18, 1 << 13
_U = np.uint64
_LOW, _CONTENT = _U((1 << 32) - 1), _U((1 << 24) - 1)


def tune(similar: float = SIMILAR, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band, then the fewest bands, that reach the recall."""
    for rows in (4, 3, 2, 1):
        for bands in range(1, most + 1):
            if 1 - (1 - similar**rows) ** bands >= recall:
                return bands, rows
    return most, 1


BANDS, ROWS = tune()
#: The bands' keys and that of all shingles.
KEYS = BANDS + 1
_PERMUTE = tv.mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x8CB92BA72F3D8DD7)) | _U(1)
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def shingles(words: tv.Words) -> np.ndarray:
    """Hash of the shingle that begins at each word; those that leave a document are never used."""
    h = words.hash
    n = max(len(h) - WORDS + 1, 0)
    total = np.zeros(n, dtype=_U)
    for k in range(WORDS):
        total += h[k : n + k] * tv._POSITION[k]
    return tv.mix(total)


def sentence_starts(words: tv.Words) -> np.ndarray:
    """Whether each word is the first one of a sentence, a line or a document."""
    chosen = np.zeros(len(words.hash), dtype=bool)
    chosen[:1] = True
    chosen[1:] = _END[words.data[words.end[:-1] - 1]] | (words.doc[1:] != words.doc[:-1])
    behind = np.searchsorted(words.start, np.flatnonzero(words.data == 10))
    chosen[behind[behind < len(chosen)]] = True
    return chosen


def anchors(words: tv.Words, shingle: np.ndarray) -> np.ndarray:
    """Word numbers (in the run of documents) where a whole paragraph begins.

    Besides the sentences' first words, each SPAN places in a row where a paragraph of one document can
    begin, and where no sentence does behind the first one, give the first place of the smallest shingle hash,
    whatever stands around them: two texts that share SPAN + WINDOW - 1 words in a row have an anchor in common there.
    """
    n = len(words.hash)
    if n < WINDOW:
        return np.empty(0, dtype=np.int64)
    chosen = sentence_starts(words)
    places = n - WINDOW + 1
    whole = words.doc[:places] == words.doc[WINDOW - 1 :]
    # Hash above, place below: the first of equal ones is the smallest.
    x = (shingle[:places] & ~_U(0xFFFFFFFF)) | np.arange(places, dtype=_U)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        width += step
    inside = whole[: len(x)] & (words.doc[: len(x)] == words.doc[SPAN + WINDOW - 2 :][: len(x)]) if len(x) else np.empty(0, dtype=bool)
    begun = np.concatenate(([0], np.cumsum(chosen)))
    if len(x):
        inside &= begun[SPAN : SPAN + len(x)] == begun[1 : 1 + len(x)]
    picked = np.zeros(places, dtype=bool)
    picked[(x[inside] & _U(0xFFFFFFFF)).astype(np.int64)] = True
    # In a row of equal paragraphs (one word again and again) every GAP-th and the last are enough, since their keys are equal.
    equal = np.zeros(places, dtype=bool)
    if places > 1:
        changes = np.concatenate(([0], np.cumsum(words.hash[1:] != words.hash[:-1])))
        equal[1:] = picked[1:] & picked[:-1] & (changes[WINDOW:] == changes[: places - 1])
        start = np.maximum.accumulate(np.where(equal, 0, np.arange(places)))
        last = np.concatenate((~equal[1:], [True]))
        picked &= ~equal | ((np.arange(places) - start) % GAP == 0) | last
    return np.flatnonzero((picked | chosen[:places]) & whole)


def _mixed(x: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """``tv.mix`` in place, with room for what is shifted."""
    x ^= np.right_shift(x, _U(30), out=shifted)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, _U(27), out=shifted)
    x *= _U(0x94D049BB133111EB)
    x ^= np.right_shift(x, _U(31), out=shifted)
    return x


def keys(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """KEYS of each paragraph, one row each: those of the bands, then one of all its shingles, the content."""
    minima = []
    mixed, shifted = np.empty_like(shingle), np.empty_like(shingle)
    for factor in _PERMUTE:
        x = _mixed(np.multiply(shingle, factor, out=mixed), shifted)
        width = 1
        while width * 2 <= SHINGLES:
            x = np.minimum(x[:-width], x[width:], out=x[:-width])
            width *= 2
        minima.append(np.minimum(x[at], x[at + SHINGLES - width]))
    out = []
    for band in range(BANDS):
        total = np.full(len(at), band + 1, dtype=_U)
        for row in range(ROWS):
            total = tv.mix(total ^ minima[band * ROWS + row])
        out.append(total)
    summed = np.zeros(len(shingle) + 1, dtype=_U)
    np.cumsum(tv.mix(shingle + _U(BANDS + 1)), out=summed[1:])
    out.append(tv.mix(summed[at + SHINGLES] - summed[at]))
    return np.stack(out, axis=1)


def text_mark(words: tv.Words) -> np.ndarray:
    """A fingerprint of each document's sequence of words."""
    n = len(words.hash)
    total = np.zeros(n + 1, dtype=_U)
    place = np.arange(n) - words.first[words.doc]
    np.cumsum(tv.mix(words.hash + tv.mix(place.astype(_U))), out=total[1:])
    return tv.mix(total[words.first[1:]] - total[words.first[:-1]] + np.diff(words.first).astype(_U)).view(np.int64)


#: kind 0: a document (a: id, b: mark, n: words); 3: packed keys of a bucket; 1: paragraphs of mark a like ones of mark b;
#: 2: a paragraph under a crowded key (a: mark, b: key, n: first word).
ROW = "kind int, bucket long, a long, b long, n long, payload binary"
_NAMES = [f.split()[0] for f in ROW.split(", ")]


def _rows(kind: int, size: int, bucket, a=None, b=None, n=None, payload=None) -> pa.RecordBatch:
    longs = [pa.nulls(size, pa.int64()) if v is None else v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in (bucket, a, b, n)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, dtype=np.int32)), *longs, pa.nulls(size, pa.binary()) if payload is None else payload if isinstance(payload, pa.Array) else pa.array(payload, pa.binary())], _NAMES)


def _starts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, dtype=np.int64)
    return start, np.diff(np.append(start, len(x)))


def index(docs: DataFrame, buckets: int) -> DataFrame:
    def flush(marks: list, places: list, keyed: list) -> Iterator[pa.RecordBatch]:
        if not keyed:
            return
        mark, place, key = np.concatenate(marks), np.concatenate(places), np.concatenate(keyed)
        # Each paragraph has the key of its content; one for each content of the batch has those of the bands.
        order = np.argsort(key[:, -1])
        wanted = np.zeros(key.shape, dtype=bool)
        wanted[np.minimum.reduceat(order, _starts(key[order, -1])[0])] = True
        wanted[:, -1] = True
        own, content = np.flatnonzero(wanted) // KEYS, (key[:, -1] >> _U(32)) & _CONTENT
        key = key[wanted]
        bucket = ((key >> _U(40)) % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        # Entries of a text lie together here and stay so in each bucket.
        order = np.argsort(bucket, kind="stable")
        own, key, bucket = own[order], key[order] & _LOW, bucket[order].astype(np.int64)
        mark, place, content = mark[own], place[own], content[own]
        start, size = _starts(bucket)
        payload = []
        wide = "<u4" if place.max() >= 1 << 16 else "<u2"
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            m, p, k, c = mark[s : s + n], place[s : s + n], key[s : s + n], content[s : s + n]
            at, count = _starts(m)
            parts = (len(at).to_bytes(4, "little"), wide[-1].encode(), m[at].astype("<i8").tobytes(), count.astype("<u4").tobytes(), p.astype(wide).tobytes(), k.astype("<u4").tobytes(), c.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
            payload.append(b"".join(parts))
        yield _rows(3, len(start), bucket[start], payload=payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marks, places, keyed, size = set(), [], [], [], 0
        for rows in batches:
            for i, j, data, start in tv.chunks(rows.column(1), TEXT_BYTES):
                words = tv.Words(data, start)
                ids, mark = rows.column(0)[i:j], text_mark(words)
                yield _rows(0, j - i, mark & 0xFFFF, a=ids, b=mark, n=np.diff(words.first))
                shingle = shingles(words)
                at = anchors(words, shingle)
                fresh = np.zeros(j - i, dtype=bool)
                for k, (m, valid) in enumerate(zip(mark.tolist(), ids.is_valid().to_pylist(), strict=True)):
                    if valid and m not in seen:
                        seen.add(m)
                        fresh[k] = True
                at = at[fresh[words.doc[at]]]
                if len(at):
                    marks.append(mark[words.doc[at]])
                    places.append(at - words.first[words.doc[at]])
                    keyed.append(keys(shingle, at))
                    size += KEYS * len(at)
            if size >= BATCH_ENTRIES:
                yield from flush(marks, places, keyed)
                seen, marks, places, keyed, size = set(), [], [], [], 0
        yield from flush(marks, places, keyed)

    return map_batches(docs, run, ROW)


Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _unpack(payload: bytes) -> Entries:
    """Mark, first word, key and content of each entry; under the key of a content, the content tells apart keys that agree by chance."""
    k, wide = int.from_bytes(payload[:4], "little"), int(payload[4:5])
    mark, count = np.frombuffer(payload, "<i8", k, 5), np.frombuffer(payload, "<u4", k, 5 + 8 * k)
    n, at = int(count.sum()), 5 + 12 * k
    place, key = np.frombuffer(payload, f"<u{wide}", n, at), np.frombuffer(payload, "<u4", n, at + wide * n)
    content = np.frombuffer(payload, np.uint8, 3 * n, at + (wide + 4) * n).reshape(-1, 3).astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16], dtype=np.uint32)
    return np.repeat(mark, count), place, key.astype(_U), content


def _collide(parts: list[Entries], bucket: int) -> Iterator[pa.RecordBatch]:
    """Pairs of paragraphs with a key, packed by the two texts: each with the first of its content (with the last one if the first is in its own text), and those first ones, if they aren't a crowd."""
    mark, place, key, content = (np.concatenate(x) for x in zip(*parts, strict=True))
    # What has a key alone gives nothing: most such entries go by a count in cells.
    cell = (key & _U((1 << max(2 * len(key) - 1, 1).bit_length()) - 1)).astype(np.int64)
    some = np.bincount(cell)[cell] > 1
    both = (key[some] << _U(24)) | content[some]
    order = np.argsort(both)
    both, mark, place = both[order], mark[some][order], place[some][order].astype(np.int64)
    start, size = _starts(both)
    # The first and the last paragraph of each content that comes several times.
    head, at = mark[start], place[start]
    several = np.flatnonzero(size > 1)
    again = np.repeat(size > 1, size)
    m, p, n = mark[again], place[again], size[several]
    begin = np.cumsum(n) - n
    low, high = (f.reduceat(m, begin) if len(n) else m for f in (np.minimum, np.maximum))
    first = np.minimum.reduceat(np.where(m == np.repeat(low, n), p, 1 << 32), begin) if len(n) else p
    last = np.maximum.reduceat(np.where(m == np.repeat(high, n), p, -1), begin) if len(n) else p
    head[several], at[several] = low, first
    own = m == np.repeat(low, n)
    rest = ~own | (p != np.repeat(first, n))
    x = [(m[rest], p[rest])]
    y = [(np.where(own, np.repeat(high, n), np.repeat(low, n))[rest], np.where(own, np.repeat(last, n), np.repeat(first, n))[rest])]
    key = both[start] >> _U(24)
    _, size = _starts(key)
    many = np.repeat(size, size)
    few = np.flatnonzero((many > 1) & (many <= CROWD))
    for gap in range(1, CROWD):
        few = few[many[few] > gap]
        together = key[few[gap:]] == key[few[:-gap]]
        left, right = few[gap:][together], few[:-gap][together]
        x.append((head[left], at[left]))
        y.append((head[right], at[right]))
    crowd = np.flatnonzero(many > CROWD)
    if len(crowd):
        yield _rows(2, len(crowd), head[crowd] & 0xFFFF, a=head[crowd], b=(key[crowd] | _U(bucket << 40)).view(np.int64), n=at[crowd])
    (a, p), (b, q) = ([np.concatenate(z) for z in zip(*pairs, strict=True)] for pairs in (x, y))
    swap = a < b
    yield from _packed(np.where(swap, b, a), np.where(swap, q, p), np.where(swap, a, b), np.where(swap, p, q))


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Neighbouring pieces of an array, ``size`` items each, as binary values."""
    offsets = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size * data.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _items(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers of all binary values, one after the other, and how many each has."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4"), np.diff(offsets) // 4


def _packed(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Paragraphs p of texts a like paragraphs q of other texts b, a row for each two texts (seldom two)."""
    other = a != b
    a, p, b, q = a[other], p[other], b[other], q[other]
    if not len(a):
        return
    # Texts above, places below: equal pairs and those of the same texts come to lie together.
    order = np.argsort((tv.mix(a.view(_U) + tv.mix(b.view(_U))) & ~_LOW) | (tv.mix((p << 32 | q).view(_U)) >> _U(32)))
    a, p, b, q = a[order], p[order], b[order], q[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    once = new.copy()
    once[1:] |= (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    a, p, b, q, start = a[once], p[once], b[once], q[once], np.flatnonzero(new[once])
    both = np.stack([p, q], axis=1).astype("<u4")
    yield _rows(1, len(start), b[start] & 0xFFFF, a=a[start], b=b[start], payload=_binary(both.ravel(), 2 * np.diff(np.append(start, len(a)))))


def collide(indexed: DataFrame, partitions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, []
        for rows in batches:
            packed = np.array(rows.column(0)) == 3
            if not packed.all():
                yield rows.filter(pa.array(~packed))
            rows = rows.filter(pa.array(packed))
            for bucket, payload in zip(rows.column(1).to_pylist(), rows.column(5).to_pylist(), strict=True):
                if bucket != now and parts:
                    yield from _collide(parts, now)
                    parts = []
                now = bucket
                parts.append(_unpack(payload))
        if parts:
            yield from _collide(parts, now)

    return map_batches(indexed.repartition(partitions, "bucket").sortWithinPartitions("kind", "bucket"), run, ROW)


def _paragraphs(texts: DataFrame, crowd: DataFrame) -> DataFrame:
    """(mark, place, shingles, again) of the paragraphs ``crowd(mark, place)``; ``again``: two words in a row come twice in it."""
    rows = texts.join(crowd.groupBy("mark").agg(F.collect_set("place").alias("places")), "mark").select("mark", "places", "text")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, j, data, start in tv.chunks(rows.column(2), TEXT_BYTES):
                words = tv.Words(data, start)
                mark = rows.column(0)[i:j].to_numpy()
                right = np.flatnonzero(text_mark(words) == mark)
                places = rows.column(1).take(pa.array(i + right))
                row, place = np.repeat(right, places.value_lengths().to_numpy()), places.flatten().to_numpy()
                if not len(row):
                    continue
                at = (words.first[row] + place)[:, None]
                two = tv.mix(words.hash[:-1] + tv.mix(words.hash[1:]))
                twos = np.sort(two[at + np.arange(WINDOW - 1)], axis=1)
                again = (twos[:, 1:] == twos[:, :-1]).any(axis=1)
                sets = shingles(words)[at + np.arange(SHINGLES)]
                yield pa.RecordBatch.from_arrays([pa.array(mark[row]), pa.array(place), _binary(sets.ravel(), np.full(len(row), SHINGLES)), pa.array(again)], ["mark", "place", "shingles", "again"])

    return stored(map_batches(rows, cut_out, "mark long, place long, shingles binary, again boolean").dropDuplicates(["mark", "place"]), "crowds")


def family_keys(sets: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, short) of paragraphs, by which the similar ones among them meet, and no others.

    Two sets of SHINGLES shingles are similar just if they have all but SPARE in common: a key for each way to leave SPARE
    out. Where no two words in a row come twice, what is common is a row of shingles, so only the ways to leave out the
    ends count; a pair of which one paragraph is so meets by them. A ``short`` set (a shingle comes twice in the
    paragraph) has one key, of the whole set.
    """
    ordered = np.sort(sets, axis=1)
    short = ~_distinct(ordered).all(axis=1)
    mixed = tv.mix(sets + _U(KEYS + 1))
    total = mixed.sum(axis=1, dtype=_U)
    rows, found = [], []
    for out in itertools.combinations(range(SHINGLES), SPARE):
        kept = sorted({*range(SHINGLES)} - {*out})
        at = np.flatnonzero(~short & (again | (kept[-1] - kept[0] < len(kept))))
        rows.append(at)
        found.append(tv.mix(total[at] - mixed[np.ix_(at, out)].sum(axis=1, dtype=_U)))
    at = np.flatnonzero(short)
    rows.append(at)
    found.append(tv.mix(np.where(_distinct(ordered[at]), tv.mix(ordered[at]), _U(0)).sum(axis=1, dtype=_U)))
    rows, found = np.concatenate(rows), np.concatenate(found)
    return rows, found.view(np.int64), short[rows]


def _families(texts: DataFrame, crowd: DataFrame) -> DataFrame:
    """Pairs ``(a, b, payload)`` that connect all similar paragraphs of different texts under crowded keys, from ``crowd(key, mark, place)``.

    What has a family key in common is similar, so the paragraphs under it are a star: each goes with the first one, those
    of the first one's text with the last one. Rows are linear in the paragraphs, however many are alike. Short sets
    that differ have no such key: the first and the last paragraph of each set go through the prefix filter.
    """
    own = _paragraphs(texts, crowd.select("mark", "place").distinct())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets = np.frombuffer(b"".join(rows.column(2).to_pylist()), dtype=_U).reshape(-1, SHINGLES)
            at, key, short = family_keys(sets, rows.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(key), rows.column(0).take(pa.array(at)), rows.column(1).take(pa.array(at)), pa.array(short)], ["key", "mark", "place", "short"])

    keys_ = map_batches(own.select("mark", "place", "shingles", "again"), keyed, "key long, mark long, place long, short boolean")
    one = F.struct("mark", "place")
    ends = keys_.groupBy("key", "short").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    met = keys_.join(ends.where("first.mark <> last.mark"), ["key", "short"])
    partner = F.when(F.col("mark") == F.col("first.mark"), F.col("last")).otherwise(F.col("first"))
    pairs = _oriented(met.select(one.alias("x"), partner.alias("y")))
    sets = ends.where("short")
    few = sets.select("first.*").union(sets.select("last.*")).distinct()
    few = cut(few.withColumn("short", F.lit(True)))
    if few.isEmpty():
        return _by_texts(pairs)
    full = own.select("mark", "place").join(keys_.where("short").select("mark", "place"), ["mark", "place"], "left_anti")
    asked = crowd.join(few, ["mark", "place"])
    rest = crowd.join(asked.select("key").distinct(), "key").join(full, ["mark", "place"]).select("key", "mark", "place", F.lit(False).alias("short"))
    return _by_texts(pairs.union(_prefix_pairs(own, asked.select("key", "mark", "place", "short").union(rest))))


def _oriented(pairs: DataFrame) -> DataFrame:
    """(a, place, b, q) from ``(x, y)``, each a mark and a place: the larger mark first."""
    high, low = F.greatest("x", "y"), F.least("x", "y")
    return pairs.select(high["mark"].alias("a"), high["place"].alias("place"), low["mark"].alias("b"), low["place"].alias("q"))


def _by_texts(pairs: DataFrame) -> DataFrame:
    """``pairs(a, place, b, q)`` packed by the two texts."""
    packed = lambda c: F.concat(*(F.substring(F.lpad(F.hex(F.col(c)), 8, "0"), 7 - 2 * k, 2) for k in range(4)))
    return pairs.distinct().groupBy("a", "b").agg(F.unhex(F.array_join(F.array_sort(F.collect_list(F.concat(packed("place"), packed("q")))), "")).alias("payload"))


def _crowded(texts: DataFrame, crowd: DataFrame) -> DataFrame:
    """All similar pairs ``(a, b, payload)`` of paragraphs under a crowded key, from ``crowd(key, mark, place)``, by the prefix filter alone."""
    return _by_texts(_prefix_pairs(_paragraphs(texts, crowd), crowd.withColumn("short", F.lit(True))))


def _prefix_pairs(own: DataFrame, crowd: DataFrame) -> DataFrame:
    """``(a, place, b, q)``: pairs of ``crowd(key, mark, place, short)`` with one short side at least that share a shingle of their prefixes.

    Similar sets share one of the shingles that are left over beyond what they must share, in any order of all
    shingles. Here rare ones come first, by counts in CELLS cells over all these paragraphs, which are broadcast.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for rows in batches:
            for raw in rows.column(0).to_pylist():
                np.add.at(total, (np.unique(np.frombuffer(raw, dtype=_U)) % _U(CELLS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    often = np.zeros(CELLS, dtype=np.int64)
    for r in map_batches(own.select("shingles"), cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # CELLS rows at most
        often[r["cell"]] = r["n"]
    shared = own.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple[int, int, int, bool]] = []
            for key, mark, place, short, raw in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                x = np.unique(np.frombuffer(raw, dtype=_U))
                ranked = x[np.lexsort((x, shared.value[(x % _U(CELLS)).astype(np.int64)]))]
                keep = ranked[: len(x) - math.ceil(SIMILAR * len(x)) + 1]
                out += [(int(h), mark, place, short) for h in tv.mix(keep ^ _U(key % (1 << 64))).view(np.int64)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], ["key", "mark", "place", "short"])

    found = map_batches(crowd.join(own, ["mark", "place"]).select("key", "mark", "place", "short", "shingles"), prefixes, "key long, mark long, place long, short boolean")
    many = found.groupBy("key").agg(F.count("*").alias("n"), F.max("short").alias("some")).where("n > 1 and some").select("key")
    prefix = stored(found.join(many, "key"), "prefixes")
    one = F.struct("mark", "place")
    other = prefix.select("key", one.alias("y"), F.col("short").alias("both"))
    met = prefix.where("short").select("key", one.alias("x")).join(other, "key")
    return _oriented(met.where(F.col("x.mark") != F.col("y.mark")).where(~F.col("both") | (F.col("x") > F.col("y"))).select("x", "y")).distinct()


def verify(texts: DataFrame, pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """Runs of ``least`` words or more ``(a, start, end, b, from, to)`` (words) of verified paragraphs, from ``pairs(a, b, payload)`` of marks and ``texts(mark, text)``."""
    many = pairs.select("a", "b").distinct().groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    whole = pairs.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list("payload")), F.hex), "").alias("h")).select("a", "b", F.unhex("h").alias("payload"))
    dealt = stored(whole.join(many, "b").select("a", "b", "payload", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")), "passages")
    ones = dealt.select("b", "part", F.lit(1).alias("role"), F.col("a").alias("mark"), "payload")
    zeros = dealt.groupBy("b", "part").agg(F.array_join(F.transform(F.collect_list("payload"), F.hex), "").alias("h")).select("b", "part", F.lit(0).alias("role"), F.col("b").alias("mark"), F.unhex("h").alias("payload"))
    rows = texts.join(ones.union(zeros), "mark").select("b", "part", "role", "mark", "payload", "text")

    pieces = map_batches(rows, cut_out, "b long, part long, role int, mark long, places binary, cuts binary")
    return map_batches(pieces.repartition("b", "part").sortWithinPartitions("b", "part", "role"), lambda batches: compare(batches, least), "a long, start long, end long, b long, `from` long, `to` long")


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the paragraphs that are wanted and SPAN words around each, from ``(b, part, role, mark, payload, text)``: stretches (first word, length) and hashes.

    A text that comes several times in a row is cut into words once.
    """
    for rows in batches:
        text, marks, role = rows.column(5).fill_null(""), rows.column(3).to_numpy(), rows.column(2).to_numpy()
        new = np.ones(len(text), dtype=bool)
        new[1:] = (marks[1:] != marks[:-1]) | pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(text))
        for i, j, data, start in tv.chunks(text.take(pa.array(first)), TEXT_BYTES):
            words = tv.Words(data, start)
            of = np.repeat(np.arange(j - i), (ends - first)[i:j])
            at = np.arange(first[i], ends[j - 1])
            right = text_mark(words)[of] == marks[at]  # otherwise another text under a repeated id
            of, at = of[right], at[right]
            if not len(at):
                continue
            rest = rows.take(pa.array(at))
            both, size = _items(rest.column(4))
            both, row = both.reshape(-1, 2).astype(np.int64), np.repeat(np.arange(len(at)), size // 2)
            p, q = np.where(role[at][row] == 0, both[:, 1], both[:, 0]), both[:, 1]
            order = np.lexsort((q, p, row))
            p, q, row = p[order], q[order], row[order]
            once = np.ones(len(row), dtype=bool)  # a pair may come from several keys
            once[1:] = (row[1:] != row[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            p, q, row = p[once], q[once], row[once]
            places = _binary(np.stack([p, q], axis=1).astype("<u4").ravel(), 2 * np.bincount(row, minlength=len(at)))
            cuts = _stretches(p, row, words.first[of], words.first[of + 1] - words.first[of], words.hash.astype("<u4"))
            yield pa.RecordBatch.from_arrays([*rest.columns[:4], places, cuts], ["b", "part", "role", "mark", "places", "cuts"])


def compare(batches: Iterator[pa.RecordBatch], least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """Runs of the pairs of each group ``b``, ``part``, of which the row of role 0 comes first, from rows of ``cut_out``."""
    group, held = None, (np.empty(0, dtype=np.int64), np.empty((0, SHINGLES), dtype=_U), np.empty((0, WINDOW + 2 * SPAN), dtype=np.int64))
    for rows in batches:
        if not rows.num_rows:
            continue
        size = _items(rows.column(4))[1] // 2
        # About COMPARED paragraphs at once; a row's stay together.
        part = np.concatenate(([0], np.cumsum(size)[:-1])) // COMPARED
        edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(size))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = rows.slice(s, e - s)
            b, parts, role, mark = (c.to_numpy() for c in some.columns[:4])
            both, size = _items(some.column(4))
            both, row = both.reshape(-1, 2).astype(np.int64), np.repeat(np.arange(e - s), size // 2)
            near = _around(both[:, 0], row, some.column(5))
            sets = np.sort(_shingled(near), axis=1)
            # Groups by number; 0 is the one that was begun before.
            new = np.ones(e - s, dtype=bool)
            new[1:] = (b[1:] != b[:-1]) | (parts[1:] != parts[:-1])
            new[0] = (b[0], parts[0]) != group
            number = np.cumsum(new)
            zero = role[row] == 0
            at = np.concatenate((held[0], number[row[zero]] << 32 | both[zero, 0]))
            own, around = np.concatenate((held[1], sets[zero])), np.concatenate((held[2], near[zero]))
            asked = np.flatnonzero(~zero)
            if len(at) and len(asked):
                wanted = number[row[asked]] << 32 | both[asked, 1]
                k = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
                asked, k = asked[at[k] == wanted], k[at[k] == wanted]
                good = _jaccard(sets[asked], own[k]) >= SIMILAR
                asked, k = asked[good], k[good]
                before, behind = _reach(near[asked], around[k])
                found = _runs(row[asked], both[asked], before, behind, least)
                if len(found[0]):
                    r, *run = found
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (mark[r], run[0], run[1], b[r], run[2], run[3])], ["a", "start", "end", "b", "from", "to"])
            last = at >> 32 == number[-1]
            group, held = (b[-1], parts[-1]), (at[last] & int(_LOW), own[last], around[last])


def _runs(row: np.ndarray, both: np.ndarray, before: np.ndarray, behind: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, from, to) of the runs of each row's paragraphs; one paragraph alone is a run of its own."""
    start, size = _starts(row)
    alone = start[size == 1]
    p, q = both[alone, 0], both[alone, 1]
    run = np.stack([row[alone], p - before[alone], p + WINDOW + behind[alone], q - before[alone], q + WINDOW + behind[alone]])
    run = run[:, run[2] - run[1] >= least]
    more = [(int(row[s]), *x) for s, n in zip(start.tolist(), size.tolist(), strict=True) if n > 1 for x in _run_together(both[s : s + n], before[s : s + n], behind[s : s + n], least)]
    return tuple(np.concatenate((run, np.array(more, dtype=np.int64).reshape(-1, 5).T), axis=1))


def _distinct(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones((len(x), 1), dtype=bool), x[:, 1:] != x[:, :-1]), axis=1)


def _jaccard(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the sets in the rows of two sorted arrays."""
    nx, ny = _distinct(x).sum(axis=1), _distinct(y).sum(axis=1)
    together = np.sort(np.concatenate((x, y), axis=1), axis=1)
    union = _distinct(together).sum(axis=1)
    return (nx + ny - union) / union


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place in it) of each item of neighbouring pieces."""
    piece = np.repeat(np.arange(len(size)), size)
    return piece, np.arange(len(piece)) - (np.cumsum(size) - size)[piece]


def _stretches(at: np.ndarray, row: np.ndarray, first: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """Words of each row's paragraphs at ``at`` (ascending) and SPAN around each, without repeats: number, (first, length) of each, hashes.

    ``first`` and ``length`` say where each row's words stand in ``hashes``.
    """
    low, high = np.maximum(at - SPAN, 0), np.minimum(at + WINDOW + SPAN, length[row])
    begin = np.flatnonzero(np.concatenate(([True], (low[1:] > high[:-1]) | (row[1:] != row[:-1]))))
    of, low, high = row[begin], low[begin], high[np.append(begin[1:], len(at)) - 1]
    number = np.bincount(of, minlength=len(first))
    size = 1 + 2 * number + np.bincount(of, weights=high - low, minlength=len(first)).astype(np.int64)
    home = np.cumsum(size) - size
    out = np.empty(size.sum(), dtype="<u4")
    out[home] = number
    nth = _spread(number)[1]
    out[home[of] + 1 + 2 * nth], out[home[of] + 2 + 2 * nth] = low, high - low
    piece, place = _spread(high - low)
    within = np.cumsum(high - low) - (high - low)
    within -= within[np.minimum((np.cumsum(number) - number)[of], len(of) - 1)]
    out[(home + 1 + 2 * number)[of[piece]] + within[piece] + place] = hashes[(first[of] + low)[piece] + place]
    return _binary(out, size)


def _around(at: np.ndarray, row: np.ndarray, cuts: pa.Array) -> np.ndarray:
    """One row for each paragraph: hashes of SPAN words before, its own, and SPAN words behind; -1 beyond the text."""
    items, size = _items(cuts)
    home = np.cumsum(size) - size
    number = items[home].astype(np.int64)
    of, nth = _spread(number)
    low, length = (items[home[of] + k + 2 * nth].astype(np.int64) for k in (1, 2))
    within = np.cumsum(length) - length
    begin = (home + 1 + 2 * number)[of] + within - within[(np.cumsum(number) - number)[of]]
    own = np.searchsorted(of << 32 | low, row << 32 | at, side="right") - 1
    place = (at - low[own])[:, None] + np.arange(-SPAN, WINDOW + SPAN)
    outside = (place < 0) | (place >= length[own][:, None])
    return np.where(outside, -1, items[np.where(outside, 0, place + begin[own][:, None])].astype(np.int64))


def _shingled(near: np.ndarray) -> np.ndarray:
    h = near[:, SPAN : SPAN + WINDOW].astype(_U)
    total = np.zeros((len(h), SHINGLES), dtype=_U)
    for k in range(WORDS):
        total += h[:, k : k + SHINGLES] * tv._POSITION[k]
    return tv.mix(total)


def _reach(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in a row that are equal before and behind each two paragraphs, SPAN at most: the next anchor they share is no further."""
    same = (x == y) & (x >= 0)
    return np.cumprod(same[:, SPAN - 1 :: -1], axis=1).sum(axis=1), np.cumprod(same[:, SPAN + WINDOW :], axis=1).sum(axis=1)


def _run_together(both: np.ndarray, before: np.ndarray, behind: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, int, int]]:
    """Runs of paragraphs that follow each other on both sides at about the same distance, with the equal words around them."""
    if not len(both):
        return
    order = np.lexsort((both[:, 1], both[:, 0]))
    # Open runs by the distance of their two sides, in steps of NEAR, so that a paragraph meets only those on its own diagonal or beside it.
    open_: dict[int, list[list[int]]] = {}
    long_enough = lambda run: max(run[1] - run[0], run[3] - run[2]) >= least
    for (p, q), l, r in zip(both[order].tolist(), before[order].tolist(), behind[order].tolist(), strict=True):
        step = (p - q) // NEAR
        for run in (run for near in (0, -1, 1, -2, 2) for run in reversed(open_.get(step + near, ()))):
            if p <= run[1] + NEAR and run[2] <= q + NEAR and q <= run[3] + NEAR and abs((p - run[0]) - (q - run[2])) <= NEAR:
                run[0], run[2] = min(run[0], p - l), min(run[2], q - l)
                run[1], run[3] = max(run[1], p + WINDOW + r), max(run[3], q + WINDOW + r)
                break
        else:
            own = open_.setdefault(step, [])
            yield from (tuple(run) for run in own if run[1] + NEAR < p and long_enough(run))
            own[:] = [run for run in own if run[1] + NEAR >= p]
            own.append([p - l, p + WINDOW + r, q - l, q + WINDOW + r])
    yield from (tuple(run) for own in open_.values() for run in own if long_enough(run))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document and repeated passage: id, word span, ``component_id`` (its smallest document) and ``keep``; passages of ``least`` words or more."""
    spark = docs.sparkSession
    df = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size * KEYS / 48 / BUCKET_ENTRIES))
    matched = stored(collide(index(df, buckets), max(min(buckets, MOST_PARTITIONS), int(spark.conf.get("spark.sql.shuffle.partitions")))), "paragraphs")
    rows = matched.where("kind = 0 and a is not null").select(F.col("a").alias("doc_id"), F.col("b").alias("mark"), "n").distinct()
    marks = cut(rows.groupBy("mark").agg(F.min("doc_id").alias("id"), F.countDistinct("doc_id").alias("copies"), F.max("n").alias("n")))
    pairs = matched.where("kind = 1").select("a", "b", "payload")
    crowd = matched.where("kind = 2").select(F.col("b").alias("key"), F.col("a").alias("mark"), F.col("n").alias("place"))
    # The texts that have a candidate are joined out of the documents once.
    needed = pairs.select(F.col("a").alias("mark")).union(pairs.select(F.col("b").alias("mark"))).union(crowd.select("mark")).distinct().join(marks.select("mark", "id"), "mark")
    texts = stored(df.join(needed, F.col("doc_id") == F.col("id")).select("mark", "text"), "texts")
    if not crowd.isEmpty():
        pairs = pairs.union(_families(texts, crowd))
    runs = cut(verify(texts, pairs, least))

    # Overlapping runs on the compared side are one passage there.
    sides = runs.select("b", "from", "to").distinct()
    ahead = F.max("to").over(Window.partitionBy("b").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1))
    begun = sides.withColumn("new", F.when(F.col("from") < ahead, 0).otherwise(1))
    numbered = begun.withColumn("nr", F.sum("new").over(Window.partitionBy("b").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, 0)))
    numbered = cut(numbered.withColumn("passage", F.xxhash64("b", "nr")).select("b", "from", "to", "passage"))
    members = runs.join(numbered, ["b", "from", "to"]).select(F.col("a").alias("mark"), "start", "end", "passage")
    homes = numbered.groupBy("b", "passage").agg(F.min("from").alias("start"), F.max("to").alias("end")).select(F.col("b").alias("mark"), "start", "end", "passage")
    copies = marks.where(f"copies > 1 and n >= {max(least, WINDOW)}").select("mark", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.xxhash64("mark").alias("passage"))
    spans = cut(members.union(homes).union(copies).distinct())
    # A text's own runs that overlap tie their passages together.
    ordered = Window.partitionBy("mark").orderBy("start", "end", "passage")
    upto = F.max(F.struct("end", "passage")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    ties = spans.withColumn("last", upto).where(F.col("start") < F.col("last.end")).select(F.col("passage").alias("a"), F.col("last.passage").alias("b"))
    joined = components(ties).withColumnRenamed("node", "passage")
    out = spans.join(joined, "passage", "left").withColumn("component", F.coalesce("component", "passage"))
    # A document's spans of one component that overlap, as found on different sides, are one.
    out = out.join(rows.select("mark", "doc_id"), "mark").groupBy("component", "doc_id", "start").agg(F.max("end").alias("end"))
    own = Window.partitionBy("component", "doc_id").orderBy("start")
    upto = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("new", F.when(F.col("start") <= upto, 0).otherwise(1)).withColumn("nr", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.groupBy("component", "doc_id", "nr").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("nr")
    least = out.groupBy("component").agg(F.min(F.struct("doc_id", "start")).alias("least"))
    # A large component's rows are dealt to SALTS tasks.
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"]).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "start") == F.col("least")).alias("keep"))
