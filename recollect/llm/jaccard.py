"""N-gram Jaccard self-join by universe partition and pigeonhole, verified exactly.

Sets r and s with a Jaccard similarity of t or more differ in H = (|r| + |s|)(1 - t)/(1 + t) tokens at
most. Tokens are hashed into segments; a pair that isn't found differs in every segment that carries
value, by as many tokens as the value says, so sets whose values add up to more than H can't be missed.
An index entry of a segment's whole subset carries the value 1; entries of the subset and all subsets
with one token deleted carry 2. Pairs are dealt to size bands by H (caps in a geometric row), and each
band takes the allocation (segments, with or without deletions) of the least expected cost. Empty
segments carry no value and no entry.

Equal sets are one node: entries are keyed by a fingerprint of the set. Entries of a batch of documents
are packed by bucket, so a shuffled row holds many. A key with few sets gives all their pairs. A key
with many gives a star around one of them. A pair goes on if it shares as
many keys as linked sets must. After what remains is verified and linked, a crowded key
whose sets are all in one component is settled. One that still joins several components has its value
taken back; a set that is left with too little value is joined again, with its like, by the prefix
filter over rarest tokens, in pairs of different components only. Nothing is capped, so no link is lost.

The texts of sets that have a candidate, or may be left with too little value, are joined out of the
documents once and stored; the plan is the same at every size.

Shingles are compared by 64-bit hashes. Texts that are null, empty or without words have an empty set
and link with nothing. Rows without an id get a null component and take no part; a repeated id stands for
all its texts; repeated rows count once. Similarity of just 0.75 links. Texts of any length are taken
whole. An empty table gives an empty table. Other columns, whatever their names, aren't read
(``representatives`` passes them on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, map_batches, quoted, stored
from .components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Ratio of neighbouring caps of the size bands.
GROWTH = 2.0
#: A key with more sets than this gives a star instead of all pairs; one with more in a batch is settled there first.
CROWD, LOCAL_CROWD = 6, 48
#: Entries of a batch, and of a bucket (about); partitions that buckets are dealt to at most (a task takes one bucket after the other).
BATCH_ENTRIES, BUCKET_ENTRIES, MOST_PARTITIONS = 600_000, 1_000_000, 20_000
#: Expected cost of a set with too little value, in entries per token.
FALLBACK = 0.6
#: Partners of a set that are verified in one group.
PARTNERS = 128
#: Tokens before one that are looked at, so that few pairs come from several tokens.
BEFORE = 24
_LOW = np.uint64((1 << 40) - 1)
_U = np.uint64


def _difference(total: int) -> int:
    """The most tokens by which linked sets of ``total`` tokens together differ."""
    return total * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def _occupied(n: float, m: float) -> tuple[float, float]:
    """Mean and deviation of the number of segments that n tokens occupy."""
    empty = math.exp(-n / m)
    return m * (1 - empty), math.sqrt(max(m * empty * (1 - (1 + n / m) * empty), 1e-9))


def _below(mean: float, deviation: float, need: float) -> float:
    return 0.5 * math.erfc((mean - need + 0.5) / (deviation * math.sqrt(2)))


class Bands:
    """Caps of the bands, and the allocation of each: segments, and whether one-token deletions are indexed."""

    def __init__(self):
        self.caps: list[int] = []
        self.plans: list[tuple[int, bool]] = []

    def _extend(self, need: int) -> None:
        while not self.caps or self.caps[-1] < need:
            last = self.caps[-1] if self.caps else 0
            self.caps.append(max(last + 1, int(round(last * GROWTH))))
            self.plans.append(self._cheapest(self.caps[-1]))

    @staticmethod
    def _cheapest(cap: int) -> tuple[int, bool]:
        n = 3.0 * cap
        best = (math.inf, (1, True))
        for factor in (1.15, 1.25, 1.4, 1.6):
            m = math.ceil(cap * factor)
            mean, deviation = _occupied(n, m)
            best = min(best, (mean + FALLBACK * n * _below(mean, deviation, cap), (m, False)))
        for factor in (0.5, 0.6, 0.75, 0.9):
            m = max(1, math.ceil(cap * factor))
            mean, deviation = _occupied(n, m)
            single = n * math.exp(-(n - 1) / m)
            best = min(best, (mean + n - single + FALLBACK * n * _below(2 * mean - single, 2 * deviation, cap), (m, True)))
        return best[1]

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, value needed) of every band in which a set of n tokens may have a partner."""
        least = _difference(n + -(-n * NUMERATOR // DENOMINATOR)) + 1
        most = _difference(n + n * DENOMINATOR // NUMERATOR) + 1
        self._extend(most)
        out, lower = [], 0
        for band, cap in enumerate(self.caps):
            if cap >= least and lower < most:
                out.append((band, min(cap, most)))
            lower = cap
        return out


_BAND = tv.mix(np.arange(1, 129, dtype=_U) * _U(0x9FB21C651E98DF25))


def entries(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, int, int]:
    """Index keys of a set (sorted hashes), its spare value, and the fewest keys that it shares with a linked set.

    Spare is the least over its bands of value less need. Of the value, H can be lost to differences, so
    more than the spare value is found: a key for each segment, which carries 2 at most with deletions.
    """
    mixed = tv.mix(tokens)
    keys, spare, fewest = [], 1 << 30, 1 << 30
    for band, need in bands.of(len(tokens)):
        m, deletions = bands.plans[band]
        segment = ((tokens >> _U(32)) * _U(m)) >> _U(32)
        new = np.flatnonzero(segment[1:] != segment[:-1]) + 1
        start = np.concatenate(([0], new))
        total = np.add.reduceat(mixed, start)
        salt = tv.mix(segment[start] + _BAND[band])
        keys.append(tv.mix(total ^ salt))
        value = len(start)
        if deletions:
            size = np.diff(np.append(start, len(tokens)))
            each = np.repeat(size, size) > 1
            value += int((size > 1).sum())
            keys.append(tv.mix((np.repeat(total, size) - mixed)[each] ^ np.repeat(salt, size)[each]))
        spare = min(spare, value - need)
        fewest = min(fewest, (value - need + 2) // 2 if deletions else value - need + 1)
    return np.concatenate(keys), spare, fewest


def fingerprint(tokens: np.ndarray) -> int:
    mark = tv.mix(tv.mix(tokens).sum(dtype=_U, keepdims=True) + _U(len(tokens)))
    return int(mark.view(np.int64)[0])


#: kind 0: a document (a: id, b: fingerprint, c: fewest shared keys, n: set size, m: spare value); kind 1: a pair
#: (a, b: fingerprints, m: shared keys); kind 2: a set under a crowded key (a: key, b: fingerprint); kind 3: packed entries of a bucket.
ROW = "kind int, bucket long, a long, b long, c long, n long, m long, payload binary"
_NAMES = [f.split()[0] for f in ROW.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 6, pa.binary()]


def _rows(kind: int, size: int, bucket=None, a=None, b=None, c=None, n=None, m=None, payload=None) -> pa.RecordBatch:
    columns = [pa.array(np.full(size, kind, dtype=np.int32))]
    for values, kind_of in zip((bucket, a, b, c, n, m, payload), _TYPES[1:], strict=True):
        columns.append(pa.nulls(size, kind_of) if values is None else values if isinstance(values, pa.Array) else pa.array(values, kind_of))
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of runs of equal values in a sorted array."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    return start, np.diff(np.append(start, len(keys)))


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct unordered pairs of different sets, and how many keys each shares here."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    low, high = low[low != high], high[low != high]
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    if len(low):
        start = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
        yield _rows(1, len(start), bucket=low[start] & 0xFFFF, a=low[start], b=high[start], m=np.diff(np.append(start, len(low))))


def _pack(sets: np.ndarray, count: np.ndarray, key: np.ndarray, hot: np.ndarray) -> bytes:
    low = key & _LOW
    return b"".join((len(sets).to_bytes(4, "little"), sets.astype("<i8").tobytes(), count.astype("<u4").tobytes(), (low & _U(0xFFFFFFFF)).astype("<u4").tobytes(), (low >> _U(32)).astype(np.uint8).tobytes(), np.packbits(hot).tobytes() if hot.any() else b""))


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(payload[:4], "little")
    sets = np.frombuffer(payload, "<i8", k, 4)
    count = np.frombuffer(payload, "<u4", k, 4 + 8 * k)
    n, at = int(count.sum()), 4 + 12 * k
    key = np.frombuffer(payload, "<u4", n, at).astype(_U) | (np.frombuffer(payload, np.uint8, n, at + 4 * n).astype(_U) << _U(32))
    rest = np.frombuffer(payload, np.uint8, -1, at + 5 * n)
    hot = np.unpackbits(rest, count=n).astype(bool) if len(rest) else np.zeros(n, dtype=bool)
    return key, np.repeat(sets, count), hot


class _Batch:
    """Entries of a batch of documents, each set once; what is crowded within the batch is settled before the shuffle."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.sets: list[int] = []
        self.seen: set[int] = set()
        self.size = 0

    def add(self, fingerprint: int, keys: np.ndarray) -> None:
        self.seen.add(fingerprint)
        self.sets.append(fingerprint)
        self.keys.append(keys)
        self.size += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key = np.concatenate(self.keys)
        owner = np.repeat(np.arange(len(self.sets)), [len(k) for k in self.keys])
        sets = np.array(self.sets, dtype=np.int64)
        bucket = ((key >> _U(40)) % _U(self.buckets)).astype(np.int64)
        label = (bucket.astype(_U) << _U(40)) | (key & _LOW)
        order = np.argsort(label, kind="stable")
        label, owner = label[order], owner[order]
        start, size = _runs(label)
        crowd = np.repeat(size > LOCAL_CROWD, size)
        first = np.zeros(len(label), dtype=bool)
        first[start] = True
        if crowd.any():
            pivot = np.repeat(sets[owner[start]], size)
            yield from _pairs(pivot[crowd], sets[owner][crowd])
            yield _rows(2, int(crowd.sum()), bucket=sets[owner][crowd] & 0xFFFF, a=label[crowd].view(np.int64), b=sets[owner][crowd])
        keep = ~crowd | first
        label, owner, hot = label[keep], owner[keep], crowd[keep]
        bucket = (label >> _U(40)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        label, owner, hot, bucket = label[order], owner[order], hot[order], bucket[order]
        start, size = _runs(bucket)
        payload = []
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            own = owner[s : s + n]
            begin, count = _runs(own)
            payload.append(_pack(sets[own[begin]], count, label[s : s + n], hot[s : s + n]))
        yield _rows(3, len(start), bucket=bucket[start], payload=payload)
        self.clear()


def index(docs: DataFrame, buckets: int) -> DataFrame:
    """ROWs of kind 0 for every document of ``docs(doc_id, text)``, and of kinds 1 to 3 for its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, batch = Bands(), _Batch(buckets)
        for rows in batches:
            for i, j, data, start in tv.chunks(rows.column(1)):
                ids = rows.column(0)[i:j]
                sets = tv.shingle_sets(tv.Words(data, start), WORDS)
                marks, spares, fewest = [], [], []
                for valid, tokens in zip(ids.is_valid().to_pylist(), sets, strict=True):
                    mark, spare, few = fingerprint(tokens), None, None
                    if len(tokens) and valid:
                        keys, spare, few = entries(tokens, bands)
                        if mark not in batch.seen:
                            batch.add(mark, keys)
                    marks.append(mark)
                    spares.append(spare)
                    fewest.append(few)
                yield _rows(0, j - i, bucket=[m & 0xFFFF for m in marks], a=ids, b=marks, c=fewest, n=[len(t) for t in sets], m=spares)
                if batch.size >= BATCH_ENTRIES:
                    yield from batch.flush()
        yield from batch.flush()

    return map_batches(docs, run, ROW)


def _match(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bucket: int) -> Iterator[pa.RecordBatch]:
    """Pairs and crowded keys of one bucket."""
    key, sets, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((sets, key))
    key, sets, hot = key[order], sets[order], hot[order]
    start, size = _runs(key)
    hot = np.repeat(np.logical_or.reduceat(hot, start), size)
    once = np.concatenate(([True], (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])))
    key, sets, hot = key[once], sets[once], hot[once]
    start, size = _runs(key)
    many = np.repeat(size, size)
    crowd = (many > CROWD) | (hot & (many > 1))
    left, right = [], []
    few = ~crowd & (many > 1)
    k, s = key[few], sets[few]
    for gap in range(1, CROWD):
        together = k[gap:] == k[:-gap]
        left.append(s[:-gap][together])
        right.append(s[gap:][together])
    left.append(np.repeat(sets[start], size)[crowd])
    right.append(sets[crowd])
    yield from _pairs(np.concatenate(left), np.concatenate(right))
    if crowd.any():
        yield _rows(2, int(crowd.sum()), bucket=sets[crowd] & 0xFFFF, a=(key[crowd] | _U(bucket << 40)).view(np.int64), b=sets[crowd])


def match(indexed: DataFrame, partitions: int) -> DataFrame:
    """Packed entries are brought together by bucket and matched; all other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, []
        for rows in batches:
            packed = np.array(rows.column(0)) == 3
            if not packed.all():
                yield rows.filter(pa.array(~packed))
            rows = rows.filter(pa.array(packed))
            for bucket, payload in zip(rows.column(1).to_pylist(), rows.column(7).to_pylist(), strict=True):
                if bucket != now and parts:
                    yield from _match(parts, now)
                    parts = []
                now = bucket
                parts.append(_unpack(payload))
        if parts:
            yield from _match(parts, now)

    placed = indexed.repartition(partitions, "bucket").sortWithinPartitions("kind", "bucket")
    return map_batches(placed, run, ROW)


def verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links among ``pairs(a, fa, b, fb)`` (ids and fingerprints of sets), from ``texts(id, text)``: whole texts are compared again.

    The partners of a set come in groups of PARTNERS, each with one copy of the set's own text, sorted so
    that a task holds one set at a time.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = cut(pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))))
    wanted = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("id"), F.col("fb").alias("mark")).union(dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("id"), F.col("fa").alias("mark")).distinct())
    rows = texts.join(wanted, "id")
    rows = rows.select("a", "part", "role", "mark", "id", "text").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for rows in batches:
            found: list[tuple[int, int]] = []
            for i, j, data, start in tv.chunks(rows.column(5)):
                sets = tv.shingle_sets(tv.Words(data, start), WORDS)
                for a, part, role, mark, id_, tokens in zip(*(rows.column(k)[i:j].to_pylist() for k in range(5)), sets, strict=True):
                    if fingerprint(tokens) != mark:  # another text under a repeated id
                        continue
                    if (a, part) != group:
                        group, own = (a, part), None
                    if role == 0:
                        own = tokens
                    elif own is not None:
                        at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                        shared = int((own[at] == tokens).sum())
                        if DENOMINATOR * shared >= NUMERATOR * (len(own) + len(tokens) - shared):
                            found.append((a, id_))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return map_batches(rows, run, "a long, b long")


def _tokens(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, token, n) for each token of the sets of ``wanted(id, mark, n)``."""
    rows = texts.join(wanted, "id").select("id", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, j, data, start in tv.chunks(rows.column(2)):
                for id_, mark, tokens in zip(rows.column(0)[i:j].to_pylist(), rows.column(1)[i:j].to_pylist(), tv.shingle_sets(tv.Words(data, start), WORDS), strict=True):
                    if fingerprint(tokens) == mark:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), id_)), pa.array(tokens.view(np.int64)), pa.array(np.full(len(tokens), len(tokens)))], ["id", "token", "n"])

    return map_batches(rows, run, "id long, token long, n long").distinct()


def _rest(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that share one of their rarest tokens, of sets in different components: the prefix filter.

    ``nodes(id, mark, n, component)`` are the sets left with too little value. Tokens whose sets are all in one
    component give nothing, nor do pairs that are in one or have too few tokens left. A pair is left to an earlier
    token that it shares, where one is among the last BEFORE of both; the first one that it shares always gives it.
    """
    tokens = cut(_tokens(texts, nodes.select("id", "mark", "n")))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, "token").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("often", "token")))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1).where("often > 1").join(nodes.select("id", "component"), "id").select("token", "id", "n", "component", "rank")
    split = prefix.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
    before = F.collect_list("token").over(Window.partitionBy("id").orderBy("rank").rowsBetween(-BEFORE, -1))
    prefix = cut(prefix.join(split, "token").withColumn("before", before))
    other = prefix.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("rank").alias("rb"), F.col("before").alias("bb"))
    # From the first token that linked sets share, enough of each must be left for the intersection that they need.
    left = 1 + F.least(F.col("n") - F.col("rank"), F.col("nb") - F.col("rb"))
    enough = left * (DENOMINATOR + NUMERATOR) >= (F.col("n") + F.col("nb")) * NUMERATOR
    return prefix.join(other, "token").where((F.col("id") < F.col("b")) & (F.col("component") != F.col("cb")) & enough & ~F.arrays_overlap("before", "bb")).select(F.col("id").alias("a"), "b").distinct()


def _with(links: DataFrame, more: DataFrame) -> DataFrame:
    return cut(links.union(more.select("a", "b")))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    spark = docs.sparkSession
    df = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / 10 / BUCKET_ENTRIES))
    matched = stored(match(index(df, buckets), max(min(buckets, MOST_PARTITIONS), int(spark.conf.get("spark.sql.shuffle.partitions")))), "jaccard")
    rows = matched.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("mark"), F.col("c").alias("fewest"), F.col("n").alias("n_shingles"), F.col("m").alias("spare"))
    sets = rows.where("doc_id is not null and n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("spare").alias("spare"), F.min("fewest").alias("fewest"))
    crowds = matched.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("mark")).distinct()
    sets = cut(sets.join(crowds.groupBy("mark").agg(F.count("*").alias("crowds")), "mark", "left").na.fill(0, ["crowds"]))

    marks = sets.select("id", "mark")
    pairs = matched.where("kind = 1").groupBy("a", "b").agg(F.sum("m").alias("shared"))
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("mark").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("id", "n", "fewest", "crowds"))), end)
    near = (F.col("n_a") * NUMERATOR <= F.col("n_b") * DENOMINATOR) & (F.col("n_b") * NUMERATOR <= F.col("n_a") * DENOMINATOR)
    # Linked sets share so many keys, those under which both are crowded aside.
    pairs = pairs.where(near & (F.col("shared") + F.least("crowds_a", "crowds_b") >= F.greatest("fewest_a", "fewest_b"))).withColumnsRenamed({"id_a": "ia", "id_b": "ib"})
    pairs = cut(pairs.select(F.col("ia").alias("a"), F.col("a").alias("fa"), F.col("ib").alias("b"), F.col("b").alias("fb"), "shared"))

    # A set loses the value 2 at most under each crowded key.
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(sets.where(F.col("spare") < 2 * F.col("crowds")).select("id")).distinct()
    texts = stored(df.select(F.col("doc_id").alias("id"), "text").join(needed, "id"), "texts")

    # First each set and the one that it shares most keys with; then pairs that these links leave in different components.
    ends = pairs.select(F.col("a").alias("x"), "*").union(pairs.select(F.col("b").alias("x"), "*"))
    best = ends.groupBy("x").agg(F.max(F.struct("shared", "a", "fa", "b", "fb")).alias("p")).select("p.a", "p.fa", "p.b", "p.fb").distinct()
    links = cut(verify(texts, best))
    found = components(links)

    def placed_by(found: DataFrame) -> DataFrame:
        return sets.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    left = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti").drop("shared")
    by_id = placed_by(found)
    for end in ("a", "b"):
        left = left.join(by_id.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")), end)
    links = _with(links, verify(texts, left.where("ca != cb").select("a", "fa", "b", "fb")))
    found = components(links)

    # Crowded keys that still join several components lose their value; sets left with too little are joined by prefixes.
    placed = cut(placed_by(found))
    crowded = crowds.join(placed.select("mark", "component"), "mark")
    split = crowded.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    lost = crowded.join(split, "key").groupBy("mark").agg((2 * F.count("*")).alias("lost"))
    poor = cut(placed.join(lost, "mark", "left").where(F.col("spare") < F.coalesce("lost", F.lit(0))).select("id", "mark", "n", "component"))
    more = _rest(texts, poor)
    for end in ("a", "b"):
        more = more.join(marks.select(F.col("id").alias(end), F.col("mark").alias(f"f{end}")), end)
    more = cut(more)
    if not more.isEmpty():
        found = components(_with(links, verify(texts, more)))
    by_mark = sets.select("mark", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("mark", F.coalesce("component", "id").alias("component"))
    named_rows = rows.join(by_mark, "mark", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return named_rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of linked ones, the one with the smallest id; all columns stay."""
    others = cut(link(docs, doc_id, text).where("doc_id != component_id").select(F.struct("doc_id").alias("x")).distinct())
    free = next(name for k in range(len(docs.columns) + 1) if (name := f"linked{k}").casefold() not in {c.casefold() for c in docs.columns})
    return docs.join(others.select(F.col("x.doc_id").alias(free)), quoted(doc_id) == F.col(free), "left_anti")
