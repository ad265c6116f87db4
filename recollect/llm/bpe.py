"""Byte-level BPE encoding and decoding as a monoid: halves are encoded on their own and joined.

Two things are joined. A text's encoding is the list of matches of the splitting pattern; a pattern
without look-behind matches in the same way from any place where a match begins, so after joining
only a window around the boundary is matched again, until it meets a match of the right half. A
match's encoding is a list of tokens; a list is the encoding of its bytes if each two neighbours are
(in the whole run, the first merge across a boundary would also be the first one across it in the
run over the two neighbours alone), so a window around the boundary is encoded again and grows until
its outer tokens pass that test.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, quoted

#: Characters matched, and bytes merged, in one go at the leaves of the tree.
LEAF_CHARS, LEAF_BYTES = 1 << 15, 24
#: Longer pieces that must be merged in one go use a heap.
HEAP_BYTES = 256
#: A match that ends this far before a boundary doesn't depend on what follows it.
LOOKAHEAD = 3
#: Encodings of matches that a Python worker remembers, twice at most, and the longest match it remembers.
MEMORY, MEMORY_CHARS = 200_000, 32
#: Bytes of text encoded between two outputs.
OUTPUT_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


#: A pattern for which matches are also found from the classes of characters (fixed value).
CLASS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTRACTED = re.compile("'(?:[stmd]|re|ve|ll)")
_LETTER, _NUMBER, _WHITE, _OTHER = range(4)


def _classes() -> np.ndarray:
    """Class of each character, as the pattern's own engine sees it."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


class Encoder:
    """Encodes texts by ``ranks``, each match of ``pattern`` separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.id_bytes = {t: int(r).to_bytes(4, "little") for t, r in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.classes = _classes() if pattern == CLASS_PATTERN else None

    def merged(self, piece: bytes) -> list[bytes]:
        """Tokens of a short piece: the best-ranked pair is joined again and again, the leftmost first."""
        if len(piece) > HEAP_BYTES:
            return self.merged_by_heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) < 2:
            return parts
        rank, none = self.ranks.get, 1 << 40
        pairs = [rank(piece[i : i + 2], none) for i in range(len(parts) - 1)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def merged_by_heap(self, piece: bytes) -> list[bytes]:
        """As ``merged``, with pairs in a heap and parts in a linked list."""
        n, rank = len(piece), self.ranks.get
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] == 0 or (j := end[i]) >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := rank(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = after[i]
        return out

    def stable(self, a: bytes, b: bytes) -> bool:
        return self.tokens(a + b) == [a, b]

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two encodings' bytes together."""
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.tree(b"".join(left[len(left) - i :] + right[:j]), whole=i == len(left) and j == len(right))
            before = i == len(left) or self.stable(left[-i - 1], window[0])
            after = j == len(right) or self.stable(window[-1], right[j])
            if before and after:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if before else 2 * i, j if after else 2 * j

    def tree(self, piece: bytes, whole: bool = False) -> list[bytes]:
        """Halves encoded recursively, then joined; a window that is everything is merged in one go."""
        if whole or len(piece) <= LEAF_BYTES:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined(self.tree(piece[:half]), self.tree(piece[half:]))

    def tokens(self, piece: bytes) -> list[bytes]:
        return [piece] if piece in self.ranks else self.tree(piece)

    def ids(self, piece: str) -> bytes:
        """Ids of one match as little-endian unsigned 32-bit integers."""
        found = self.known.get(piece) or self.older.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            found = self.id_bytes.get(raw) or b"".join([self.id_bytes[t] for t in self.tree(raw)])
        if len(piece) <= MEMORY_CHARS:
            if len(self.known) >= MEMORY:
                self.known, self.older = {}, self.known
            self.known[piece] = found
        return found

    def leaf(self, text: str, start: int, end: int) -> list[str]:
        """Matches in a short stretch: boundaries lie where the class of characters changes, and a single
        space goes with what follows; contractions and other patterns are left to the regular expression."""
        if self.classes is None or _CONTRACTED.search(text, start, end):
            return self.pattern.findall(text, start, end)
        if start == end:
            return []
        part = text[start:end]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind = self.classes[code]
        begins = np.empty(len(kind), dtype=bool)
        begins[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        last_white = np.flatnonzero((kind[:-1] == _WHITE) & begins[1:])
        begins[last_white] = True
        begins[last_white[code[last_white] == 0x20] + 1] = False
        at = np.flatnonzero(begins).tolist()
        return [part[a:b] for a, b in zip(at, at[1:] + [len(part)], strict=True)]

    def matches(self, text: str, start: int, end: int) -> list[str]:
        """Matches in text[start:end] taken alone: a tree over halves."""
        if end - start <= LEAF_CHARS:
            return self.leaf(text, start, end)
        half = (start + end) // 2
        left, right = self.matches(text, start, half), self.matches(text, half, end)
        at = half
        while left and at > half - LOOKAHEAD:
            at -= len(left.pop())
        k, here = 0, half
        for m in self.pattern.finditer(text, at, end):
            while k < len(right) and here < m.start():
                here += len(right[k])
                k += 1
            if here == m.start():
                break
            left.append(m[0])
        else:
            k = len(right)
        return left + right[k:]

    def encode(self, text: str) -> bytes:
        """Ids of a text, without special tokens."""
        pieces = self.matches(text, 0, len(text))
        out = list(map(self.known.get, pieces))
        if None in out:
            ids = self.ids
            out = [x or ids(p) for x, p in zip(out, pieces, strict=True)]
        return b"".join(out)


class Decoder:
    """Bytes of ids; decodings of parts are concatenated."""

    def __init__(self, ranks: dict[bytes, int]):
        token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, rank in ranks.items():
            token[rank] = t
        self.size = np.array([len(t) for t in token], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(token), dtype=np.uint8)

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, dtype="<u4")
        size = self.size[i]
        to = np.cumsum(size)
        return self.letters[np.arange(to[-1] if len(to) else 0) + np.repeat(self.start[i] - (to - size), size)].tobytes()


_ready: dict[bytes, tuple[Encoder, Decoder]] = {}


def _digest(ranks: dict[bytes, int], pattern: str) -> bytes:
    """Tells any two vocabularies or patterns apart."""
    all_ = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        all_.update(b"%d %d " % (len(token), rank) + token)
    return all_.digest()


def _codec(key: bytes, ranks: dict[bytes, int], pattern: str) -> tuple[Encoder, Decoder]:
    """A Python worker keeps one codec, with what it remembers, from task to task."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _ready[key]


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (binary, 4 bytes an id, little-endian) and ``decoded`` (binary).

    A null text counts as empty; null or repeated ids are passed on as they are; an empty table gives an empty
    table; other columns, whatever their names, aren't read.
    The vocabulary is broadcast: its size is that of the file, whatever the data. A task holds its memory of
    matches and a few MB of texts, or one text if that is longer.
    """
    df = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    key = _digest(ranks, pattern)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _codec(key, shared.value, pattern)
        for batch in batches:
            ids: list[bytes] = []
            decoded: list[bytes] = []
            first = size = 0
            for i, t in enumerate(batch.column(1)):
                ids.append(encoder.encode(t.as_py() or ""))
                decoded.append(decoder.decode(ids[-1]))
                size += len(decoded[-1])
                if size > OUTPUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first : i + 1], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])
                    first, size, ids, decoded = i + 1, 0, [], []

    return map_batches(df, run, f"doc_id {kind}, ids binary, decoded binary")


def report(coded: DataFrame) -> DataFrame:
    """Digest columns of ``round_trip``'s result."""
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
