"""Nearest neighbours by products of all vectors, for the dot product and the cosine where no bound excludes much.

Queries and patterns are packed once: a row has the vectors of one part of a table as bytes, with what belongs to them. Parts of
both meet as pairs (a Cartesian product that reads the parts again instead of shuffling copies of them), so disk grows with the
tables and with what leaves the meetings: of each query and part of the patterns, counts by class at the k + 1 nearest distances.
Values are compared as they are written by a digest of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Vectors of a part at most, and of a part of queries at least; meetings that there should be at least.
QUERIES, PATTERNS, LEAST, MEETINGS = 16_384, 32_768, 1_024, 64
#: Bytes of a digest, and rows that leave a task at once (about).
DIGEST, ROWS = 32, 16_384

Numbers = Callable[[pa.Table], np.ndarray]
Summed = Callable[[np.ndarray, np.ndarray, dict, dict], Iterator[pa.Table]]


def _digest(names: list[str]) -> Column:
    """Of the values as they are written, each with its length."""
    value = lambda n: F.col(n).cast("string")
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.length(value(n)).cast("string"), F.lit(":"), value(n)), F.lit("-")) for n in names)), 256))


def _bytes(column: pa.ChunkedArray | pa.Array) -> bytes:
    return b"".join(column.to_pylist())


def packed(rows: DataFrame, side: str, names: list[str], carried: list[str], numbers: Numbers, parts: int) -> DataFrame:
    """One row for each of ``parts`` parts: vectors and digests as bytes, and lists of the ``carried`` columns."""
    values = [f"{side}_{n}" for n in names]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    wide = 8 * len(names)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = np.ascontiguousarray(numbers(pa.Table.from_batches([batch])), dtype=np.float64).tobytes()
                x = pa.array([data[i * wide : (i + 1) * wide] for i in range(batch.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([x, *(batch.column(c) for c in ("digest", *carried))], ["x", "digest", *carried])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(held)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (pa.concat_arrays(table.column(n).chunks) for n in carried)]
            yield pa.RecordBatch.from_arrays([pa.array([_bytes(table.column(c))], pa.binary()) for c in ("x", "digest")] + lists, [f"{side}_{c}" for c in ("x", "digest", *carried)])

    one = rows.withColumn("digest", _digest(values)).select(*values, "digest", *carried).mapInArrow(vectors, "x binary, digest binary, " + ", ".join(f"`{c}` {kinds[c]}" for c in carried))
    many = ", ".join(f"`{side}_{c}` array<{kinds[c]}>" for c in carried)
    return cut(one.repartition(parts).mapInArrow(gathered, f"{side}_x binary, {side}_digest binary, {many}"))


def equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b with the same digest."""
    order = np.argsort(b[:, 0], kind="stable")
    low, high = (np.searchsorted(b[order, 0], a[:, 0], side) for side in ("left", "right"))
    many = high - low
    i = np.repeat(np.arange(len(a)), many)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    whole = (a[i] == b[j]).all(axis=1)
    return i[whole], j[whole]


def found(q: DataFrame, p: DataFrame, names: list[str], numbers: Callable[[str], Numbers], summed: Summed, size: tuple[int, int], own: list[str]) -> DataFrame:
    """(qid, d, exact, class, cnt): complete at the nearest distances of each query that ``summed`` takes from a part's vectors."""
    pieces = max(1, -(-size[1] // PATTERNS))
    parts = max(1, -(-size[0] // QUERIES), min(-(-size[0] // LEAST), -(-MEETINGS // pieces)))
    left = packed(q, "q", names, ["qid", *own], numbers("q"), parts)
    right = packed(p, "p", names, ["class", "cnt"], numbers("p"), pieces)
    width = len(names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                x, y = (np.frombuffer(row[f"{s}_x"].as_py(), dtype=np.float64).reshape(-1, width) for s in "qp")
                sides = [{n[2:]: np.frombuffer(v.as_py(), dtype=np.int64).reshape(-1, DIGEST // 8) if n == f"{s}_digest" else v.values for n, v in row.items() if n.startswith(s) and n != f"{s}_x"} for s in "qp"]
                held: list[pa.Table] = []
                for out in summed(x, y, *sides):
                    held.append(out)
                    if sum(t.num_rows for t in held) > ROWS:
                        yield from pa.concat_tables(held).combine_chunks().to_batches()
                        held = []
                if held:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()

    qid = q.schema["qid"].dataType.simpleString()
    met = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(meet, f"qid {qid}, d double, exact boolean, class string, cnt long")
    return met.groupBy("qid", "d", "exact", "class").agg(F.sum("cnt").alias("cnt"))
