"""Nearest neighbours by blocks of patterns that a lower bound lets a query leave out.

Patterns are dealt to BLOCKS blocks at most, so what is known of a block (a row of a small table) reaches every task. By
value: a block has one value of the feature that weighs most, and the distance in that feature is a bound; rare values
share a block without a bound. By range, where that feature is numeric: a block lies between two numbers. By norm, for the dot product: no product is more than that of the norms. By angle, for the cosine:
a block lies between two angles around one of its vectors, and angles obey the triangle inequality. A query first visits the
blocks with the least bounds, which give it a (k + 1)-th distance; then all blocks whose bound isn't above that. Visits of a block
are dealt to parts and its patterns to pieces, so every meeting is of bounded size, however large a block is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import numeric

#: Blocks at most, and vectors around which angles are measured.
BLOCKS, PIVOTS = 256, 64
#: Patterns that a query looks at first, for each distance that it's asked for.
FIRST = 8
#: Rounding of distances and bounds.
MARGIN = 1e-9
#: What Spark and Python read as the same number.
NUMBER = r"[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?"

Bound = Callable[[pa.Table], np.ndarray]


@dataclass
class Dealt:
    """Patterns with their ``block``, and the bound of each query of a table to each block."""

    patterns: DataFrame
    bound: Bound
    sizes: dict[int, int] = field(default_factory=dict)


def by_value(p: DataFrame, name: str, distance: Callable[[pa.Table, pa.Table], np.ndarray], weight: Callable[[pa.Table], np.ndarray]) -> Dealt:
    """Blocks by the value of the feature ``name``; ``distance`` of queries to the values of a table like ``p``."""
    own = [c for c in p.columns if c == f"p_{name}" or c.startswith(f"p_{name}__")]
    often = p.groupBy(f"p_{name}").agg(F.count("*").alias("often"), *(F.first(c).alias(c) for c in own if c != f"p_{name}"))
    table = pa.Table.from_pylist([r.asDict() for r in often.orderBy(F.desc("often"), f"p_{name}").limit(BLOCKS - 1).collect()])
    values = table.column(f"p_{name}").to_pylist() if table.num_rows else []
    place = F.create_map(*(F.lit(x) for i, v in enumerate(values, 1) for x in (v, i)))[F.col(f"p_{name}")] if values else F.lit(0)
    known = table.select(own) if values else None

    def bound(left: pa.Table) -> np.ndarray:
        out = np.zeros((left.num_rows, len(values) + 1))
        if values:
            out[:, 1:] = weight(left)[:, None] * distance(left, known)
        return out

    return Dealt(p.withColumn("block", F.coalesce(place, F.lit(0)).cast("int")), bound)


def by_range(p: DataFrame, name: str, squared: bool, weight: Callable[[pa.Table], np.ndarray], width: Callable[[pa.Table], np.ndarray]) -> Dealt:
    """Blocks by the number in the feature ``name`` (or its square, whose root counts); what isn't plainly a number has a block without a bound."""
    value = F.col(f"p_{name}")
    number = F.when(value.rlike(f"^{NUMBER}\\z"), numeric(value))
    placed = p.withColumn("number", number * number if squared else number)
    shares = ", ".join(str(i / BLOCKS) for i in range(1, BLOCKS))
    cuts = sorted(set(placed.selectExpr(f"percentile_approx(number, array({shares}), 10000) AS c").first()["c"] or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x < F.col("number"))) + 1 if cuts else F.lit(1)
    dealt = placed.withColumn("block", F.when(F.col("number").isNull(), 0).otherwise(place).cast("int"))
    least, most = np.full(len(cuts) + 2, np.inf), np.full(len(cuts) + 2, -np.inf)
    for r in dealt.where("block > 0").groupBy("block").agg(F.min("number").alias("least"), F.max("number").alias("most")).collect():
        least[r["block"]], most[r["block"]] = r["least"], r["most"]

    def bound(left: pa.Table) -> np.ndarray:
        x = np.array([np.nan if v is None or not re.fullmatch(NUMBER, v) else float(v) for v in left.column(f"q_{name}").to_pylist()], dtype=float)[:, None]
        x = x * x if squared else x
        with np.errstate(invalid="ignore", divide="ignore"):
            away = np.maximum(np.maximum(least[None, :] - x, x - most[None, :]), 0.0)
            away = weight(left)[:, None] * ((np.sqrt(away) if squared else away) / width(left)[:, None])
        away[:, 0] = 0.0
        return np.where(np.isfinite(away), away, 0.0)

    return Dealt(dealt.drop("number"), bound)


def _vector(side: str, names: list[str], weights: list[float]) -> Column:
    return F.array(*(F.coalesce(numeric(F.col(f"{side}_{n}")), F.lit(0.0)) * float(np.sqrt(w)) for n, w in zip(names, weights, strict=True)))


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def _numbers(left: pa.Table, names: list[str], weights: list[float]) -> np.ndarray:
    columns = [np.nan_to_num(np.array([_number(x) for x in left.column(f"q_{n}").to_pylist()], dtype=float)) for n in names]
    return np.column_stack(columns) * np.sqrt(np.array(weights))


def _number(x: str | float | None) -> float:
    try:
        return float(x) if x is not None and "_" not in str(x) else 0.0
    except ValueError:
        return 0.0


def by_norm(p: DataFrame, names: list[str], weights: list[float], greatest: float) -> Dealt:
    """Blocks by the norm, for the dot product; ``greatest`` is what distances count down from."""
    normed = p.withColumn("norm", _norm(_vector("p", names, weights)))
    shares = ", ".join(str(i / BLOCKS) for i in range(1, BLOCKS))
    cuts = sorted(set(normed.selectExpr(f"percentile_approx(norm, array({shares}), 10000) AS c").first()["c"] or []))
    dealt = normed.withColumn("block", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x < F.col("norm"))) if cuts else F.lit(0))
    most = {r["block"]: r["most"] for r in dealt.groupBy("block").agg(F.max("norm").alias("most")).collect()}
    norms = np.array([most.get(i, 0.0) for i in range(max(most, default=0) + 1)])

    def bound(left: pa.Table) -> np.ndarray:
        own = np.sqrt((_numbers(left, names, weights) ** 2).sum(axis=1))
        return (greatest - own[:, None] * norms[None, :]) / greatest

    return Dealt(dealt.drop("norm"), bound)


def by_angle(p: DataFrame, names: list[str], weights: list[float]) -> Dealt:
    """Blocks by the nearest of PIVOTS vectors, for the cosine; vectors without a length have a block without a bound."""
    some = p.select(_vector("p", names, weights).alias("x")).where(_norm(F.col("x")) > 0).orderBy(F.xxhash64("x"), "x").limit(PIVOTS).collect()
    pivots = np.array([r["x"] for r in some]).reshape(len(some), len(names))
    pivots = pivots / np.sqrt((pivots**2).sum(axis=1, keepdims=True)) if len(pivots) else pivots

    def angles(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x**2).sum(axis=1))
        return np.arccos(np.clip(x @ pivots.T / np.where(norm > 0, norm, 1.0)[:, None], -1.0, 1.0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=float).reshape(batch.num_rows, len(names))
            if len(pivots):
                at = angles(x)
                block, angle = at.argmin(axis=1) + 1, at.min(axis=1)
                none = (x**2).sum(axis=1) == 0
                block, angle = np.where(none, 0, block), np.where(none, 0.0, angle)
            else:
                block, angle = np.zeros(len(x), dtype=int), np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(block, pa.int32()), pa.array(angle, pa.float64())], [*batch.schema.names[:-1], "block", "angle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema)
    dealt = p.withColumn("x", _vector("p", names, weights)).mapInArrow(deal, f"{schema}, block int, angle double")
    least, most = np.full(len(pivots) + 1, np.inf), np.full(len(pivots) + 1, -np.inf)
    for r in dealt.groupBy("block").agg(F.min("angle").alias("least"), F.max("angle").alias("most")).collect():
        least[r["block"]], most[r["block"]] = r["least"], r["most"]

    def bound(left: pa.Table) -> np.ndarray:
        out = np.zeros((left.num_rows, len(pivots) + 1))
        if len(pivots):
            at = angles(_numbers(left, names, weights))
            away = np.maximum(np.maximum(at - most[None, 1:], least[None, 1:] - at), 0.0)
            out[:, 1:] = 1.0 - np.cos(np.minimum(away, np.pi))
        return out

    return Dealt(dealt.drop("angle"), bound)


def _visits(q: DataFrame, bound: Bound, sizes: dict[int, int], least: int, first: bool) -> DataFrame:
    """Queries with the ``block`` that they visit: first those of the least bounds, with ``least`` patterns or more; then, up to their ``limit``, the others."""
    names, schema = q.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = bound(pa.Table.from_batches([batch]))
            order = np.argsort(away, axis=1, kind="stable")
            held = np.array([sizes.get(b, 0) for b in range(away.shape[1])])[order]
            begun = np.zeros(away.shape, dtype=bool)
            np.put_along_axis(begun, order, np.cumsum(held, axis=1) - held < least, axis=1)
            if first:
                i, j = np.nonzero(begun)
            else:
                limit = np.array([np.inf if x is None else x for x in batch.column(names.index("limit")).to_pylist()])
                i, j = np.nonzero((away <= (limit + MARGIN * np.maximum(1.0, np.abs(limit)))[:, None]) & ~begun)
            at = pa.array(i)
            for s in range(0, len(i), 4096):
                rows = batch.take(at.slice(s, 4096))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(j[s : s + 4096], pa.int32())], [*names, "block"])

    return q.mapInArrow(run, f"{schema}, block int")


def found(q: DataFrame, dealt: Dealt, k: int, meet: Callable[[DataFrame, DataFrame, list[str]], DataFrame], piece: int, part: int) -> DataFrame:
    """(qid, d, exact, class, cnt): complete at the k + 1 nearest distances of each query; ``meet`` compares what has the same keys."""
    p = dealt.patterns
    dealt.sizes = {r["block"]: r["n"] for r in p.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row for each block

    def met(visits: DataFrame) -> DataFrame:
        many = {r["block"]: r["n"] for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect()}
        shape = [(b, -(-n // part), -(-dealt.sizes[b] // piece)) for b, n in many.items() if dealt.sizes.get(b)] or [(-1, 1, 1)]
        small = q.sparkSession.createDataFrame(shape, "block int, parts int, pieces int")
        left = visits.join(F.broadcast(small), "block").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        right = p.join(F.broadcast(small), "block").withColumn("piece", F.pmod(F.xxhash64(*(c for c in p.columns if c.startswith("p_") and "__" not in c), "class"), F.col("pieces")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return meet(left.drop("parts", "pieces"), right.drop("parts", "pieces"), ["block", "part", "piece"])

    least = FIRST * (k + 1)
    near = met(_visits(q, dealt.bound, dealt.sizes, least, True)).persist()
    limit = near.groupBy("qid").agg(F.get(F.sort_array(F.collect_set("d")), F.lit(k)).alias("limit"))
    rest = met(_visits(q.join(limit, "qid", "left"), dealt.bound, dealt.sizes, least, False))
    return near.unionByName(rest).groupBy("qid", "d", "exact", "class").agg(F.sum("cnt").alias("cnt"))
