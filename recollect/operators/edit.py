"""Editing a base: signed counts for adding and removing rows, and the order-dependent IB2 selection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import occurrences
from ..storage import cut, fresh
from . import search
from .subsets import MOST, Subsets

#: Rows that IB2 takes in one block where it searches; where it counts, rows of a block at least and at most, their subsets and the counts of these by class.
BLOCK, LEAST, MANY, KEYS, COUNTS = 8_192, 1_024, 65_536, 1 << 19, 1 << 24


def changed(instances: DataFrame, rows: DataFrame, features: list[str], sign: int = 1) -> DataFrame:
    """``instances`` with ``rows`` added (or removed, with sign -1) as signed counts; what falls to zero goes.

    A pattern has the first key that is left of it, so that classes come in the order of the rows that are left.
    """
    a = instances.select("iid", *features, "class", occurrences(instances).alias("occ"))
    b = rows.select("iid", *features, "class", (occurrences(rows) * sign).alias("occ"))
    left = a.unionByName(b).groupBy("iid", *features, "class").agg(F.sum("occ").alias("occ"))
    iid = F.min(F.when(F.col("occ") > 0, F.col("iid")))
    return left.groupBy(*features, "class").agg(iid.alias("iid"), F.sum("occ").alias("occ")).where("occ > 0").select("iid", *features, "class", "occ")


def seeded(rows: DataFrame, n: int, features: list[str]) -> DataFrame:
    return rows.orderBy("iid").limit(n)


def ib2(rows: DataFrame, features: list[str], weights: list[float], classes: DataFrame, seed: int, block: int | None = None) -> DataFrame:
    """The first ``seed`` rows, and each later one that those kept so far classify wrongly (overlap, one distance).

    Rows are taken in blocks in their order, a folder of kept rows for each. Few features: a block's task gets how many kept rows
    share each subset of the values of its rows, and adds its own to these counts. More: a block is searched against what is
    kept, in parallel, and what its rows add is compared with its later rows only. Either task is of bounded size. ``classes``
    has a row for each class.
    """
    spark, columns = rows.sparkSession, ["iid", *features, "class"]
    rows = rows.select(*columns)
    number = {r["class"]: (r["class_idx"], r["gfreq"]) for r in classes.collect()}
    few = 0 < len(features) <= MOST
    step = block or (max(LEAST, min(MANY, KEYS >> len(features), COUNTS // max(1, len(number)) >> len(features))) if few else BLOCK)
    folder, sums = fresh(spark, "ib2"), _Sums()

    def keep(part: DataFrame, n: int) -> None:
        part.write.parquet(f"{folder}/{n}")
        if few:
            sums.add(_subsets(spark.read.schema(rows.schema).parquet(f"{folder}/{n}"), features).counts())

    kept = lambda: spark.read.schema(rows.schema).parquet(f"{folder}/*")
    keep(seeded(rows, seed, features), 0)
    last, total = kept().agg(F.max("iid")).first()[0], rows.count()
    rest = rows.where(F.col("iid") > last) if last is not None else rows
    parts = max(1, -(-(total - seed) // step))
    shares = ", ".join(str(k / parts) for k in range(1, parts)) or "0.5"
    bounds = rest.selectExpr(f"percentile_approx(iid, array({shares}), 100000) AS b").first()["b"] or []
    low = last
    for n, high in enumerate([*(bounds if parts > 1 else []), None], 1):
        if high is not None and (high is None or low is None or high <= low):
            continue
        own = rest.where(F.lit(True) if low is None else F.col("iid") > low).where(F.lit(True) if high is None else F.col("iid") <= high)
        keep(_by_sums(own, sums.all(), features, weights, number) if few else _by_search(own, kept(), features, weights, number), n)
        low = high
    return kept()


class _Sums:
    """Counts by subset and class, in frames: of two that are sums of equally many one is made, so a count is written a few times only."""

    def __init__(self):
        self.frames: list[tuple[int, DataFrame]] = []

    def add(self, counts: DataFrame) -> None:
        size, counts = 0, cut(counts)
        while self.frames and self.frames[-1][0] == size:
            both = self.frames.pop()[1].unionByName(counts)
            size, counts = size + 1, cut(both.groupBy("mask", "values", "class").agg(F.sum("cnt").alias("cnt")))
        self.frames.append((size, counts))

    def all(self) -> DataFrame:
        """(mask, values, class, cnt); a count may be in parts."""
        return reduce(DataFrame.unionByName, (df for _, df in self.frames))


def _subsets(rows: DataFrame, features: list[str]) -> Subsets:
    p = rows.select(*(F.col(f).alias(f"p_{f}") for f in features), "class", F.lit(1).cast("long").alias("cnt"))
    return Subsets(p, p, features, [], 1)


def _by_sums(own: DataFrame, sums: DataFrame, features: list[str], weights: list[float], number: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of a block that are to be kept, from counts of what is kept by subset."""
    asked = _subsets(own, features).counts().select("mask", "values").distinct()
    cells = sums.join(asked, ["mask", "values"])
    alone = lambda df: df.withColumn("block", F.lit(0)).groupBy("block")
    return alone(own).cogroup(alone(cells)).applyInArrow(_counter(features, weights, number), own.schema)


def _counter(features: list[str], weights: list[float], number: dict[str, tuple[int, int]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    order = sorted(number, key=lambda c: number[c][0])
    often = np.array([number[c][1] for c in order], dtype=float)
    masks = range(1 << len(features))
    far = [float(np.round(sum(0.0 if m >> i & 1 else w for i, w in enumerate(weights)), 10)) for m in masks]
    # By distance, the counts that share just these values from those that share them and maybe more.
    levels = np.array([[sum((-1) ** (m ^ s).bit_count() for m in masks if far[m] == d and m & s == m) for s in masks] for d in sorted(set(far))])

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([(c, "ascending") for c in ("iid", *features, "class")])
        place = lambda table: pc.index_in(search._column(table, "class"), value_set=pa.array(order)).to_numpy(zero_copy_only=False)
        coded = [search._column(left, f).cast(pa.string()).dictionary_encode() for f in features]
        codes = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in coded]
        at, cells, size = np.empty((left.num_rows, len(masks)), dtype=np.int64), [], 0
        for m in masks if left.num_rows else ():
            some = right.filter(pc.equal(right.column("mask"), m))
            flat, members = search._column(some, "values").flatten(), [i for i in range(len(features)) if m >> i & 1]
            own, there = np.zeros(left.num_rows, dtype=np.int64), np.zeros(some.num_rows, dtype=np.int64)
            for j, i in enumerate(members):
                value = pc.index_in(flat.take(pa.array(np.arange(j, len(flat), len(members)))), value_set=coded[i].dictionary).to_numpy(zero_copy_only=False)
                known, own = np.unique(own * len(coded[i].dictionary) + codes[i], return_inverse=True)
                there = np.searchsorted(known, there * len(coded[i].dictionary) + value)
            at[:, m] = own + size
            cells.append((there + size, place(some), search._column(some, "cnt").to_numpy(zero_copy_only=False)))
            size += int(own.max()) + 1
        count = np.zeros((size, len(often)), dtype=np.int64)
        for there, label, n in cells:
            np.add.at(count, (there, label), n)
        label, kept = place(left), []
        for i in range(left.num_rows):
            if _nearest_class(levels, count[at[i]], often) != label[i]:
                count[at[i], label[i]] += 1
                kept.append(i)
        return left.select(["iid", *features, "class"]).take(pa.array(kept, pa.int64()))

    return select


def _nearest_class(levels: np.ndarray, shared: np.ndarray, often: np.ndarray) -> int:
    """``_vote`` from counts by subset; distances are looked at as far as they are needed."""
    votes: dict[float, np.ndarray] = {}
    for d, level in enumerate(levels):
        count = level @ shared
        if count.any():
            votes[d] = count
            if len(votes) == 2 or (count == count.max()).sum() == 1:
                break
    return _vote(votes, often)


def _by_search(own: DataFrame, kept: DataFrame, features: list[str], weights: list[float], number: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of a block that are to be kept, from a search among what is kept."""
    plan = [search.Feature(f, "O", w) for f, w in zip(features, weights, strict=True)]
    near = search.buckets(search.distances(own.withColumn("qid", F.col("iid")), search.base_table(kept, features), plan, 1), 1)
    known = near.groupBy(F.col("qid").alias("iid")).agg(F.collect_list(F.struct("d", "class", "cnt")).alias("near"))
    return own.join(known, "iid", "left").withColumn("block", F.lit(0)).groupBy("block").applyInPandas(_selector(features, weights, number), own.schema)


def _selector(features: list[str], weights: list[float], number: dict[str, tuple[int, int]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    order = sorted(number, key=lambda c: number[c][0])
    place, often = {c: i for i, c in enumerate(order)}, np.array([number[c][1] for c in order], dtype=float)
    w = np.array(weights)

    def select(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("iid", ignore_index=True)
        codes = np.stack([pd.factorize(df[f])[0] for f in features], axis=1)
        label = df["class"].map(place).to_numpy()
        new = np.empty((len(df), len(features)), dtype=codes.dtype)
        kept: list[int] = []
        for i, near in enumerate(df["near"]):
            d = np.round((new[: len(kept)] != codes[i]) @ w, 10)
            votes: dict[float, np.ndarray] = {}
            for x in near if near is not None else ():
                votes.setdefault(x["d"], np.zeros(len(often)))[place[x["class"]]] += x["cnt"]
            for x in np.unique(d)[:2]:
                votes.setdefault(float(x), np.zeros(len(often)))
                votes[float(x)] += np.bincount(label[kept][d == x], minlength=len(often))
            if _vote(votes, often) != label[i]:
                new[len(kept)] = codes[i]
                kept.append(i)
        return df.iloc[kept][["iid", *features, "class"]]

    return select


def _vote(votes: dict[float, np.ndarray], often: np.ndarray) -> int:
    """Class of the nearest distance; a tie looks one distance further, then at frequencies, then at the first class."""
    levels = sorted(votes)
    if not levels:
        return -1
    count = votes[levels[0]]
    tied = np.flatnonzero(count == count.max())
    if len(tied) > 1 and len(levels) > 1:
        more = count + votes[levels[1]]
        best = np.flatnonzero(more == more.max())
        if len(best) == 1:
            return int(best[0])
    return int(tied[np.argmax(often[tied])])
