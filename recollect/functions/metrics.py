"""Distances between two values of a feature, as columns; and tables of distances between pairs of values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .statistics import numeric


def overlap(a: Column, b: Column) -> Column:
    """0 for equal values, 1 for different ones; a missing value is a value like any other."""
    return F.when(a.eqNullSafe(b), 0.0).otherwise(1.0)


def _numbers(a: Column, b: Column, distance: Column) -> Column:
    return F.when(a.eqNullSafe(b), 0.0).otherwise(F.coalesce(distance, F.lit(1.0)))


def numeric_distance(a: Column, b: Column, width: Column) -> Column:
    """Difference over the range of the training values; 1 if a value isn't a number."""
    return _numbers(a, b, F.abs(numeric(a) - numeric(b)) / width)


def euclidean(a: Column, b: Column, width: Column) -> Column:
    """Root of the difference of the squares, over the range."""
    x, y = numeric(a), numeric(b)
    return _numbers(a, b, F.sqrt(F.abs(x * x - y * y)) / width)


def letter_pairs(a: Column, single: Column) -> Column:
    """The set of pairs of neighbouring letters, or of letters where ``single``."""
    n = F.length(a)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(a, i, F.lit(2)))
    letters = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)))
    return F.array_distinct(F.when(single, letters).otherwise(pairs))


def dice(a: Column, b: Column) -> Column:
    single = (F.length(a) <= 1) | (F.length(b) <= 1)
    x, y = letter_pairs(a, single), letter_pairs(b, single)
    return F.when(a.eqNullSafe(b), 0.0).otherwise(1.0 - 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def edits(a: str, b: str) -> int:
    """Insertions, deletions, changes, and swaps of neighbours from the third letter on (which cost 1 and their changes)."""
    above: list[int] = []
    row = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        now = [i]
        for j in range(1, len(b) + 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 2 and j > 2:
                best = min(best, above[j - 2] + 1 + (a[i - 2] != b[j - 1]) + (a[i - 1] != b[j - 2]))
            now.append(best)
        above, row = row, now
    return row[-1]


@F.pandas_udf(DoubleType())
def levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance; applied to pairs of distinct values only."""
    return pd.Series([float(edits(x, y)) for x, y in zip(a, b, strict=True)])


def letter_distance(a: str, b: str) -> float:
    """As ``dice``, of two Python strings."""
    size = 1 if len(a) <= 1 or len(b) <= 1 else 2
    x, y = ({t[i : i + size] for i in range(max(1, len(t) - size + 1))} for t in (a, b))
    return 0.0 if a == b else 1.0 - 2.0 * len(x & y) / (len(x) + len(y))


def packed(probs: DataFrame, classes: DataFrame) -> DataFrame:
    """(fidx, fval, p, freq): the class distribution of a value as an array in the order of the classes' numbers."""
    own = probs.join(classes.select("class", "class_idx"), "class").groupBy("fidx", "fval").agg(F.map_from_entries(F.collect_list(F.struct("class_idx", "p"))).alias("m"), F.max("freq").alias("freq"))
    last = classes.agg(F.max("class_idx").alias("last"))  # one row
    return own.crossJoin(last).select("fidx", "fval", F.transform(F.sequence(F.lit(1).cast("long"), "last"), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("p"), "freq")


def distribution_distance(x: Column, y: Column, kind: str) -> Column:
    """Distance of two class distributions: half the sum of absolute differences (M), or a symmetric divergence (J, S)
    in which a class that only one value has counts with its probability."""

    def term(p: Column, q: Column) -> Column:
        if kind == "M":
            return F.abs(p - q)
        if kind == "J":
            both = p * F.log2(p / q) + q * F.log2(q / p)
        else:
            both = p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q))
        return F.when((p == 0) | (q == 0), p + q).otherwise(both)

    return F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda acc, d: acc + d) / 2


def distribution_distances(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """``distribution_distance`` of each row of x and each row of y."""
    total = np.zeros((len(x), len(y)))
    for c in range(min(x.shape[1], y.shape[1])):
        p, q = x[:, c, None], y[None, :, c]
        if kind == "M":
            total += np.abs(p - q)
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            both = p * np.log2(p / q) + q * np.log2(q / p) if kind == "J" else p * np.log2(2 * p / (p + q)) + q * np.log2(2 * q / (p + q))
        total += np.where((p == 0) | (q == 0), p + q, both)
    return total / 2


def distribution_pairs(table: DataFrame, kind: str, least: int = 1) -> DataFrame:
    """(fidx, v, w, d) for all pairs of different values of a feature, by ``table(fidx, fval, p, freq)`` of packed distributions.

    A matrix to be written or looked at; the search doesn't need it. Values rarer than ``least`` are at distance 1.
    """
    pairs = table.select("fidx", F.col("fval").alias("v"), F.col("p").alias("pv"), F.col("freq").alias("nv")).join(table.select("fidx", F.col("fval").alias("w"), F.col("p").alias("pw"), F.col("freq").alias("nw")), "fidx").where("not v <=> w")
    return pairs.select("fidx", "v", "w", F.when(F.least("nv", "nw") < least, 1.0).otherwise(distribution_distance(F.col("pv"), F.col("pw"), kind)).alias("d"))


def string_pairs(values: DataFrame, kind: str) -> DataFrame:
    """(fidx, v, w, d) for pairs of different values ``(fidx, v, w)`` by a string metric."""
    d = levenshtein("v", "w") if kind == "L" else dice(F.col("v"), F.col("w"))
    return values.where("v != w").select("fidx", "v", "w", d.alias("d"))
