"""Nearest neighbours by shared subsets of values, for few features that count 0 or their weight: the overlap metric.

Such a distance depends only on which values two rows share, so neighbours needn't be compared one by one: patterns are
counted by each subset of their values (a cube), a query looks up its own subsets, and counts of "these and maybe more"
become counts of "these and no others" by inclusion and exclusion. Subsets come in the order of what they weigh: first
without classes, to find at which distances a query has anything and where its (k + 1)-th distance lies; then by class, for subsets
within that only. Work is 2**features rows a pattern and a query, whatever the size of the other table, and a
value that fills a third of the table is one row of the cube for each class.

Counts subtract, so what a query must not see is taken away: the query itself, or the patterns of its fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import MISSING

#: Features for which the cube is made at most; more have inverted lists.
MOST = 6


class Subsets:
    """What a search over shared subsets consists of: ``q`` and ``p`` as ``sides`` makes them, weights as columns of the queries.

    ``keys`` are columns in which both must agree. ``held`` has patterns by ``fold``, which queries of that fold don't see.
    """

    def __init__(self, q: DataFrame, p: DataFrame, names: list[str], weights: list[Column], k: int, leave_out: bool = False, keys: list[str] | None = None, held: DataFrame | None = None):
        self.q, self.p, self.names, self.weights, self.k, self.keys, self.held = q, p, names, weights, k, keys or [], held
        self.leave_out = leave_out
        self.own = [*(["q_class", "q_occ"] if leave_out else []), *(["fold"] if held is not None else [])]

    def _keys(self, side: str) -> list[tuple[int, Column]]:
        """(mask, values) of each subset."""
        value = [F.coalesce(F.col(f"{side}_{n}"), F.lit(MISSING)) for n in self.names]
        return [(m, F.array(*(v for i, v in enumerate(value) if m >> i & 1)).cast("array<string>")) for m in range(1 << len(self.names))]

    def counts(self, p: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """(mask, values, class, cnt): how many patterns have these values, and maybe share more."""
        keys = F.array(*(F.struct(F.lit(m).alias("mask"), v.alias("values")) for m, v in self._keys("p")))
        rows = (self.p if p is None else p).select(*self.keys, *by, F.explode(keys).alias("x"), "class", "cnt")
        return rows.groupBy(*self.keys, *by, "x.mask", "x.values", "class").agg(F.sum("cnt").alias("cnt"))

    def asked(self) -> DataFrame:
        """(qid, mask, values, d, ..): each subset of a query with the distance of what shares it and no more."""

        def d(mask: int) -> Column:
            return F.round(reduce(lambda total, x: total + x[1] * (0.0 if mask >> x[0] & 1 else 1.0), enumerate(self.weights), F.lit(0.0)), 10)

        keys = F.array(*(F.struct(F.lit(m).alias("mask"), v.alias("values"), d(m).alias("d")) for m, v in self._keys("q")))
        return self.q.select("qid", *self.keys, *self.own, F.explode(keys).alias("x")).select("qid", *self.keys, "x.*", *self.own)

    @staticmethod
    def _only(cells: Column) -> Column:
        """From cells (d, mask, n) of subsets shared at least, the counts of those shared exactly."""

        def own(t: Column) -> Column:
            sign = lambda s: F.when(F.bit_count(s["mask"].bitwiseXOR(t["mask"])) % 2 == 1, -s["n"]).otherwise(s["n"])
            return F.aggregate(cells, F.lit(0).cast("long"), lambda n, s: n + F.when(s["mask"].bitwiseAND(t["mask"]) == t["mask"], sign(s)).otherwise(0))

        return F.transform(cells, lambda t: F.struct(t["d"].alias("d"), t["mask"].alias("mask"), own(t).alias("n")))

    def _less(self, rows: DataFrame, on: list[str], n: str, own: Column) -> DataFrame:
        """``rows`` with ``n``, which is less what the query must not see."""
        left = F.col(n) - own
        if self.held is not None:
            taken = self.counts(self.held, ("fold",)).groupBy("fold", *on).agg(F.sum("cnt").alias("taken"))
            rows, left = rows.join(taken, ["fold", *on], "left"), left - F.coalesce("taken", F.lit(0))
        return rows.withColumn("n", left)

    def within(self, counts: DataFrame) -> DataFrame:
        """(qid, mask, values, d, ..): the subsets of a query up to its (k + 1)-th distance."""
        on = [*self.keys, "mask", "values"]
        total = counts.groupBy(*on).agg(F.sum("cnt").alias("all"))
        known = self._less(self.asked().join(total, on), on, "all", F.col("q_occ") if self.leave_out else F.lit(0))
        carried = [*self.keys, *self.own]
        lists = known.groupBy("qid", *carried).agg(F.collect_list(F.struct("d", "mask", "n", "values")).alias("cells"))
        held = F.filter(self._only(F.col("cells")), lambda x: x["n"] > 0)
        bound = F.get(F.sort_array(F.array_distinct(F.transform(held, lambda x: x["d"]))), F.lit(self.k))
        near = lists.withColumn("bound", bound).withColumn("x", F.explode("cells")).where("bound IS NULL OR x.d <= bound")
        return near.select("qid", *carried, "x.mask", "x.values", "x.d")

    def found(self) -> DataFrame:
        """(qid, d, exact, class, cnt): complete at the k + 1 nearest distances of each query."""
        counts, on = self.counts(), [*self.keys, "mask", "values"]
        own = F.when(F.col("class") == F.col("q_class"), F.col("q_occ")).otherwise(0) if self.leave_out else F.lit(0)
        pairs = self._less(self.within(counts).join(counts, on), [*on, "class"], "cnt", own)
        cells = pairs.groupBy("qid", "class").agg(F.collect_list(F.struct("d", "mask", "n")).alias("cells"))
        held = F.filter(self._only(F.col("cells")), lambda x: x["n"] > 0)
        every = (1 << len(self.names)) - 1
        rows = cells.select("qid", "class", F.explode(held).alias("x")).select("qid", "x.d", (F.col("x.mask") == every).alias("exact"), "class", "x.n")
        return rows.groupBy("qid", "class", "d", "exact").agg(F.sum("n").alias("cnt")).select("qid", "d", "exact", "class", "cnt")
