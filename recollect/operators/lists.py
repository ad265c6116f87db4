"""Nearest neighbours by inverted lists, for features that count 0 or their weight: the overlap metric.

Every value of a feature has the list of patterns that hold it. A query first looks into a single list, that of its
heaviest known value, for an upper bound of its (k + 1)-th distance. A pattern within the bound shares values of
some least weight with the query, so it's in one of few lists: the longest are left out as long as what they weigh
together is less than that. Lists are equi-joins; a pair is made in the first of the query's lists that has it. Where the bound
excludes nothing, all lists are read, and patterns in none of them, which share nothing, are counted by class as
the rest of all patterns. So all pairs are never made, and the nearest k + 1 distances are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import MISSING

#: Patterns of a list that are looked at for the bound, about; what follows from the bound is searched whole.
PROBES = 512
#: Sums of weights closer than this aren't told apart.
MARGIN = 1e-9


def _symbol(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(MISSING))


def posted(p: DataFrame, names: list[str]) -> DataFrame:
    """(f, v, p_.., class, cnt): each pattern in the list of each of its values."""
    values = F.array(*(F.struct(F.lit(i).alias("f"), _symbol(f"p_{n}").alias("v")) for i, n in enumerate(names)))
    return p.withColumn("x", F.explode(values)).select("x.f", "x.v", *p.columns)


class Lists:
    """What a search over inverted lists consists of: ``q`` and ``p`` as ``sides`` makes them, weights and distances as columns."""

    def __init__(self, q: DataFrame, p: DataFrame, names: list[str], weights: list[Column], distance: Column, exact: Column, k: int, leave_out: bool):
        self.q, self.p, self.names, self.k = q, p, names, k
        self.weights, self.distance, self.exact, self.leave_out = weights, distance, exact, leave_out
        self.posted = posted(p, names)
        self.farthest = F.round(reduce(lambda total, w: total + w, weights, F.lit(0.0)), 10)

    def _left(self) -> Column:
        """Instances of a pattern without the query itself."""
        own = F.when(self.exact & (F.col("class") == F.col("q_class")), F.col("q_occ")).otherwise(0) if self.leave_out else F.lit(0)
        return F.col("cnt") - own

    def sized(self) -> DataFrame:
        """(qid, lists): the lists of each query that aren't empty, as (size, f, v, w)."""
        values = F.array(*(F.struct(F.lit(i).alias("f"), _symbol(f"q_{n}").alias("v"), w.alias("w")) for i, (n, w) in enumerate(zip(self.names, self.weights, strict=True))))
        sizes = self.posted.groupBy("f", "v").agg(F.count("*").alias("size"))
        asked = self.q.select("qid", F.explode(values).alias("x")).select("qid", "x.*").join(sizes, ["f", "v"])
        return asked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("size", "f", "v", "w")), asc=False).alias("lists"))

    def probes(self, sized: DataFrame) -> DataFrame:
        """Pairs of each query with patterns of the list of its heaviest value (the shortest of equally heavy ones)."""
        head = F.array_max(F.transform("lists", lambda x: F.struct(x["w"].alias("w"), (-x["size"]).alias("less"), x["f"].alias("f"), x["v"].alias("v"))))
        asked = self.q.join(sized.select("qid", head.alias("x")), "qid").select(*self.q.columns, "x.f", "x.v", F.ceil(-F.col("x.less") / PROBES).alias("share"))
        some = F.pmod(F.xxhash64(*(f"p_{n}" for n in self.names), "class"), F.col("share")) == 0
        return asked.join(self.posted, ["f", "v"]).where(some)

    def chosen(self, sized: DataFrame, probes: DataFrame) -> DataFrame:
        """Queries with ``bound`` (null: none), ``whole`` (patterns that share nothing may be near), and the lists that they read."""
        seen = probes.withColumn("d", self.distance).where(self._left() > 0)
        bound = seen.groupBy("qid").agg(F.get(F.sort_array(F.collect_set("d")), F.lit(self.k)).alias("bound"))
        asked = self.q.join(sized, "qid", "left").join(bound, "qid", "left")
        asked = asked.withColumn("whole", F.col("bound").isNull() | (F.col("bound") > self.farthest - MARGIN))
        least = self.farthest - F.col("bound") - MARGIN
        none = F.struct(F.lit(0.0).alias("out"), F.array().cast("array<struct<f:int,v:string>>").alias("read"))
        step = lambda a, x: F.when(a["out"] + x["w"] < least, F.struct((a["out"] + x["w"]).alias("out"), a["read"].alias("read"))).otherwise(F.struct(a["out"].alias("out"), F.array_append(a["read"], F.struct(x["f"].alias("f"), x["v"].alias("v"))).alias("read")))
        every = F.transform("lists", lambda x: F.struct(x["f"].alias("f"), x["v"].alias("v")))
        read = F.when(F.col("whole"), every).otherwise(F.aggregate("lists", none, step)["read"])
        return asked.withColumn("read", F.coalesce(read, F.array())).drop("lists")

    def pairs(self, chosen: DataFrame) -> DataFrame:
        """Pairs of queries and patterns, each once: where the first list of the query that has the pattern says so."""
        asked = chosen.withColumn("x", F.explode("read")).withColumn("reads", F.col("read.f")).select(*chosen.drop("read").columns, "reads", "x.f", "x.v")
        first = F.coalesce(*(F.when(F.array_contains("reads", i) & F.col(f"q_{n}").eqNullSafe(F.col(f"p_{n}")), i) for i, n in enumerate(self.names)))
        return asked.join(self.posted, ["f", "v"]).where(first == F.col("f"))

    def found(self) -> DataFrame:
        """(qid, d, exact, class, cnt): complete at the k + 1 nearest distances of each query."""
        sized = self.sized()
        chosen = self.chosen(sized, self.probes(sized))
        near = self.pairs(chosen).withColumn("d", self.distance).where("whole OR d <= bound")
        # What shares nothing is all there is, less what was found.
        row = lambda d, exact, n: F.struct(d.alias("d"), exact.alias("exact"), n.cast("long").alias("cnt"))
        less = row(self.farthest, F.lit(False), -F.col("cnt"))
        own = row(F.col("d"), self.exact, self._left())
        counted = near.select("qid", "class", F.explode(F.when(F.col("whole"), F.array(own, less)).otherwise(F.array(own))).alias("x")).select("qid", "class", "x.*")
        classes = self.p.groupBy("class").agg(F.sum("cnt").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("all"))  # one row, an entry for each class
        rest = chosen.where("whole").crossJoin(classes).select("qid", self.farthest.alias("d"), F.explode("all").alias("class", "cnt"))
        both = counted.unionByName(rest.select("qid", "class", "d", F.lit(False).alias("exact"), "cnt"))
        return both.groupBy("qid", "d", "exact", "class").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
