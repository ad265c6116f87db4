"""Decision trees as tables of prefixes, and hybrids of tree and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix(order: list[str], depth: int) -> Column:
    """The first ``depth`` values as an array, the key of a node."""
    return F.array(*(F.col(f) for f in order[:depth])).cast("array<string>") if depth else F.array().cast("array<string>")


def prefixes(order: list[str], least: int = 0) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(t).alias("depth"), prefix(order, t).alias("key")) for t in range(least, len(order) + 1))))


def nodes(base: DataFrame, order: list[str], classes: DataFrame) -> DataFrame:
    """(depth, key, default, n): the majority class under each prefix."""
    cells = base.select(prefixes(order).alias("x"), "class", "cnt").groupBy("x.depth", "x.key", "class").agg(F.sum("cnt").alias("cnt"))
    best = cells.join(classes, "class").groupBy("depth", "key").agg(F.max(F.struct("cnt", "gfreq", (-F.col("class_idx")).alias("i"), "class")).alias("best"), F.sum("cnt").alias("n"))
    return best.select("depth", "key", F.col("best.class").alias("default"), "n")


def pruned(tree: DataFrame) -> DataFrame:
    """The tree without nodes that answer as their parent does, from the bottom up, unless a node below them stays; with ``leaf``.

    So a node stays if it or one below it answers otherwise than its parent: the prefixes of such nodes stay, and the root.
    """
    up = F.slice("key", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    above = tree.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("default").alias("above"))
    other = tree.where("depth > 0").withColumn("up", up).join(above, ["depth", "up"]).where(~F.col("default").eqNullSafe(F.col("above")))
    stays = other.select(F.explode(F.sequence(F.lit(1), "depth")).alias("t"), "key").select(F.col("t").alias("depth"), F.slice("key", F.lit(1), F.col("t")).alias("key")).distinct()
    parents = stays.select((F.col("depth") - 1).alias("depth"), up.alias("key")).distinct().withColumn("has", F.lit(True))
    left = tree.where("depth = 0").unionByName(tree.join(stays, ["depth", "key"], "left_semi"))
    return left.join(parents, ["depth", "key"], "left").withColumn("leaf", F.col("has").isNull()).drop("has")


def descend(queries: DataFrame, tree: DataFrame, order: list[str], weights: list[float]) -> DataFrame:
    """(qid, predicted, distance, depth, leaf): the default of the deepest prefix that the tree has; the distance is the weight of the rest.

    ``leaf``: nothing lies below that prefix in the tree.
    """
    steps = queries.select("qid", prefixes(order).alias("x")).select("qid", "x.depth", "x.key")
    leaf = F.col("leaf") if "leaf" in tree.columns else F.col("depth") == len(order)
    deepest = steps.join(tree.withColumn("leaf", leaf), ["depth", "key"]).groupBy("qid").agg(F.max(F.struct("depth", "default", "leaf")).alias("x"))
    rest = F.element_at(F.array(*(F.lit(float(sum(weights[t:]))) for t in range(len(order) + 1))), F.col("x.depth") + 1)
    return deepest.select("qid", F.col("x.default").alias("predicted"), F.round(rest, 10).alias("distance"), F.col("x.depth").cast("long").alias("depth"), F.col("x.leaf").alias("leaf"))


def blocked(rows: DataFrame, order: list[str], depth: int) -> DataFrame:
    """``rows`` with their first ``depth`` values as ``block``."""
    return rows.withColumn("block", prefix(order, depth))


def levels(base: DataFrame, order: list[str]) -> DataFrame:
    """(depth, key, class, cnt): the class distribution of each prefix."""
    return base.select(prefixes(order).alias("x"), "class", "cnt").groupBy("x.depth", "x.key", "class").agg(F.sum("cnt").alias("cnt"))


def following(base: DataFrame, order: list[str]) -> DataFrame:
    """(depth, key, next_value, cnt): the values that follow each prefix shorter than a pattern, a row for each, with the rows under them."""
    steps = F.explode(F.array(*(F.struct(F.lit(t).alias("depth"), prefix(order, t).alias("key"), F.col(f).cast("string").alias("next_value")) for t, f in enumerate(order))))
    return base.select(steps.alias("x"), "cnt").groupBy("x.depth", "x.key", "x.next_value").agg(F.sum("cnt").alias("cnt"))


def sizes(base: DataFrame, order: list[str]) -> DataFrame:
    """(depth, nodes, branching): how many prefixes of each length the base has, and how many each shorter one has on average."""
    own = base.select(prefixes(order).alias("x")).select("x.*").distinct().groupBy("depth").agg(F.count("*").alias("nodes"))
    above = own.select((F.col("depth") + 1).alias("depth"), F.col("nodes").alias("above"))
    return own.join(above, "depth").select("depth", "nodes", (F.col("nodes") / F.col("above")).alias("branching"))


def compression(base: DataFrame, order: list[str]) -> DataFrame:
    """One row: nodes of the tree (one for each prefix, and a last one for each pattern), patterns, and the percentage of nodes that shared prefixes save."""
    every = sizes(base, order).agg(F.sum("nodes").alias("inner"), F.max(F.when(F.col("depth") == len(order), F.col("nodes"))).alias("patterns"))
    nodes_ = F.col("inner") + F.col("patterns")
    return every.select(nodes_.alias("nodes"), "patterns", (100 * (1 - nodes_ / (F.col("patterns") * (len(order) + 1)))).alias("saved"))
