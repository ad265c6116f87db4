"""Voting: decay with distance, sums by class, ties, normalisation and the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import EPSILON
from ..options import DECAYS


def factor(decay: str | Column, d: Column, near: Column, far: Column, r: Column, a: float | Column, b: float | Column) -> Column:
    """What an instance at distance d counts; the decay may differ by row."""
    if isinstance(decay, Column):
        out = F.lit(1.0)
        for code in DECAYS:
            out = F.when(decay == code, factor(code, d, near, far, r, a, b)).otherwise(out)
        return out
    if decay == "Z":
        return F.lit(1.0)
    if decay == "ID":
        return 1.0 / (d + EPSILON)
    if decay == "IL":
        return F.when((r == 1) | (far == near), 1.0).otherwise((far - d) / (far - near))
    x = F.exp(-F.lit(a) * F.pow(d, F.lit(b)))
    return F.when(x == 0, EPSILON).otherwise(x)


def votes(buckets: DataFrame, k: int | Column, decay: str | Column = "Z", a: float | Column = 1.0, b: float | Column = 1.0) -> DataFrame:
    """(qid, class, v, v1, near): votes over the k nearest buckets, and over one more; the nearest distance. Settings may be columns."""
    by = Window.partitionBy("qid")
    near = F.min("d").over(by)
    far = lambda upto: F.max(F.when(F.col("r") <= upto, F.col("d"))).over(by)
    df = buckets.withColumn("near", near).withColumn("far", far(k)).withColumn("far1", far(k + 1))
    weigh = lambda end: F.col("cnt") * factor(decay, F.col("d"), F.col("near"), F.col(end), F.col("r"), a, b)
    return df.groupBy("qid", "class").agg(F.coalesce(F.sum(F.when(F.col("r") <= k, weigh("far"))), F.lit(0.0)).alias("v"), F.sum(weigh("far1")).alias("v1"), F.min("near").alias("near"))


def answers(buckets: DataFrame, classes: DataFrame, k: int | Column, decay: str | Column = "Z", a: float | Column = 1.0, b: float | Column = 1.0, retry: bool = True, seed: int | None = None, hidden: DataFrame | None = None, folds: DataFrame | None = None) -> DataFrame:
    """(qid, predicted, distance, tie, exact, votes): the class with most votes.

    A tie is broken by one more bucket if that leaves a single class; else by the class's frequency in
    training, then by its number (or at random, given a seed). ``votes`` has (class_idx, class, w) of the
    vote that decided. ``hidden(qid, class, occ)`` is taken out of the frequencies of its class. With
    ``folds(qid, fold)`` classes have numbers and frequencies by ``fold``.
    """
    tally = votes(buckets, k, decay, a, b)
    tally = tally.join(classes, "class") if folds is None else tally.join(folds, "qid").join(classes, ["fold", "class"])
    if hidden is not None:
        tally = tally.join(hidden, ["qid", "class"], "left").withColumn("gfreq", F.col("gfreq") - F.coalesce("occ", F.lit(0))).drop("occ")
    last = F.xxhash64("qid", "class", F.lit(seed)) if seed is not None else -F.col("class_idx")
    frequency = F.lit(0) if seed is not None else F.col("gfreq")
    row = lambda v: F.struct(F.round(v, 10).alias("v"), frequency.alias("f"), last.alias("i"), F.col("class").alias("class"))
    each = F.collect_list(F.struct("class_idx", "class", "v", "v1"))
    heads = tally.groupBy("qid").agg(F.max(row(F.col("v"))).alias("first"), F.max(row(F.col("v1"))).alias("second"), each.alias("each"), F.min("near").alias("distance"))
    ties = lambda field, of: F.size(F.filter("each", lambda x: F.round(x[field], 10) == F.col(of)["v"])) > 1
    heads = heads.withColumn("tie", ties("v", "first"))
    again = F.col("tie") & ~ties("v1", "second") if retry else F.lit(False)
    heads = heads.withColumn("again", again)
    chosen = F.filter(F.transform(F.array_sort("each"), lambda x: F.struct(x["class_idx"].alias("class_idx"), x["class"].alias("class"), F.when(F.col("again"), x["v1"]).otherwise(x["v"]).alias("w"))), lambda x: x["w"] > 0)
    return heads.select("qid", F.when(F.col("again"), F.col("second")["class"]).otherwise(F.col("first")["class"]).alias("predicted"), "distance", "tie", (F.col("distance") < EPSILON).alias("exact"), chosen.alias("votes"))


def entropy(votes: Column) -> Column:
    """Entropy in bits of a distribution ``(class_idx, class, w)``."""
    total = F.aggregate(votes, F.lit(0.0), lambda acc, x: acc + x["w"])
    return F.aggregate(votes, F.lit(0.0), lambda acc, x: acc - x["w"] / total * F.log2(x["w"] / total))


def normalised(answered: DataFrame, classes: DataFrame, how: str = "probability", add: float = 1.0) -> DataFrame:
    """(qid, class, class_idx, w): the deciding votes, normalised: to shares, after adding to each class, or by logarithms."""
    rows = answered.select("qid", F.explode("votes").alias("x")).select("qid", "x.class_idx", "x.class", "x.w")
    if how == "none":
        return rows
    if how == "add":
        every = answered.select("qid").crossJoin(classes.select("class_idx", "class"))
        rows = every.join(rows, ["qid", "class_idx", "class"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)) + add)
    elif how == "log":
        rows = rows.withColumn("w", F.log1p("w"))
    return rows.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("qid")))


def beam(rows: DataFrame, n: int) -> DataFrame:
    """Classes whose weight is among the n highest different ones."""
    return rows.withColumn("nr", F.dense_rank().over(Window.partitionBy("qid").orderBy(F.desc(F.round("w", 10))))).where(F.col("nr") <= n).drop("nr")


def rendered(votes: Column, decimals: int = 5) -> Column:
    """``{ A 1.00000, B 2.00000 }`` in the order of the classes."""
    body = F.array_join(F.transform(votes, lambda x: F.concat_ws(" ", x["class"], F.format_string(f"%.{decimals}f", x["w"]))), ", ")
    return F.concat(F.lit("{ "), body, F.lit(" }"))
