"""Evaluation of predictions: ``rows`` have ``class`` and ``predicted``."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: tested, correct, accuracy, exact matches, ties and what became of them."""
    right = F.col("class").eqNullSafe(F.col("predicted")).cast("long")
    flag = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in rows.columns else F.lit(0)
    return rows.agg(F.count("*").alias("tested"), F.sum(right).alias("correct"), F.avg(right.cast("double")).alias("accuracy"), F.sum(flag("exact")).alias("exact"), F.sum(flag("tie") * right).alias("ties_correct"), F.sum(flag("tie") * (1 - right)).alias("ties_failed"))


def confusion(rows: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(class, predicted, n); a class unknown in training becomes null."""
    if classes is not None:
        known = classes.select(F.col("class").alias("known"))
        rows = rows.join(known, F.col("class") == F.col("known"), "left").withColumn("class", F.col("known"))
    return rows.groupBy("class", "predicted").agg(F.count("*").alias("n"))


def scores(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: gfreq (in training), tp, fp, fn, tn, precision, recall, fpr, f1, auc; what isn't defined is null."""
    every = matrix.agg(F.sum("n").alias("total"))
    known = matrix.where("class is not null")
    tp = known.where("class = predicted").select("class", F.col("n").alias("tp"))
    rows = known.groupBy("class").agg(F.sum("n").alias("of_class"))
    columns = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("as_class"))
    df = classes.select("class", "gfreq").join(tp, "class", "left").join(rows, "class", "left").join(columns, "class", "left").na.fill(0).crossJoin(F.broadcast(every))
    df = df.withColumn("fn", F.col("of_class") - F.col("tp")).withColumn("fp", F.col("as_class") - F.col("tp"))
    df = df.withColumn("tn", F.col("total") - F.col("tp") - F.col("fn") - F.col("fp"))
    ratio = lambda a, b: F.when(b > 0, F.try_divide(a, b))
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("as_class"))).withColumn("recall", ratio(F.col("tp"), F.col("of_class"))).withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    df = df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    area = 0.5 * F.col("recall") * F.col("fpr") + F.col("recall") * (1 - F.col("fpr")) + 0.5 * (1 - F.col("recall")) * (1 - F.col("fpr"))
    return df.select("class", "gfreq", "tp", "fp", "fn", "tn", "precision", "recall", "fpr", "f1", area.alias("auc"))


def averages(scored: DataFrame) -> DataFrame:
    """Micro averages (by the class's frequency in training) and macro averages (over defined values) of F and AUC."""
    size = F.col("gfreq")
    micro = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col(c) * size)) / F.sum(F.when(F.col(c).isNotNull(), size))
    return scored.agg(micro("f1").alias("micro_f1"), F.avg("f1").alias("macro_f1"), micro("auc").alias("micro_auc"), F.avg("auc").alias("macro_auc"))


def folds(instances: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``instances`` dealt into n folds by a hash of their key."""
    return instances.withColumn("fold", F.pmod(F.xxhash64("iid", F.lit(seed)), F.lit(n)))


def timed(rows: DataFrame) -> tuple[float, float]:
    """Seconds that a plan takes to the end, and its rows a second; nothing is written."""
    began, n = time.perf_counter(), rows.count()
    rows.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return took, n / took
