"""Feature statistics as aggregations: contingency tables, entropies, weights, bins and value distributions.

``instances`` have an order key ``iid``, feature columns as strings, ``class`` and optionally ``occ``.
Results are small (values times classes); rows of the training table are only touched by the first,
map-side combined ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 2.0**-52
#: What stands for a missing value: a symbol like any other, equal to itself only.
MISSING = "\x00"


def symbols(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns as strings, missing values as MISSING."""
    return [F.coalesce(F.col(n).cast("string"), F.lit(MISSING)).alias(n) for n in names]


def occurrences(df: DataFrame) -> Column:
    return F.col("occ").cast("long") if "occ" in df.columns else F.lit(1).cast("long")


def class_table(instances: DataFrame) -> DataFrame:
    """(class, class_idx, gfreq): classes numbered from 1 in the order in which they first occur."""
    seen = instances.groupBy("class").agg(F.min("iid").alias("first"), F.sum(occurrences(instances)).alias("gfreq"))
    return seen.select("class", F.row_number().over(Window.orderBy("first", "class")).cast("long").alias("class_idx"), "gfreq")


def classes_without(own: DataFrame, folds: list) -> DataFrame:
    """(fold, class, class_idx, gfreq): ``class_table`` of the rows outside each fold, from ``own(fold, class, first, n)``."""
    # The first key outside a fold is the least of all, or the second if the fold has that itself.
    kept = own.groupBy("class").agg(F.sum("n").alias("all"), F.slice(F.sort_array(F.collect_list(F.struct("first", "fold"))), 1, 2).alias("least"))
    every = kept.withColumn("fold", F.explode(F.array(*map(F.lit, folds)))).join(own.select("fold", "class", "n"), ["fold", "class"], "left")
    other = F.when(F.col("least")[0]["fold"] == F.col("fold"), F.get("least", F.lit(1))["first"]).otherwise(F.col("least")[0]["first"])
    left = every.select("fold", "class", other.alias("first"), (F.col("all") - F.coalesce("n", F.lit(0))).alias("gfreq")).where("gfreq > 0")
    return left.select("fold", "class", F.row_number().over(Window.partitionBy("fold").orderBy("first", "class")).cast("long").alias("class_idx"), "gfreq")


def contingency(instances: DataFrame, features: list[str]) -> DataFrame:
    """(fidx, fval, class, cnt): how often each value of each feature goes with each class. Only cells are shuffled, never rows."""
    pairs = F.array(*(F.struct(F.lit(i).cast("long").alias("fidx"), F.col(f).alias("fval")) for i, f in enumerate(features, 1)))
    return instances.select(F.explode(pairs).alias("p"), "class", occurrences(instances).alias("cnt")).groupBy("p.fidx", "p.fval", "class").agg(F.sum("cnt").alias("cnt"))


def class_entropy(instances: DataFrame) -> DataFrame:
    """One row: ``db_entropy`` in bits."""
    each = instances.groupBy("class").agg(F.sum(occurrences(instances)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return each.select((-share * F.log2(share)).alias("h")).agg(F.sum("h").alias("db_entropy"))


def weights(table: DataFrame, clamp: bool = True) -> DataFrame:
    """(fidx, n_vals, ig, si, gr, x2, sv) of a contingency table.

    Summed by value, then by feature, so no task has all values of a feature. Chi-square is
    N * sum(cnt^2 / (n_v * n_c)) - N, which needs observed cells only.
    """
    log = lambda x: F.col(x) * F.log2(x)
    table = table.where("cnt > 0")
    of_class = table.groupBy("fidx", "class").agg(F.sum("cnt").alias("nc"))
    of_value = table.join(of_class, ["fidx", "class"]).groupBy("fidx", "fval").agg(F.sum("cnt").alias("nv"), F.sum(log("cnt")).alias("within"), F.sum(F.col("cnt") / F.col("nc") * F.col("cnt")).alias("oe"))
    classes = of_class.groupBy("fidx").agg(F.sum("nc").alias("n"), F.count("*").alias("n_classes"), F.sum(log("nc")).alias("by_class"))
    values = of_value.groupBy("fidx").agg(F.count("*").alias("n_vals"), F.sum(log("nv")).alias("by_value"), F.sum(log("nv") - F.col("within")).alias("rest"), F.sum(F.col("oe") / F.col("nv")).alias("oe"))
    sums = classes.join(values, "fidx").withColumn("h", F.log2("n") - F.col("by_class") / F.col("n")).withColumn("si", F.log2("n") - F.col("by_value") / F.col("n")).withColumn("hv", F.col("rest") / F.col("n"))
    gain = F.greatest(F.col("h") - F.col("hv"), F.lit(0.0)) if clamp else F.col("h") - F.col("hv")
    sums = sums.withColumn("ig", gain).withColumn("x2", F.col("n") * F.col("oe") - F.col("n"))
    least = F.least("n_classes", "n_vals") - 1
    return sums.select("fidx", "n_vals", "ig", "si", F.when((F.col("n_vals") < 2) | (F.abs("si") < EPSILON), 0.0).otherwise(F.try_divide("ig", "si")).alias("gr"), "x2", F.when(least > 0, F.try_divide(F.col("x2"), F.col("n") * least)).otherwise(0.0).alias("sv"))


def numeric(value: Column) -> Column:
    """The number that a value spells; null if none."""
    return value.try_cast("double")


def numeric_range(instances: DataFrame, features: list[str]) -> DataFrame:
    """``value_range`` of the values of ``instances``."""
    pairs = F.array(*(F.struct(F.lit(i).cast("long").alias("fidx"), F.col(f).alias("fval")) for i, f in enumerate(features, 1)))
    return value_range(instances.select(F.explode(pairs).alias("p")).select("p.fidx", "p.fval"))


def value_range(table: DataFrame) -> DataFrame:
    """(fidx, n_min, n_max, n_bad, sd): range over the values ``(fidx, fval)``, values that aren't numbers, and the spread weight."""
    values = table.select("fidx", "fval").distinct().withColumn("x", numeric(F.col("fval")))
    plain = values.groupBy("fidx").agg(F.min("x").alias("n_min"), F.max("x").alias("n_max"), F.sum(F.col("x").isNull().cast("long")).alias("n_bad"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.count("x").alias("m"))
    # The spread is taken about the sum of the distinct values, not about their mean.
    spread = F.sqrt(F.greatest(F.col("m") * F.col("s") * F.col("s") - 2 * F.col("s") * F.col("s") + F.col("s2"), F.lit(0.0)) / F.nullif(F.col("m"), F.lit(0)))
    return plain.select("fidx", "n_min", "n_max", "n_bad", spread.alias("sd"))


def binned(table: DataFrame, bins: int = 20) -> DataFrame:
    """A contingency table with the values of numeric features replaced by bins of equally many distinct values."""
    values = table.select("fidx", "fval", numeric(F.col("fval")).alias("x")).distinct()
    coded = _ntile(values.where("x is not null"), bins).select("fidx", "fval", "bin")
    return table.join(coded, ["fidx", "fval"]).groupBy("fidx", F.col("bin").cast("string").alias("fval"), "class").agg(F.sum("cnt").alias("cnt"))


def _ntile(values: DataFrame, bins: int) -> DataFrame:
    """``values(fidx, fval, x)`` with ``bin``, as NTILE by x within a feature: ranks from a range partitioning, so no task sorts all values."""
    placed = values.repartitionByRange("fidx", "x", "fval").withColumn("task", F.spark_partition_id()).persist()
    sizes = placed.groupBy("fidx", "task").agg(F.count("*").alias("own"))  # a row for each feature and task
    of = Window.partitionBy("fidx")
    ahead = F.coalesce(F.sum("own").over(of.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("fidx", "task", ahead.alias("ahead"), F.sum("own").over(of).alias("all"))
    rank = F.row_number().over(Window.partitionBy("fidx", "task").orderBy("x", "fval")) + F.col("ahead")
    small, more = F.floor(F.col("all") / bins), F.col("all") % bins
    bin_ = F.when(F.col("rank") <= more * (small + 1), F.ceil(F.col("rank") / (small + 1))).otherwise(more + F.ceil((F.col("rank") - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return placed.join(offsets, ["fidx", "task"]).withColumn("rank", rank).withColumn("bin", bin_.cast("int"))


def value_probs(table: DataFrame) -> DataFrame:
    """(fidx, fval, class, p, freq): the distribution of classes given a value."""
    by_value = Window.partitionBy("fidx", "fval")
    return table.where("cnt > 0").select("fidx", "fval", "class", (F.col("cnt") / F.sum("cnt").over(by_value)).alias("p"), F.sum("cnt").over(by_value).alias("freq"))


def ranges_without(table: DataFrame) -> DataFrame:
    """(fidx, fval, width, sd): range and spread of a feature's values without one row of that value.

    They change only where the row is the only one of its value: an end of the range gives way to the next value.
    """
    values = table.where("cnt > 0").groupBy("fidx", "fval").agg(F.sum("cnt").alias("n")).withColumn("x", numeric(F.col("fval")))
    plain = values.groupBy("fidx").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.count("x").alias("m"))
    both = values.join(plain, "fidx")
    # Different spellings of one number are values of their own: an end is left only if no other value has it.
    next_ = both.groupBy("fidx").agg(F.min(F.when(F.col("x") > F.col("least"), F.col("x"))).alias("least2"), F.max(F.when(F.col("x") < F.col("most"), F.col("x"))).alias("most2"), F.sum((F.col("x") == F.col("least")).cast("int")).alias("at_least"), F.sum((F.col("x") == F.col("most")).cast("int")).alias("at_most"))
    both = both.join(next_, "fidx")
    gone = (F.col("n") == 1) & F.col("x").isNotNull()
    low = F.when(gone & (F.col("x") == F.col("least")) & (F.col("at_least") == 1), F.col("least2")).otherwise(F.col("least"))
    high = F.when(gone & (F.col("x") == F.col("most")) & (F.col("at_most") == 1), F.col("most2")).otherwise(F.col("most"))
    less = lambda total, x: F.col(total) - F.when(gone, x).otherwise(F.lit(0))
    m, s, s2 = less("m", F.lit(1)), less("s", F.col("x")), less("s2", F.col("x") * F.col("x"))
    spread = F.sqrt(F.greatest(m * s * s - 2 * s * s + s2, F.lit(0.0)) / F.nullif(m, F.lit(0)))
    return both.select("fidx", "fval", F.coalesce(high - low, F.lit(0.0)).alias("width"), F.coalesce(spread, F.lit(0.0)).alias("sd"))


def binned_without(table: DataFrame, bins: int = 20) -> DataFrame:
    """(fidx, fval, class, ig, si, gr, x2, sv): weights of numeric features by bins, without one row of that value and class.

    A row whose value others have leaves the bins alone. Without the only row of a value there is one value less: of
    the new bins those below the value hold the ranks that they say, those above it the next ones, and the bin in between all the
    rest less that row. So there is one case for each bin that the value may fall into, not one for each value.
    """
    values = table.select("fidx", "fval", numeric(F.col("fval")).alias("x")).distinct()
    placed = _ntile(values.where("x is not null"), bins).select("fidx", "fval", "bin", "rank", "all")
    small, more = F.floor((F.col("all") - 1) / bins), (F.col("all") - 1) % bins
    at = lambda rank: F.when(rank <= more * (small + 1), F.ceil(rank / (small + 1))).otherwise(more + F.ceil((rank - more * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")
    below = F.when(F.col("rank") < F.col("all"), at(F.col("rank"))).otherwise(bins + 1)
    above = F.when(F.col("rank") > 1, at(F.col("rank") - 1)).otherwise(0)
    cells = table.where("cnt > 0").join(placed, ["fidx", "fval"]).withColumn("below", below).withColumn("above", above)
    often = cells.groupBy("fidx", "fval").agg(F.sum("cnt").alias("n"))
    keys = cells.select("fidx", "fval", "class", F.col("bin").cast("string").alias("bin"), "below").join(often, ["fidx", "fval"])
    same = weights_without(cells.groupBy("fidx", F.col("bin").cast("string").alias("fval"), "class").agg(F.sum("cnt").alias("cnt")), clamp=False)
    shared = keys.where("n > 1").join(same.withColumnRenamed("fval", "bin"), ["fidx", "bin", "class"])
    # A cell by where its value lies in either dealing; for a case it's the bin below, above, or the case itself.
    dealt = cells.groupBy("fidx", "class", "below", "above").agg(F.sum("cnt").alias("cnt")).withColumn("case", F.explode(F.sequence(F.lit(1), F.lit(bins + 1))))
    bin_ = F.when(F.col("below") < F.col("case"), F.col("below")).when(F.col("above") > F.col("case"), F.col("above")).otherwise(F.col("case"))
    case = F.concat_ws(":", "fidx", "case")
    cases = dealt.groupBy(case.alias("fidx"), bin_.cast("string").alias("fval"), "class").agg(F.sum("cnt").alias("cnt"))
    # The top value is in no bin of its case but the one after the last, which is left out with it.
    inner = weights_without(cases, clamp=False)
    inner = inner.where(F.substring_index("fidx", ":", -1) == F.col("fval"))
    top = weights(cases.where((F.substring_index("fidx", ":", -1) == str(bins + 1)) & (F.col("fval") != str(bins + 1))), clamp=False).select(F.substring_index("fidx", ":", 1).cast("long").alias("fidx"), "ig", "si", "gr", "x2", "sv")
    alone = keys.where("n = 1")
    inside = alone.where(F.col("below") <= bins).withColumn("case", F.concat_ws(":", "fidx", "below")).join(inner.select(F.col("fidx").alias("case"), "class", "ig", "si", "gr", "x2", "sv"), ["case", "class"])
    last = alone.where(F.col("below") > bins).join(top, "fidx")
    names = ["fidx", "fval", "class", "ig", "si", "gr", "x2", "sv"]
    return shared.select(*names).unionByName(inside.select(*names)).unionByName(last.select(*names))


def weights_without(table: DataFrame, clamp: bool = True) -> DataFrame:
    """(fidx, fval, class, ig, si, gr, x2, sv): the weights of a feature in a table without one row of that value and class.

    Sums over values and classes change in one place only, so they are corrected rather than taken again.
    """
    log = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    table = table.where("cnt > 0")
    of_class = table.groupBy("fidx", "class").agg(F.sum("cnt").alias("nc"))
    cells = table.join(of_class, ["fidx", "class"])
    of_value = cells.groupBy("fidx", "fval").agg(F.sum("cnt").alias("nv"), F.sum(log(F.col("cnt"))).alias("within"), F.sum(F.col("cnt") / F.col("nc") * F.col("cnt")).alias("oe"))
    # Of a class: sum over values of cnt^2 / nv, which is divided by nc.
    by_class = cells.join(of_value.select("fidx", "fval", "nv"), ["fidx", "fval"]).groupBy("fidx", "class").agg(F.sum(F.col("cnt") / F.col("nv") * F.col("cnt")).alias("on"), F.max("nc").alias("nc"))
    classes = by_class.groupBy("fidx").agg(F.sum("nc").alias("n"), F.count("*").alias("n_classes"), F.sum(log(F.col("nc"))).alias("by_class"), F.sum(F.col("on") / F.col("nc")).alias("oe_all"))
    values = of_value.groupBy("fidx").agg(F.count("*").alias("n_vals"), F.sum(log(F.col("nv"))).alias("by_value"), F.sum("within").alias("within_all"))
    x = table.join(of_value, ["fidx", "fval"]).join(by_class, ["fidx", "class"]).join(classes, "fidx").join(values, "fidx")
    c, nv, nc, n = (F.col(k) for k in ("cnt", "nv", "nc", "n"))
    left = n - 1
    shift = lambda total, k: F.col(total) - log(k) + log(k - 1)
    x = x.withColumn("h", F.log2(left) - shift("by_class", nc) / left).withColumn("si1", F.log2(left) - shift("by_value", nv) / left)
    x = x.withColumn("hv", (shift("by_value", nv) - shift("within_all", c)) / left)
    # Terms of the row's value (its size falls) and of its class (its size falls), the shared cell once.
    part = lambda a, b, d: F.when((b > 0) & (d > 0), a * a / (b * d)).otherwise(0.0)
    same_value = F.when(nv > 1, (F.col("oe") - c * c / nc) / (nv - 1)).otherwise(0.0) - (F.col("oe") - c * c / nc) / nv
    same_class = F.when(nc > 1, (F.col("on") - c * c / nv) / (nc - 1)).otherwise(0.0) - (F.col("on") - c * c / nv) / nc
    x = x.withColumn("x2", left * (F.col("oe_all") + same_value + same_class - part(c, nv, nc) + part(c - 1, nv - 1, nc - 1)) - left)
    x = x.withColumn("ig", F.greatest(F.col("h") - F.col("hv"), F.lit(0.0)) if clamp else F.col("h") - F.col("hv"))
    vals, labels = F.col("n_vals") - (nv == 1).cast("long"), F.col("n_classes") - (nc == 1).cast("long")
    least = F.least(vals, labels) - 1
    gr = F.when((vals < 2) | (F.abs("si1") < EPSILON), 0.0).otherwise(F.try_divide("ig", "si1"))
    return x.select("fidx", "fval", "class", "ig", F.col("si1").alias("si"), gr.alias("gr"), "x2", F.when(least > 0, F.try_divide(F.col("x2"), left * least)).otherwise(0.0).alias("sv"))


def probs_without(table: DataFrame, classes: DataFrame) -> DataFrame:
    """(fidx, fval, class, p, freq): the packed class distribution of a value without one row of that class."""
    numbered = table.where("cnt > 0").join(classes.select("class", "class_idx"), "class")
    own = numbered.groupBy("fidx", "fval").agg(F.map_from_entries(F.collect_list(F.struct("class_idx", "cnt"))).alias("m"), F.sum("cnt").alias("n"))
    x = numbered.select("fidx", "fval", "class", "class_idx").join(own, ["fidx", "fval"]).crossJoin(classes.agg(F.max("class_idx").alias("last")))  # one row
    less = lambda i: (F.coalesce(F.element_at("m", i), F.lit(0)) - (i == F.col("class_idx")).cast("long")) / F.greatest(F.col("n") - 1, F.lit(1))
    return x.select("fidx", "fval", "class", F.transform(F.sequence(F.lit(1).cast("long"), "last"), less).alias("p"), (F.col("n") - 1).alias("freq"))


def tree_order(measures: dict[int, dict[str, float]], order: str) -> list[int]:
    """Feature numbers, the best first; ties keep their order. ``measures`` has gr, ig, si, x2, sv, sd and n_vals by feature."""
    # Names of orders and the quantities they rank by (fixed values).
    rank = {
        "DO": lambda m: 1.0,
        "GRO": lambda m: m["gr"], "IGO": lambda m: m["ig"], "X2O": lambda m: m["x2"], "SVO": lambda m: m["sv"], "SDO": lambda m: m["sd"],
        "1/V": lambda m: 1 / m["n_vals"], "1/S": lambda m: 1 / m["si"] if m["si"] else 0.0,
        "G/V": lambda m: m["gr"] / m["n_vals"], "I/V": lambda m: m["ig"] / m["n_vals"], "X/V": lambda m: m["x2"] / m["n_vals"], "S/V": lambda m: m["sv"] / m["n_vals"], "SD/V": lambda m: m["sd"] / m["n_vals"],
        "GxE": lambda m: m["gr"] * m["si"], "IxE": lambda m: m["ig"] * m["si"],
    }
    if order == "UDO":
        return sorted(measures, reverse=True)
    return sorted(measures, key=lambda f: (-rank[order](measures[f]), f))
