"""Writers of results and of what a learner knows, each a DataFrame written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..model import MemoryBasedLearner
from ..operators.evaluate import accuracy
from ..operators.vote import rendered


def escaped(value: Column) -> Column:
    """A value without white space: ``\\_`` for a space, ``\\t`` for a tab, ``\\\\`` for a backslash."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit(" "), F.lit("\\_")), F.lit("\t"), F.lit("\\t"))


def unescaped(value: Column) -> Column:
    """What ``escaped`` was given."""
    mark = F.lit("\x01")
    plain = F.replace(F.replace(F.replace(value, F.lit("\\\\"), mark), F.lit("\\_"), F.lit(" ")), F.lit("\\t"), F.lit("\t"))
    return F.replace(plain, mark, F.lit("\\"))


def results(learner: MemoryBasedLearner, queries: DataFrame) -> DataFrame:
    """``learner``'s answers with the columns that its options show: confidence, distribution (text), distance, depth (``n:L`` or ``n:N``), neighbours (text)."""
    show, answered = learner.options.show, learner.transform(queries)
    out = answered.select("qid", "predicted")
    if "confidence" in show:
        out = out.join(learner.confidence(answered), "qid")
    if "distribution" in show:
        own = learner.distribution(answered).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("class_idx", "class", "w"))).alias("votes"))
        out = out.join(own.select("qid", rendered(F.col("votes")).alias("distribution")), "qid")
    if "distance" in show:
        out = out.join(answered.select("qid", "distance"), "qid")
    if "depth" in show and "depth" in answered.columns:
        out = out.join(answered.select("qid", F.concat_ws(":", F.col("depth").cast("string"), F.when(F.col("leaf"), "L").otherwise("N")).alias("depth")), "qid")
    if "neighbours" in show:
        rows = learner.examples(queries).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k", "place", "distance", "pattern", "class", "cnt"))).alias("n"))
        text = F.array_join(F.transform("n", lambda x: F.concat_ws(" ", F.concat(F.lit("# k="), x["k"].cast("string")), x["pattern"], F.concat(x["class"], F.lit("*"), x["cnt"].cast("string")), F.format_string("%.6f", x["distance"]))), "; ")
        out = out.join(rows.select("qid", text.alias("neighbours")), "qid", "left")
    return out


def classified(queries: DataFrame, answered: DataFrame, features: list[str], distribution: bool = False, distance: bool = False, separator: str = ",") -> DataFrame:
    """(qid, value): a line of fields, true class, predicted class, and what ``answered`` has besides (or is asked for)."""
    rows = queries.select("qid", *features, "class").join(answered, "qid")
    text = (lambda c: F.col(c)) if separator == "," else (lambda c: escaped(F.col(c)))
    line = F.concat_ws(separator, *(text(f) for f in features), text("class"), text("predicted"))
    if "confidence" in answered.columns:
        line = F.concat_ws(" ", line, F.format_string("[%.6f]", "confidence"))
    if "distribution" in answered.columns:
        line = F.concat_ws(" ", line, "distribution")
    elif distribution:
        line = F.concat_ws(" ", line, rendered(F.col("votes")))
    if distance or ("distance" in answered.columns and "votes" not in answered.columns and "tie" not in answered.columns):
        line = F.concat_ws(" ", line, F.format_string("%.6f", "distance"))
    if "depth" in answered.columns and dict(answered.dtypes)["depth"] == "string":
        line = F.concat_ws(" ", line, "depth")
    if "neighbours" in answered.columns:
        line = F.concat_ws(" ", line, "neighbours")
    return rows.select("qid", line.alias("value"))


def percentage(tested: DataFrame) -> DataFrame:
    """Three lines: the percentage of right answers, rows tested, rows right."""
    row = accuracy(tested)
    texts = F.array(F.format_string("%.4f", F.col("accuracy") * 100), F.format_string("tested %d lines", "tested"), F.format_string("correct %d lines", "correct"))
    return row.select(F.posexplode(texts).alias("qid", "value"))


def write_lines(rows: DataFrame, path: str, key: str = "qid") -> None:
    """``value`` as text, sorted by ``key`` over all files."""
    rows.orderBy(key).select("value").write.mode("overwrite").text(path)


def as_json(answered: DataFrame) -> DataFrame:
    """(qid, value): category, distance, votes and what else ``answered`` has, as a JSON object."""
    shown = [F.col("predicted").alias("category"), *(c for c in answered.columns if c not in ("qid", "predicted"))]
    return answered.select("qid", F.to_json(F.struct(*shown)).alias("value"))


def write_weights(learner: MemoryBasedLearner, path: str) -> None:
    """Sections nw, gr, ig, x2, sv and sd, a line for each feature: number, tab, weight."""
    rows = learner.weights().withColumn("nw", F.lit(1.0))
    names = ("nw", "gr", "ig", "x2", "sv", "sd")
    heads = learner.fitted.base.sparkSession.createDataFrame([(k, at, text) for k, name in enumerate(names) for at, text in ((-1, f"# {name}"), (0, "# Fea.\tWeight"), (1 << 40, "#"))], "section int, fidx long, value string")
    body = None
    for k, name in enumerate(names):
        part = rows.select(F.lit(k).alias("section"), "fidx", F.concat_ws("\t", F.col("fidx").cast("string"), F.col(name).cast("string")).alias("value"))
        body = part if body is None else body.union(part)
    heads.union(body).coalesce(1).sortWithinPartitions("section", "fidx").select("value").write.mode("overwrite").text(path)  # a line for each feature


def write_distances(pairs: DataFrame, path: str) -> None:
    pairs.select("fidx", "v", "w", "d").write.mode("overwrite").csv(path, sep="\t", quote="")


def write_value_probs(probs: DataFrame, path: str) -> None:
    probs.select("fidx", "fval", "class", "p", "freq").write.mode("overwrite").csv(path, sep="\t", quote="")


def array_lines(learner: MemoryBasedLearner) -> DataFrame:
    """(place, value): class distributions as ``read_arrays`` reads them, three decimals each."""
    known = learner.fitted
    classes = known.classes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "class"))), lambda x: x["class"]), ",\t").alias("names"))
    head = classes.select(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("place"), F.concat(F.lit("targets "), "names", F.lit(".")).alias("value"))
    packed = M.packed(learner.value_probs(), known.classes)
    shares = F.array_join(F.transform("p", lambda x: F.format_string("%.3f", x)), "\t")
    rows = packed.select(F.array("fidx", F.lit(2).cast("long")).alias("place"), F.concat_ws("\t", F.col("fval"), shares).alias("value"))
    heads = packed.select("fidx").distinct().select(F.array("fidx", F.lit(1).cast("long")).alias("place"), F.format_string("feature # %d Matrix:", "fidx").alias("value"))
    ends = packed.select("fidx").distinct().select(F.array("fidx", F.lit(3).cast("long")).alias("place"), F.lit("").alias("value"))
    return head.union(heads).union(rows).union(ends)


def matrix_lines(pairs: DataFrame) -> DataFrame:
    """(place, value): distances ``(fidx, v, w, d)`` as ``read_matrices`` reads them, each pair once."""
    once = pairs.where("v < w")
    rows = once.select(F.array("fidx", F.lit(1).cast("long")).alias("place"), F.concat(F.lit("["), "v", F.lit(",\t"), "w", F.lit("] "), F.col("d").cast("string")).alias("value"))
    heads = once.select("fidx").distinct()
    return heads.select(F.array("fidx", F.lit(0).cast("long")).alias("place"), F.format_string("Feature %d", "fidx").alias("value")).union(rows).union(heads.select(F.array("fidx", F.lit(2).cast("long")).alias("place"), F.lit("").alias("value")))


def level_lines(learner: MemoryBasedLearner, least: int = 1) -> DataFrame:
    """(place, value): each prefix of ``least`` values or more with its classes and the values that follow, ``2 [ a b ] { X 3, Y 1 } < c d >``.

    Classes are in the order of their numbers, values in that of their text; the whole patterns have none that follow.
    """
    known = learner.fitted
    cells = learner.levels().where(F.col("depth") >= least).join(known.classes.select("class", "class_idx"), "class")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "class", "cnt"))), lambda x: F.concat_ws(" ", x["class"], x["cnt"].cast("string")))
    classes = cells.groupBy("depth", "key").agg(F.concat(F.lit("{ "), F.array_join(shown, ", "), F.lit(" }")).alias("classes"))
    after = learner.next_values().groupBy("depth", "key").agg(F.array_join(F.array_sort(F.collect_list("next_value")), " ").alias("after"))
    line = F.concat(F.col("depth").cast("string"), F.lit(" [ "), F.array_join("key", " "), F.lit(" ] "), F.col("classes"), F.concat(F.lit(" < "), F.col("after"), F.lit(" >")))
    whole = F.concat(F.col("depth").cast("string"), F.lit(" [ "), F.array_join("key", " "), F.lit(" ] "), F.col("classes"), F.lit(" < >"))
    return classes.join(after, ["depth", "key"], "left").select(F.struct("depth", "key").alias("place"), F.coalesce(line, whole).alias("value"))


def names(learner: MemoryBasedLearner) -> DataFrame:
    """(fidx, value): the classes (number 0), then the values of each feature, comma-joined."""
    known = learner.fitted
    classes = known.classes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "class"))), lambda x: x["class"]), ",").alias("value")).select(F.lit(0).cast("long").alias("fidx"), "value")
    return classes.union(learner.value_sets().select("fidx", F.array_join("values", ",").alias("value")))
