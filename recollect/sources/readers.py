"""Readers of instance files: text lines to (iid, features, class), with optional row weights or counts.

Lines are read and split by Spark; only a first line reaches the driver, to tell the format and the width.
``iid`` grows with the position in the files, which come in the order of their names. Blank lines and lines
of another width are left out; ``skipped`` counts them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..options import WEIGHTINGS, Options

FORMATS = ("C4.5", "ARFF", "Columns", "Tabbed", "Compact", "Sparse", "Binary")
#: What absent features hold (fixed values).
SPARSE_FILL, BINARY_FILL = "0.0000E-17", "0"
VARIANTS = (None, "exemplar", "occurrence")


def sniff(line: str) -> str:
    """Format of a line: no separators is Compact; at least as many commas as runs of whitespace is C4.5; else Columns."""
    commas, runs = line.count(","), len(re.findall(r"\s+", line.strip()))
    return "Compact" if not commas and not runs else "C4.5" if commas >= runs else "Columns"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(iid, value): lines numbered by position, unique over all files of ``path``."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.first("size").alias("size"))
    files = splits.groupBy("file").agg(F.first("size").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    splits = splits.join(files.select("file", ahead.alias("offset")), "file").select("file", "block", "first", "offset")
    return raw.join(splits, ["file", "block"]).select((F.col("offset") + F.col("block") + F.col("at") - F.col("first")).alias("iid"), "value")


def _fields(fmt: str, value: Column, n: int, width: int) -> Column:
    """All fields of a line as an array, the class last."""
    bare = F.regexp_replace(F.rtrim(value), r"\.$", "")
    if fmt in ("C4.5", "ARFF"):
        return F.transform(F.split(bare, ","), lambda x: F.trim(x))
    if fmt == "Columns":
        return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")
    if fmt == "Tabbed":
        return F.split(value, "\t")
    if fmt == "Compact":
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(value) / width).cast("int") - 1, F.lit(0))), lambda i: F.substring(value, i * width + 1, F.lit(width)))
    if fmt == "Sparse":
        pairs = F.map_from_entries(F.transform(F.regexp_extract_all(value, F.lit(r"\((\d+,[^()]*)\)"), F.lit(1)), lambda x: F.struct(F.substring_index(x, ",", 1).cast("int").alias("k"), F.trim(F.regexp_replace(x, r"^\d+,", "")).alias("v"))))
        label = F.trim(F.regexp_replace(bare, r"\(\d+,[^()]*\)\s*,?", ""))
        return F.concat(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.element_at(pairs, i), F.lit(SPARSE_FILL))), F.array(label))
    parts = F.transform(F.split(bare, ","), lambda x: F.trim(x))
    on = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.cast("int"))
    return F.concat(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(F.array_contains(on, i), "1").otherwise(BINARY_FILL)), F.array(F.element_at(parts, -1)))


def _parsed(spark: SparkSession, path: str, fmt: str | None, n: int | None, width: int, variant: str | None) -> tuple[DataFrame, int]:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    rows = lines(spark, path).where(F.length(F.trim("value")) > 0)
    if fmt == "ARFF":
        begin = rows.where(F.lower(F.trim("value")).startswith("@data")).agg(F.min("iid")).first()[0]
        if begin is None:
            raise ValueError("no @data line")
        rows = rows.where(F.col("iid") > begin)
    tail = r"\s+(\S+)\s*$"
    if variant:
        rows = rows.select("iid", F.regexp_replace("value", tail, "").alias("value"), F.regexp_extract("value", tail, 1).cast("double" if variant == "exemplar" else "long").alias("extra"))
    first = rows.orderBy("iid").limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no rows")
    fmt = fmt or sniff(first[0]["value"])
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt in ("Sparse", "Binary"):
        if not n:
            raise ValueError(f"{fmt} needs the number of features")
    else:
        n = spark.createDataFrame([(first[0]["value"],)], "value string").select(F.size(_fields(fmt, F.col("value"), 0, width)).alias("n")).first()["n"] - 1
    return rows.withColumn("fields", _fields(fmt, F.col("value"), n, width)), n


def _good(n: int, variant: str | None) -> Column:
    full = (F.size("fields") == n + 1) & ~F.exists("fields", lambda x: x == "")
    return full & F.col("extra").isNotNull() if variant else full


def read(spark: SparkSession, path: str, fmt: str | None = None, n: int | None = None, width: int = 1, target: int | None = None, variant: str | None = None, ignore_weights: bool = False) -> DataFrame:
    """(iid, f1 .. fn, class), with ``exw`` (exemplar) or ``occ`` (occurrence); ``target`` is the class's field, the last by default."""
    rows, n = _parsed(spark, path, fmt, n, width, variant)
    at = n + 1 if target is None else target
    if not 1 <= at <= n + 1:
        raise ValueError(f"there is no field {at}")
    others = [k for k in range(1, n + 2) if k != at]
    columns = [F.col("fields")[k - 1].alias(f"f{i}") for i, k in enumerate(others, 1)]
    extra = [] if not variant or ignore_weights else [F.col("extra").alias("exw" if variant == "exemplar" else "occ")]
    return rows.where(_good(n, variant)).select("iid", *columns, F.col("fields")[at - 1].alias("class"), *extra)


def skipped(spark: SparkSession, path: str, fmt: str | None = None, n: int | None = None, width: int = 1, variant: str | None = None) -> DataFrame:
    """(iid, value) of the lines that ``read`` leaves out, blank ones aside."""
    rows, n = _parsed(spark, path, fmt, n, width, variant)
    return rows.where(~F.coalesce(_good(n, variant), F.lit(False))).select("iid", "value")


def folds(spark: SparkSession, paths: list[str], **how) -> DataFrame:
    """The rows of several files with ``fold``, their number from 1; at least three files of one width."""
    if len(paths) < 3:
        raise ValueError("cross-validation needs three files or more")
    out = None
    for k, path in enumerate(paths, 1):
        part = read(spark, path, **how).withColumn("fold", F.lit(k)).withColumn("iid", F.col("iid") + F.lit((k - 1) << 44))
        if out is not None and part.columns != out.columns:
            raise ValueError("the files differ in width")
        out = part if out is None else out.unionByName(part)
    return out


def read_settings(spark: SparkSession, path: str) -> list[Options]:
    """One set of options for each line of a file of switches; lines that begin with # are comments."""
    rows = lines(spark, path).orderBy("iid").collect()  # a line for each run
    return [Options.parse(r["value"]) for r in rows if r["value"].strip() and not r["value"].lstrip().startswith("#")]


def read_weights(spark: SparkSession, path: str, name: str) -> dict[int, float]:
    """Weights by feature number from the section ``name`` of a weights file (a row for each feature).

    A file without named sections has one for any name. ``Ignore`` stands for 0.
    """
    sections: dict[str | None, dict[int, float]] = {None: {}}
    on: str | None = None
    for row in lines(spark, path).orderBy("iid").collect():  # a line for each feature
        words = row["value"].split()
        if words and words[0].startswith("#"):
            head = " ".join(words).lstrip("# ")
            if head in WEIGHTINGS:
                on = head
                sections[on] = {}
        elif len(words) == 2:
            sections[on][int(words[0])] = 0.0 if words[1].lower() == "ignore" else float(words[1])
    out = sections.get(name, {}) if len(sections) > 1 else sections[None]
    if not out:
        raise ValueError(f"no weights {name!r} in {path}")
    return out


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(fidx, v, w, d) from a table of distances, one tab-separated row each."""
    return spark.read.csv(path, sep="\t", schema="fidx long, v string, w string, d double", quote="")


def read_value_probs(spark: SparkSession, path: str) -> DataFrame:
    """(fidx, fval, class, p, freq) from a table of class distributions."""
    return spark.read.csv(path, sep="\t", schema="fidx long, fval string, class string, p double, freq long", quote="")


def _numbered(spark: SparkSession, path: str, head: str) -> DataFrame:
    """(iid, value, fidx): lines with the number that the last heading above them gives; there is a heading for each feature."""
    rows = lines(spark, path)
    number = F.regexp_extract("value", head, 1)
    heads = rows.where(number != "").select("iid", number.cast("long").alias("fidx")).orderBy("iid").collect()
    at = F.array(*(F.struct(F.lit(r["iid"]).alias("iid"), F.lit(r["fidx"]).alias("fidx")) for r in heads)) if heads else None
    if at is None:
        raise ValueError(f"{path} has no features")
    above = F.filter(at, lambda h: h["iid"] < F.col("iid"))
    return rows.where((number == "") & (F.size(above) > 0)).select("iid", "value", F.try_element_at(above, F.lit(-1))["fidx"].alias("fidx"))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(fidx, fval, class, p) from a file of class distributions: the classes, then a matrix for each feature, a value and its shares a line."""
    first = lines(spark, path).where(F.lower("value").startswith("targets")).orderBy("iid").first()
    if first is None:
        raise ValueError(f"{path} names no classes")
    classes = [c.strip(" \t.") for c in first["value"].split(None, 1)[1].split(",")]
    rows = _numbered(spark, path, r"(?i)^feature\s*#\s*(\d+)\s*Matrix").withColumn("parts", F.split(F.trim("value"), r"\s+")).where(F.size("parts") == len(classes) + 1)
    each = F.posexplode(F.slice("parts", F.lit(2), F.lit(len(classes))))
    cells = rows.select("fidx", F.element_at("parts", 1).alias("fval"), each.alias("k", "share"))
    return cells.select("fidx", "fval", F.element_at(F.array(*map(F.lit, classes)), F.col("k") + 1).alias("class"), F.col("share").cast("double").alias("p"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(fidx, v, w, d) from a file of distance matrices: a heading for each feature, then ``[v,<tab>w] d`` a line."""
    rows = _numbered(spark, path, r"(?i)^feature\s*(\d+)\s*$")
    part = lambda k: F.regexp_extract("value", r"^\[(.*),\t(.*)\]\s+(\S+)\s*$", k)
    return rows.where(part(3) != "").select("fidx", part(1).alias("v"), part(2).alias("w"), part(3).cast("double").alias("d"))
