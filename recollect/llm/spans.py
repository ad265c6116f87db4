"""Spans of regular expressions in code points, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches of one text are numbered in blocks of this many, so that long lists aren't copied again and again.
BLOCK = 256

SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,match:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def gaps(text: Column, pattern: str, found: Column) -> Column:
    """Lengths of what stands before each match; null without a match."""
    return F.when(F.size(found) > 0, F.transform(F.split(text, pattern, -1), lambda x: F.length(x)))


def located(found: Column, gap: Column) -> Column:
    """array<struct<start, end, match>> from the matches and the lengths between them."""
    rows = F.zip_with(found, F.slice(gap, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + z["g"]
        end = start + F.length(z["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), z["m"].alias("match")))).alias("out"))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda acc, z: acc + z["g"] + F.length(z["m"]))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    based = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases")),
        lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")),
    )["bases"]
    return F.when(F.size(found) > 0, F.flatten(F.zip_with(blocks, based, lambda b, base: F.aggregate(b, F.struct(base.alias("at"), empty.alias("out")), step)["out"]))).otherwise(empty)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each span, or of spans that overlap; taken in blocks, as ``located`` is."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda b: F.slice(spans, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    upto = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
    based = F.aggregate(upto, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x))))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], before).alias("out"))

    pieces = F.zip_with(blocks, F.slice(based, F.lit(1), F.size(blocks)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.lit("").alias("out")), step)["out"])
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(based, -1) + 1, F.length(text)))


def kinded(spans: Column, kind: str, number: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")))


def ordered(parts: Sequence[Column]) -> Column:
    """All spans by start, then by the kinds' order."""
    return F.array_sort(F.concat(*parts))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined; empty without spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def count_of(kind: str) -> Callable[[Column], Column]:
    return lambda spans: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
