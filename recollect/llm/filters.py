"""Interaction of filters: which documents each filter removes in every order, from signed parity sums.

A document's mask has a bit for each filter that it fails. For every set of filters the operator sums +1 or -1
over documents, by whether the mask shares an even or odd number of bits with the set (a Walsh-Hadamard
transform of the counts of masks, taken while counting). These sums add up over tasks and tables; inverted they give
the exact count of each mask, and those answer for all orders. Shapley values have a closed form: in
n! orders a document with c failures is first removed by each of its filters n!/c times.

A null text counts as empty, a null part as the empty string. A document without an id is no copy and has no copies.
Rows of one id and text are one another's equals, not copies. A document is good or toxic if any of its label
rows says so. An empty table has no parts and gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored

#: The filters by letter; bit k of a mask is the k-th of them.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
WORD, UPPER = r"[^\x20\x09-\x0D]+", "[^A-Z]+"


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` of each document: few words, few different words, capitals, symbols, a copy.

    Copies are found by a digest of the text: the least id of each is a sum over all copies, and it's looked up by
    id, so no task gets all copies of a text.
    """
    t = F.coalesce(quoted(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    known = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(part).cast("string"), F.lit("")).alias("part"), t.alias("t"), words.alias("words"))
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    failed = [n < LEAST_WORDS, 100 * different < LEAST_DISTINCT * n, 100 * F.length(F.regexp_replace("t", UPPER, "")) > MOST_UPPER * F.length("t"), F.col("t").rlike(SYMBOLS)]
    own = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    rows = stored(known.select("doc_id", "part", own.alias("mask"), F.unhex(F.sha2("t", 256)).alias("content")), "failures")
    first = rows.groupBy("content").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["doc_id", "content"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << len(failed)).otherwise(0)).alias("mask"))


def _odd(mask: Column, among: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(among)) % 2 == 1


def sums(masks: DataFrame, labels: list[str], filters: int = len(FILTERS)) -> DataFrame:
    """(part, label, parity): for each part and label the 2**filters signed sums; label "" stands for all rows.

    ``masks`` has ``part``, ``mask`` and a boolean column for each of the labels.
    """
    said = [F.lit(""), *(F.when(F.col(name), F.lit(name)) for name in labels)]
    rows = masks.select("part", "mask", F.explode(F.array_compact(F.array(*said))).alias("label"))
    signed = [F.sum(F.when(_odd(F.col("mask"), F.lit(s)), -1).otherwise(1)).alias(f"s{s}") for s in range(1 << filters)]
    return rows.groupBy("part", "label").agg(*signed).select("part", "label", F.array(*(f"s{s}" for s in range(1 << filters))).alias("parity"))


def cells(parity: Column, filters: int = len(FILTERS)) -> Column:
    """Counts of all masks from the signed sums: the transform is its own inverse but for a factor 2**filters."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    back = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda total, s: total + F.when(_odd(m, s), -1).otherwise(1) * F.element_at(parity, s + 1))
    return F.transform(every, lambda m: F.shiftright(back(m), filters))


def _over(counts: Column, chosen, filters: int) -> Column:
    """Sum of the counts of masks, each times what ``chosen`` says of the mask."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    return F.aggregate(every, F.lit(0).cast("long"), lambda total, m: total + chosen(m) * F.element_at(counts, m + 1))


def audit(masks: DataFrame, good: str = "good", toxic: str = "toxic", filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n, none = len(filters), F.array_repeat(F.lit(0).cast("long"), 1 << len(filters))
    of = lambda label: F.coalesce(F.max(F.when(F.col("label") == label, F.col("cells"))), none)
    counted = sums(masks, [good, toxic], n).withColumn("cells", cells(F.col("parity"), n)).groupBy("part").agg(of("").alias("every"), of(good).alias("good"), of(toxic).alias("toxic"))
    steps = []
    for order in permutations(filters):
        before = 0
        for k, letter in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k).alias("step"), F.lit(before).alias("before"), F.lit(1 << filters.index(letter)).alias("bit")))
            before |= 1 << filters.index(letter)
    rows = counted.withColumn("x", F.explode(F.array(*steps))).select("part", "every", "good", "toxic", "x.*")
    before, bit = F.col("before"), F.col("bit")
    fails = lambda m: m.bitwiseAND(bit) != 0
    clear = lambda m: m.bitwiseAND(before) == 0
    one = lambda condition: condition.cast("long")
    lost = lambda counts: _over(F.col(counts), lambda m: one(clear(m) & fails(m)), n)
    share = lambda m: F.element_at(F.array(*(F.lit(factorial(n) // max(c, 1)).cast("long") for c in range(n + 1))), F.bit_count(m) + 1)
    return rows.select(
        "part",
        "filter_order",
        "step",
        _over(F.col("every"), lambda m: one(clear(m) & ~fails(m)), n).alias("kept"),
        lost("every").alias("removed"),
        _over(F.col("every"), lambda m: one(~clear(m) & fails(m)), n).alias("redundant"),
        F.element_at("every", bit + 1).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        _over(F.col("every"), lambda m: one(fails(m)) * share(m), n).alias("shapley"),
    )


def labelled(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``masks`` with booleans ``good`` and ``toxic``."""
    says = lambda name: F.coalesce(F.max(quoted(name) == 1), F.lit(False))
    known = labels.where(quoted(doc_id).isNotNull()).groupBy(quoted(doc_id).alias("doc_id")).agg(says(quality).alias("good"), says(toxic).alias("toxic"))
    return masks.join(known, "doc_id", "left").select("part", "mask", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")))


#: Counts of masks by part, and every order and step over them; Shapley values by adding up all orders.
SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
flags AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM worded),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS f,
  count(*) AS n, count(*) FILTER (coalesce(s.good, false)) AS good, count(*) FILTER (coalesce(s.toxic, false)) AS toxic
  FROM flags LEFT JOIN said s USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT concat(p.l, q.l, r.l, s.l, t.l) AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps AS (SELECT o, CAST(k AS INTEGER) AS k, substr(o, CAST(k AS INTEGER), 1) AS l, substr(o, 1, CAST(k AS INTEGER) - 1) AS before FROM orders, range(1, 6) g(k)),
met AS (SELECT part, o, k, l, n, good, toxic, f, contains(f, l) AS fails, before <> '' AND regexp_matches(f, '[' || before || '_]') AS gone FROM failed, steps),
counted AS (SELECT part, o, k, l, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant,
  sum(n) FILTER (f = l) AS unique_fails, sum(good) FILTER (NOT gone AND fails) AS good_lost, sum(toxic) FILTER (NOT gone AND fails) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, o AS filter_order, k AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, l), 0) AS BIGINT) AS shapley FROM counted
"""
