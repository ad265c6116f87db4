"""The audit of filters against counting every order by itself."""

from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import functions as F

from recollect.llm import filters


def _plain(rows: list[tuple]) -> dict:
    """(part, order, step) -> counts, from rows (part, failed letters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                removed_in_all[f] += len(gone)
                out[part, "".join(order), k] = [len(stay), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = stay
        for order in permutations("ABCDE"):
            for k, f in enumerate(order, 1):
                out[part, "".join(order), k].append(removed_in_all[f])
    return {k: tuple(v) for k, v in out.items()}


def _audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_audit_is_that_of_all_orders(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), {f for f in "ABCDE" if rng.random() < 0.3}, rng.random() < 0.5, rng.random() < 0.2) for _ in range(400)] + [("only", set(), True, False)]
    masks = spark.createDataFrame([(p, sum(1 << "ABCDE".index(f) for f in fs), g, t) for p, fs, g, t in rows], "part string, mask int, good boolean, toxic boolean")
    assert _audited(filters.audit(masks)) == _plain(rows)
    assert filters.audit(masks.limit(0)).count() == 0


def test_sums_add_up_and_invert(spark):
    rng = random.Random(2)
    masks = spark.createDataFrame([("p", rng.randrange(32), True) for _ in range(300)], "part string, mask int, good boolean")
    rows = filters.sums(masks, ["good"]).select("label", "parity", filters.cells(F.col("parity")).alias("cells")).collect()
    plain = [0] * 32
    for r in masks.collect():
        plain[r["mask"]] += 1
    assert {r["label"] for r in rows} == {"", "good"} and all(r["cells"] == plain and r["parity"][0] == 300 for r in rows)


def test_failures(spark):
    """Each filter at its limit, copies by the smaller id, odd rows, and names that clash."""
    words = " ".join(f"w{k}" for k in range(200))
    cases = [
        (1, words, "s", 0),
        (2, words, "s", 16),
        (3, " ".join(f"w{k}" for k in range(199)), "s", 1),
        (4, " ".join(f"w{k % 100}" for k in range(200)), "s", 0),
        (5, " ".join(f"w{k % 99}" for k in range(200)), "s", 2),
        (6, words + " A" * (len(words) // 48), "t", 0),
        (7, words + " A" * (len(words) // 46), "t", 4),
        (8, words + " &", None, 8),
        (9, words.replace(" ", "  "), "s", 0),
        (10, None, "s", 1),
        (11, "", "s", 17),
        (12, "ABC", None, 5),
        (None, words, "s", 0),
        (None, "x", "s", 1),
        (1, words, "t", 0),
        (13, words * 300, "s", 2),
    ]
    df = spark.createDataFrame([(i, t, s, "m", 1, 2) for i, t, s, _ in cases], "doc_id long, text string, source string, mask string, words int, `t.x` int").repartition(3)
    got = sorted(tuple(r) for r in filters.failures(df).select(F.coalesce("doc_id", F.lit(-1)), "part", "mask").collect())
    assert got == sorted((-1 if i is None else i, s or "", m) for i, _, s, m in cases)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = sorted(tuple(r) for r in filters.labelled(filters.failures(df).where("doc_id <= 2"), labels).select("part", "mask", "good", "toxic").collect())
    assert out == [("s", 0, True, True), ("s", 16, False, False), ("t", 0, True, True)]
    assert filters.audit(filters.labelled(filters.failures(df.limit(0)), labels)).count() == 0
