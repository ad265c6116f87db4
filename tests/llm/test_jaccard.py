"""The n-gram Jaccard join against all pairs by brute force."""

from __future__ import annotations

import re

import public_tokenizers

from recollect.llm import bpe, jaccard, toxicity


def shingles(text: str | None) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows) -> list[tuple]:
    known = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in known}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in known:
        for j, b in known:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in known), key=repr)


def unique_ids(rows):
    """A repeated id stands for several texts; the join links texts, so brute force is asked for single ids."""
    return [(i, t) for i, t in rows if (i, t) != (7, "a repeated id")]


def test_links_are_those_of_all_pairs(spark, docs, rows):
    found = sorted((tuple(r) for r in jaccard.link(docs.where("text <> 'a repeated id' or text is null")).collect()), key=repr)
    assert found == expected(unique_ids(rows))


def test_crowds_of_near_copies_and_of_a_common_passage(spark, rows):
    import random

    from .conftest import changed, prose

    rng = random.Random(11)
    base, common = prose(rng, 70), prose(rng, 50)
    many = [(k, changed(rng, base, rng.choice((0.0, 0.02, 0.05)))) for k in range(250)]
    many += [(1000 + k, f"{prose(rng, rng.choice((4, 8, 14, 30)))} {common}") for k in range(250)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(6)
    found = sorted((tuple(r) for r in jaccard.link(df).collect()), key=repr)
    assert found == expected(many)


def test_repeated_id_and_other_columns(docs):
    out = jaccard.link(docs)
    assert out.count() == docs.count()
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(none):
    assert jaccard.link(none).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard.link(none).count() == 0


def test_names_of_columns_do_not_matter(spark):
    """Columns by the names that the operators use, and dotted ones."""
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words, 7, "x"), (2, words, 8, "y"), (3, "other words", 9, "z"), (None, words, 1, "n")]
    df = spark.createDataFrame(rows, "`a.id` long, `a.text` string, linked0 long, `the linked one` string")
    out = jaccard.representatives(df, "a.id", "a.text")
    assert out.columns == df.columns and sorted(r[3] for r in out.collect()) == ["n", "x", "z"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert bpe.report(bpe.round_trip(df, ranks, public_tokenizers.PATTERN, "a.id", "a.text")).count() == 4
    labels = spark.createDataFrame([(1, 1), (3, 0)], "`a.id` long, toxic int")
    assert toxicity.judge(df, labels, "a.id", "a.text").count() == 4
