"""License scan, byte-level BPE, quality rules and sharding against plain Python."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recollect.llm import bpe, licenses, quality, sharding

LICENSES = [(1, "Licensed under the Apache License, Version 2.0 (the License)."), (2, "apache license apache license; CC-BY cc by"), (3, "This tool is released under the MIT license."), (4, "the gnu general public licenses"), (5, None), (6, ""), (None, "MIT License")]


@pytest.fixture(scope="module")
def every(spark, rows):
    return [*rows, *((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]


@pytest.fixture(scope="module")
def table(spark, every):
    return spark.createDataFrame([(*r, 0) for r in every], "doc_id long, text string, n_words int").repartition(4).cache()


def by_id(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=repr)


def test_license_phrases(spark, every):
    every = every + LICENSES
    out = licenses.scan(spark.createDataFrame(every, "doc_id long, text string")).collect()
    wanted = []
    for i, t in every:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        wanted.append((i, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert by_id([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out]) == by_id(wanted)
    for r in out:
        assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in out}
    assert labels[None] == "mit" or labels[None] == ""
    assert {r["labels"] for r in out if r["doc_id"] == 1 and r["n_words"] == 10} >= {"apache,apache-2.0"}


def test_whole_licenses_and_what_only_looks_like_one(spark):
    plain = lambda markup: re.sub(r"<[^:<>]*:\d+>", "Some Body", markup).replace("[", "").replace("]", "")
    two, three = (plain(m) for n, _, m in licenses.TEMPLATES if n in ("bsd-2-clause", "bsd-3-clause") and len(m) > 500)
    mit = next(plain(m) for n, _, m in licenses.TEMPLATES if n == "mit")
    texts = [mit, mit.replace("sublicense", "rent"), two, three, three.replace("endorse", "praise"), f"before {mit.upper()} after", "word " * 300_000 + two]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0] == out[5] == ("mit,mit-opening", 1.0) and out[1] == ("mit-opening", 0.5)
    assert out[2] == out[6] == ("bsd-2-clause,bsd-opening", 1.0) and out[3] == ("bsd-3-clause,bsd-opening", 1.0) and out[4] == ("bsd-opening", 0.5)


def test_published_mark_up_and_templates_without_words():
    a = licenses.Automaton('<<beginOptional>>Copyright<<endOptional>> by <<var;name="c";original="x";match=".{0,20}">> end')
    assert a.accepts(b"copyright by a b c d end".split(), 0) == 7 and a.accepts(b"by a b c d e end".split(), 0) is None
    assert licenses.Scanner(templates=(("none", 1.0, "[maybe] <any:3>"),)).scan(b"maybe not")[5:] == ("", 0.0)


def test_automaton_takes_optional_and_replaceable_parts():
    a = licenses.Automaton("one [two [three]] <:2> four")
    assert a.accepts(b"one four".split(), 0) == 2
    assert a.accepts(b"one two three x y four".split(), 0) == 6
    assert a.accepts(b"one x y z four".split(), 0) is None
    assert a.accepts(b"one three".split(), 0) is None


def test_tokens_are_those_of_the_library(table, every):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, t in every:
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        wanted.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_id([tuple(r) for r in bpe.report(bpe.round_trip(table, ranks, public_tokenizers.PATTERN)).collect()]) == by_id(wanted)


def test_vocabularies_of_one_length_do_not_share_a_codec(spark):
    letters = {bytes([b]): b for b in range(256)}
    one, other = letters | {b"zv": 256}, letters | {b"zw": 256}
    df = spark.createDataFrame([(1, "zw zv")], "doc_id long, text string").coalesce(1)
    count = lambda ranks: bpe.report(bpe.round_trip(df, ranks, public_tokenizers.PATTERN)).first()["n_tokens"]
    ids = lambda ranks: bpe.round_trip(df, ranks, public_tokenizers.PATTERN).first()["ids"]
    assert count(one) == count(other) == 4
    assert list(np.frombuffer(ids(one), "<u4")) == [122, 119, 32, 256] and list(np.frombuffer(ids(other), "<u4")) == [256, 32, 122, 118]


def test_halves_join_to_the_encoding_of_the_whole():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for piece in ("a" * 999, "abab" * 300, "漢字" * 200, "!?" * 500 + "x" * 70, "zq" * 4000, "don't" + "'ll" * 300, " " * 5000 + "end", "\n \n" * 2000):
        assert list(np.frombuffer(encoder.encode(piece), "<u4")) == library.encode_ordinary(piece)


def test_quality_counts(spark, table, every):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = quality.report(quality.judge(table, labels)).collect()
    wanted = []
    for i, t in every:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        again = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        wanted.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)))
    assert by_id([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out]) == by_id(wanted)
    assert not any(r["kept"] and r["base_failed"] for r in out)
    assert any(r["kept"] for r in out)
    bare = quality.report(quality.judge(table, labels.limit(0))).collect()
    assert all(r["kept"] != r["base_failed"] for r in bare)


def test_verdict_is_that_of_plain_walks_and_counts(spark):
    """Path lengths walked node by node, and the cut-off from sorted steps of all labelled rows."""
    import random

    from .conftest import prose

    rng = random.Random(31)
    texts = [prose(rng, rng.choice((60, 150)), 900) if k % 4 else " ".join(f"#{rng.randrange(10**9)}$" for _ in range(80)) for k in range(240)] + ["short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 240, 2)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.judge(df, labels, sample=50).collect()}

    stats = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    order = [r["doc_id"] for r in labels.where("quality > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(50).collect()]
    features = lambda ids: quality.features({c: np.array([stats[i][c] for i in ids]) for c in quality.COUNTS})
    forest = quality.Forest(features(order))
    norm = 2 * (np.log(forest.rows - 1) + 0.5772156649) - 2 * (forest.rows - 1) / forest.rows

    def anomaly(x: np.ndarray) -> float:
        total = 0.0
        for feature, value, left, length in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] + int(x[feature[at]] > value[at])
            total += length[at]
        return 2 ** (-total / len(forest.trees) / norm)

    step = {i: int(anomaly(features([i])[0]) * quality.BINS) for i in stats}
    assert all(abs(out[i]["anomaly"] * quality.BINS - step[i]) <= 1.001 for i in stats)
    known = [i for i in range(0, 240, 2) if not out[i]["base_failed"]]
    good, bad = [i for i in known if i % 4], [i for i in known if not i % 4]
    best = max((s for s in {step[i] for i in known} if sum(step[i] <= s for i in good) >= quality.KEEP_GOOD * len(good)), key=lambda s: (sum(step[i] <= s for i in good) / len(good) - sum(step[i] <= s for i in bad) / len(bad), -s))
    assert all(out[i]["kept"] == (not out[i]["base_failed"] and step[i] <= best) for i in stats)
    assert sum(out[i]["kept"] for i in bad) <= 0.1 * len(bad)


def test_isolation_forest_finds_what_stands_apart():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 4)), rng.normal(8, 1, size=(5, 4))])
    score = quality.Forest(x).score(x)
    assert set(np.argsort(score)[-5:]) == set(range(500, 505))


def test_shards(table, every):
    out = sharding.report(sharding.reshard(table)).collect()
    assert by_id([(r["doc_id"], r["size"], r["text_crc32"]) for r in out]) == by_id([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in every])
    slots, size = collections.defaultdict(list), collections.Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in out) * 0.1


def test_equal_texts_share_a_shard_unless_they_are_many(spark):
    rows = [(k, f"text {k % 500} " * (1 + k % 500 % 7)) for k in range(3000)] + [(5000 + k, "copy of a third of all rows") for k in range(1500)] + [(9000 + k, None) for k in range(300)] + [(1, "text 1 text 1 ")] * 5
    out = sharding.report(sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), share=1 / 200)).collect()
    size, homes = collections.Counter(), collections.defaultdict(set)
    texts = dict(rows)
    for r in out:
        size[r["shard"]] += r["size"]
        homes[texts[r["doc_id"]]].add(r["shard"])
    total = sum(size.values())
    largest = max(n * (len(t or "") + 1) for t, n in collections.Counter(t for _, t in rows).items() if n < 20)
    assert len(out) == len(rows) and max(abs(x - total / 8) for x in size.values()) <= 2 * max(largest, total / 200)
    assert len(homes["copy of a third of all rows"]) == 8
    kept = [len(h) == 1 for t, h in homes.items() if t and t.startswith("text")]
    assert sum(kept) >= 0.2 * len(kept)


def test_flow_moves_the_fewest_bytes():
    sizes, capacities = [70, 10, 20, 0], [25, 25, 25, 25]
    moved = sharding.transfers(sizes, capacities)
    assert sum(n for (a, b), n in moved.items() if a != b) == sum(max(0, s - c) for s, c in zip(sizes, capacities, strict=True))
    for j, c in enumerate(capacities):
        assert sum(n for (_, b), n in moved.items() if b == j) == c


def test_rewritten_files_hold_the_affected_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * (1 + k % 50)) for k in range(400)], "doc_id long, text string")

    planned = sharding.reshard(df, 4, old_shard=F.col("doc_id") % 2).cache()
    affected = sharding.rewrite(df, planned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert affected == [0, 1, 2, 3] and back.count() == 400 and back.select("doc_id").distinct().count() == 400


def test_shards_without_changes_stay(spark, tmp_path):
    """Two of four shards change, one of them ends empty; a live folder, rows with columns of the written names."""
    target = str(tmp_path / "live")
    df = spark.createDataFrame([(k, prose_of(k), k % 4, -k, "m") for k in range(400)], "doc_id long, text string, shard int, slot long, x string")
    df.write.partitionBy("shard").parquet(target)
    before = {k: sorted(p.name for p in (tmp_path / "live" / f"shard={k}").iterdir()) for k in range(4)}
    planned = df.select("doc_id", F.col("shard").alias("old_shard"), F.when(F.col("shard") == 1, 0).otherwise(F.col("shard")).alias("shard"), F.col("doc_id").alias("slot"))
    assert sharding.rewrite(spark.read.parquet(target), planned, target) == [0, 1]
    back = spark.read.parquet(target)
    assert sorted((r["doc_id"], r["shard"], r["text"], r["x"]) for r in back.collect()) == sorted((k, 0 if k % 4 == 1 else k % 4, prose_of(k), "m") for k in range(400))
    assert all(sorted(p.name for p in (tmp_path / "live" / f"shard={k}").iterdir()) == before[k] for k in (2, 3))
    assert not (tmp_path / "live" / "shard=1").exists()


def prose_of(k: int) -> str:
    return f"text {k} " * (k % 7 + 1)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for out in (licenses.scan(none), bpe.report(bpe.round_trip(none, ranks, public_tokenizers.PATTERN)), quality.report(quality.judge(none, labels)), sharding.report(sharding.reshard(none))):
        assert out.count() == 0
