"""Toxicity on held-out rows, benchmark items against brute force, repeated passages, and the pipeline's stages."""

from __future__ import annotations

import math
import random
import re
import zlib

import pytest

from recollect.llm import bpe, decontaminate, jaccard, passages, secrets, toxicity

from .conftest import changed, prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    bad = [f"foul{k}" for k in range(12)]
    rows = []
    for k in range(1200):
        toxic = k % 5 == 0
        words = prose(rng, 40).split(" ")
        if toxic:
            for at in rng.sample(range(len(words)), 5):
                words[at] = rng.choice(bad)
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"), {k: y for k, _, y in rows}


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    out = toxicity.judge(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_change_nothing(labelled):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.judge(docs, labels).collect())) == sorted(map(tuple, toxicity.judge(docs, other).collect()))


def test_toxicity_of_odd_rows(spark, docs, none, labelled):
    _, labels, _ = labelled
    assert toxicity.judge(docs, labels).count() == docs.count()
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.judge(none, labels).count() == toxicity.judge(docs, labels.limit(0)).where("predicted = 1").count() == 0


ITEMS = [(1, "What is the capital of the western province in the old atlas of rivers and hills? The capital is the town by the long grey bridge."), (2, "Name three metals that float on cold water when they are cut thin. Lithium sodium and potassium float on cold water."), (3, None), (4, ""), (2, "Name three metals that float on cold water when they are cut thin. Lithium sodium and potassium float on cold water.")]


def test_benchmark_items_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.choice((5, 80, 700)))) for k in range(120)]
    planted = {}
    for k in range(0, 120, 4):
        item = ITEMS[k // 4 % 2]
        words = prose(rng, 300).split(" ")
        rows[k] = (k, " ".join([*words[: k * 2], item[1].upper() if k % 8 else item[1], *words[k * 2 :]]))
        planted[k] = item[0]
    rows += [(500, None), (501, ""), (None, ITEMS[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.find(docs, items).collect()
    assert {r["doc_id"]: r["item_id"] for r in out} == planted | {None: 1} and len(out) == len(planted) + 1
    left = decontaminate.clean(docs, items)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in rows if i is not None and i not in planted)
    assert decontaminate.find(docs, items.limit(0)).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(rows)


def test_items_with_one_changed_word_or_cut_at_the_end_are_found(spark):
    rng = random.Random(13)
    items = [(k, t) for k, t in dict(ITEMS).items() if t] + [(9, f"{ITEMS[0][1]} Er.")]
    rows = []
    for i, t in items:
        words = t.split(" ")
        copies = [[*words[:k], *new, *words[k + 1 :]] for k in range(len(words)) for new in ((), ("other",))]
        ends = [k + 1 for k, w in enumerate(words[:-1]) if w[-1] in ".?" and k + 1 > len(words) / 2]
        rows += [(i, " ".join([prose(rng, 100), *c, prose(rng, 100)])) for c in copies + [words[:k] for k in ends]]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, table).collect()}
    assert {(k, i) for k, (i, _) in enumerate(rows)} <= found
    assert decontaminate.clean(docs, table).count() == 0


def test_retrieval_finds_all_that_scoring_everything_finds():
    """Block-max bounds against sums over all postings of each passage."""
    import numpy as np

    from recollect.llm import textvec as tv

    rng = random.Random(9)
    items = [prose(rng, 30, 900) for _ in range(60)]
    terms = [set(decontaminate._words([t]).hash.tolist()) for t in items]
    often = {t: sum(t in own for own in terms) for t in set().union(*terms)}
    index = decontaminate.Index(list(range(60)), items, 64, often, 60, 30.0)
    texts = [" ".join([prose(rng, 90, 900), items[k % 60][: 20 + k * 3], prose(rng, 50, 900)]) for k in range(80)]
    words = decontaminate._words(texts)
    doc, item, score = index.passages(words)
    found = {(d, i): s for d, i, s in zip(doc.tolist(), item.tolist(), score.tolist(), strict=True)}
    wanted: dict[tuple[int, int], float] = {}
    for d in range(len(texts)):
        own = words.hash[words.first[d] : words.first[d + 1]]
        for at in range(0, len(own), index.half):
            terms = np.unique(own[at : at + 2 * index.half])
            rows = np.flatnonzero(np.isin(index.terms, terms))
            for i in range(60):
                total = sum(float(index.weight[s:e][index.item[s:e] == i].sum()) for s, e in zip(index.start[rows], index.start[rows + 1], strict=True))
                if total >= 1 - 1e-9:
                    wanted[d, i] = max(total, wanted.get((d, i), 0.0))
    assert found.keys() == wanted.keys() and wanted
    assert all(abs(found[k] - wanted[k]) < 1e-6 for k in wanted)
    assert tv.CHUNK_BYTES > 0


def test_scores_do_not_depend_on_how_items_are_dealt(spark):
    rng = random.Random(21)
    items = [(k, prose(rng, rng.choice((20, 70, 300)), 700)) for k in range(90)]
    docs = spark.createDataFrame([(k, f"{prose(rng, 100, 700)} {items[k][1]} {prose(rng, 50, 700)}") for k in range(90)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole, dealt = (sorted(map(tuple, decontaminate.find(docs, table, most=most).collect())) for most in (1 << 20, 4000))
    assert whole == dealt and {(k, k) for k in range(90)} <= {r[:2] for r in whole}
    assert len(list(decontaminate.indexes(table, most=4000))) > 3
    assert decontaminate.clean(docs, table, most=4000).count() == 0


def scalar_ftrl(rows: list[tuple[list[int], float]], l1: float) -> dict[int, float]:
    """Weights by the update rules, one coordinate after the other; the bias (the last number) isn't regularised by L1."""
    bias, z, n = 1 << toxicity.BITS, {}, {}

    def weight(i: int) -> float:
        own = z.get(i, 0.0)
        least = 0.0 if i == bias else l1
        return 0.0 if abs(own) <= least else -(own - least * (1 if own > 0 else -1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in [*x, bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, own in w.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / toxicity.ALPHA * own
    return {i: weight(i) for i in z if weight(i)}


def test_weights_are_those_of_the_scalar_rules():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    rng = random.Random(17)
    texts = [prose(rng, 30, 60) + (" foul0 foul1" if k % 4 == 0 else "") for k in range(200)]
    part = pd.DataFrame({"at": range(200), "doc_id": range(200), "text": texts, "label": [float(k % 4 == 0) for k in range(200)]})
    learned = toxicity._learner(part)
    rows = [x.tolist() for x in toxicity._each(pa.array(texts))]
    often: dict[int, int] = {}
    for x in rows:
        for i in x:
            often[i] = often.get(i, 0) + 1
    least = np.clip(50 / toxicity.PER_LEAST, *toxicity.LEAST_BOUNDS)
    wanted = scalar_ftrl([([i for i in x if often[i] >= least], y) for x, y in zip(rows, part["label"], strict=True)], float(np.clip(50 / toxicity.PER_L1, *toxicity.L1_BOUNDS)))
    found = dict(zip(learned["bucket"].tolist(), learned["weight"].tolist(), strict=True))
    assert found.keys() == wanted.keys() and all(abs(found[i] - wanted[i]) < 1e-9 for i in wanted)
    dense = np.zeros((1 << toxicity.BITS) + 1)
    dense[list(found)] = list(found.values())
    for score, x in zip(toxicity.scores(pa.array(texts), dense).tolist(), rows, strict=True):
        assert abs(score - 1 / (1 + math.exp(-sum(wanted.get(i, 0.0) for i in [*x, 1 << toxicity.BITS])))) < 1e-9


def test_repeated_passages_are_found_and_other_texts_left(spark):
    rng = random.Random(6)
    shared = [prose(rng, 70, 5000) for _ in range(3)]
    rows = [(k, prose(rng, 150, 5000)) for k in range(60)]
    for k in range(60, 120):
        passage = shared[k % 3] if k % 2 else changed(rng, shared[k % 3], 0.01)
        rows.append((k, f"{prose(rng, rng.choice((10, 90)), 5000)} {passage} {prose(rng, 40, 5000)}"))
    rows += [(200, "same text " * 30), (201, "same text " * 30), (300, None), (301, ""), (None, shared[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = passages.find(docs).collect()
    touched = {r["doc_id"] for r in out}
    assert touched == {*range(60, 120), 200, 201}
    for p in range(3):
        members = [r for r in out if r["doc_id"] in range(60 + p, 120, 3)]
        assert {r["component_id"] for r in members} == {60 + p} and sum(r["keep"] for r in members) == 1
    spans = {}
    for r in sorted(out, key=lambda r: r["start_word"]):
        spans.setdefault((r["doc_id"], r["component_id"]), []).append((r["start_word"], r["end_word"]))
    for own in spans.values():  # spans of one passage in one document don't overlap
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))
    for i, t in rows[61:120:2]:
        passage, words = shared[i % 3].lower().split(" "), t.lower().split(" ")
        at = next(k for k in range(len(words)) if words[k : k + 70] == passage)
        covered = {k for (d, _), own in spans.items() if d == i for s, e in own for k in range(s, e)}
        assert len(covered & set(range(at, at + 70))) >= 40


def test_shared_words_without_sentences_are_found_whole(spark):
    rng = random.Random(12)

    def plain(n: int) -> list[str]:
        return [f"w{rng.randrange(50_000)}" for _ in range(n)]

    rows, wanted = [], {}
    for k in range(150):
        passage = plain(40 + k % 30)
        for d in (2 * k, 2 * k + 1):
            before = plain(rng.randrange(1, 90))
            rows.append((d, " ".join([*before, f"left{d}", *passage, f"right{d}", *plain(rng.randrange(1, 90))])))
            wanted[d] = (len(before) + 1, len(before) + 1 + len(passage))
    out = passages.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(wanted)
    for r in out:  # a similar paragraph may have two other words at an edge
        start, end = wanted[r["doc_id"]]
        assert start - 2 <= r["start_word"] <= start and end <= r["end_word"] <= end + 2


def paragraphs(text: str) -> list[tuple[int, frozenset]]:
    """First word and shingles of each paragraph of a text."""
    import numpy as np

    from recollect.llm import textvec as tv

    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = tv.Words(data, np.array([0, len(data)]))
    shingle = passages.shingles(words)
    return [(int(p), frozenset(shingle[p : p + passages.SHINGLES].tolist())) for p in passages.anchors(words, shingle)]


def test_recall_against_all_pairs_of_paragraphs(spark):
    """Of all similar pairs of paragraphs in different texts, the share that runs cover on both sides."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null")
    rng = random.Random(23)
    line = prose(rng, 12, 5000)
    odd = [(10_000 + k, f"{prose(rng, 30, 5000)} {line} {prose(rng, 30, 5000)}") for k in range(40)]
    edge = prose(rng, 24, 5000).split(" ")
    odd += [(20_000 + k, " ".join([prose(rng, 9, 5000) + ".", *([f"x{k}"] if k % 2 else edge[:1]), *edge[1:-1], f"y{k // 2}", prose(rng, 9, 5000)])) for k in range(24)]
    rows = [tuple(r) for r in docs.collect()] + odd
    once = {}
    for i, t in rows:
        once.setdefault(" ".join(t.split()), i)
    known = [(i, p, s) for t, i in once.items() for p, s in paragraphs(t)]
    by_shingle: dict[int, list[int]] = {}
    for k, (_, _, s) in enumerate(known):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    similar = set()
    for k, (i, _, s) in enumerate(known):
        for m in {m for x in s for m in by_shingle[x] if m > k and known[m][0] != i}:
            if len(s & known[m][2]) >= passages.SIMILAR * len(s | known[m][2]):
                similar.add((k, m))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in passages.find(df).collect():
        out.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["component_id"]))
    own = lambda k: {c for s, e, c in out.get(known[k][0], []) if s <= known[k][1] and known[k][1] + passages.WINDOW <= e}
    met = sum(bool(own(k) & own(m)) for k, m in similar)
    assert len(similar) > 200 and met >= 0.97 * len(similar)


def test_crowded_keys_lose_no_similar_paragraph(spark):
    """The prefix filter alone against all pairs under one key."""
    import numpy as np

    from recollect.llm import textvec as tv

    rng = random.Random(29)
    core = prose(rng, 24, 5000).split(" ")
    texts = [" ".join([f"a{rng.randrange(4)}", *core[1:-1], f"b{rng.randrange(6)}"]) if k % 2 else f"{prose(rng, 8, 900)} {' '.join(core[:8])} {prose(rng, 8, 900)}" for k in range(60)]
    marks, sets = [], []
    for t in texts:
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        words = tv.Words(data, np.array([0, len(data)]))
        marks.append(int(passages.text_mark(words)[0]))
        sets.append(frozenset(passages.shingles(words)[: passages.SHINGLES].tolist()))
    df = spark.createDataFrame(list(zip(marks, texts, strict=True)), "mark long, text string").distinct()
    crowd = spark.createDataFrame([(1, m, 0) for m in set(marks)], "key long, mark long, place long")
    found = {frozenset((r["a"], r["b"])) for r in passages._crowded(df, crowd).collect()}
    wanted = {frozenset((marks[i], marks[j])) for i in range(60) for j in range(i) if marks[i] != marks[j] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert wanted and wanted <= found


def test_families_under_crowded_keys_are_connected(spark):
    """Representative pairs against all pairs under one key: only similar ones, and the same components; long ones too, with fewer pairs than all."""
    import numpy as np

    from recollect.llm import textvec as tv

    rng = random.Random(31)
    core, other, phrase = (prose(rng, n, 5000).split(" ") for n in (24, 24, 12))
    texts = [" ".join([f"a{rng.randrange(40)}", *core[1:-1], f"b{k % 50}"]) for k in range(200)]
    texts += [" ".join([*other[2:], f"c{k}", f"d{k}"]) for k in range(30)] + [" ".join([f"e{k}", f"f{k}", *other[:22]]) for k in range(30)]
    texts += [" ".join([*phrase, *phrase, *phrase][k : k + 24]) for k in range(12)]
    texts += [" ".join([*phrase[:9], *phrase[:9], *prose(rng, 6, 5000).split(" ")]) for _ in range(5)]
    # Two words come again and again, so what is common need not be a row of shingles.
    texts += [" ".join(["of the " + " of the ".join(core[:6]), f"h{k}", *core[6:11]][: 12] + [f"i{k % 3}", *core[12:16]]) for k in range(20)]
    # A paragraph twice in one text: each place has a partner in the other texts.
    words = [t.split(" ") for t in texts]
    words = [(w + ["z"] * 24)[:24] for w in words]
    places = [(k, 0) for k in range(len(words))]
    whole = {k: " ".join(w) for k, w in enumerate(words)}
    whole[0] = " ".join([*words[0], *words[1]])
    places.append((0, 24))
    marks, sets = {}, {}
    for k, t in whole.items():
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        cut = tv.Words(data, np.array([0, len(data)]))
        marks[k] = int(passages.text_mark(cut)[0])
        for p in (p for i, p in places if i == k):
            sets[marks[k], p] = frozenset(passages.shingles(cut)[p : p + passages.SHINGLES].tolist())
    df = spark.createDataFrame([(marks[k], t) for k, t in whole.items()], "mark long, text string").distinct()
    crowd = spark.createDataFrame([(1, m, p) for m, p in sets], "key long, mark long, place long")
    found = set()
    for r in passages._families(df, crowd).collect():
        both = np.frombuffer(r["payload"], "<u4").reshape(-1, 2).tolist()
        found |= {((r["a"], p), (r["b"], q)) for p, q in both}
    near = lambda x, y: len(sets[x] & sets[y]) >= 0.75 * len(sets[x] | sets[y])
    ids = sorted(sets)
    wanted = {(x, y) for x in ids for y in ids if x[0] > y[0] and near(x, y)}
    linked = found & wanted

    def parts(pairs: set) -> set:
        up = {x: x for x in ids}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in pairs:
            up[top(x)] = top(y)
        return {frozenset(y for y in ids if top(y) == top(x)) for x in ids}

    assert parts(linked) == parts(wanted) and {x for pair in linked for x in pair} == {x for pair in wanted for x in pair}
    assert len(found) * 10 < len(wanted)


def test_keys_that_meet_against_all_entries():
    """Each entry with the first of its content or with the last, and the contents of a key: with odd marks, repeated entries and crowds."""
    import numpy as np

    rng = random.Random(37)
    entries = [(rng.choice((-9, -1, 4, 7, 2**62)), rng.randrange(70_000), rng.randrange(40), rng.randrange(3)) for _ in range(300)]
    entries += [(rng.randrange(-50, 50), k, 99, 1000 + k % 30) for k in range(90)] + entries[:20]
    entries += [(k, k, 1 << 30 | k, 5) for k in range(200)]
    columns = [np.array(c) for c in zip(*entries, strict=True)]
    whole = (columns[0], columns[1].astype("<u4"), columns[2].astype(np.uint64), columns[3].astype(np.uint32))
    found, crowded = set(), set()
    for r in (r for batch in passages._collide([tuple(c[:150] for c in whole), tuple(c[150:] for c in whole)], 3) for r in batch.to_pylist()):
        if r["kind"] == 2:
            crowded.add((r["a"], r["n"], r["b"] & 0xFFFFFFFF))
        else:
            both = np.frombuffer(r["payload"], "<u4").reshape(-1, 2).tolist()
            found |= {((r["a"], p), (r["b"], q)) for p, q in both}
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for m, p, key, content in entries:
        groups.setdefault((key, content), []).append((m, p))
    wanted = {(x, max(own) if x[0] == min(own)[0] else min(own)) for own in groups.values() for x in own}
    heads: dict[int, list[tuple[int, int]]] = {}
    for (key, _), own in groups.items():
        heads.setdefault(key, []).append(min(own))
    wanted |= {(x, y) for own in heads.values() if len(own) <= passages.CROWD for x in own for y in own}
    assert found == {(max(x, y), min(x, y)) for x, y in wanted if x[0] != y[0]}
    assert crowded == {(*x, key) for key, own in heads.items() if len(own) > passages.CROWD for x in own}


def test_pairs_are_verified_together_and_a_text_is_cut_once(monkeypatch):
    """Runs of many pairs against each pair by itself, however batches fall; a text with many partners is cut into words once."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(41)
    shared = [prose(rng, 60, 5000).split(" ") for _ in range(4)]

    def text() -> str:
        w = prose(rng, rng.randrange(3), 5000).split(" ")
        for s in rng.sample(shared, 2):
            w += prose(rng, rng.randrange(1, 30), 5000).split(" ") + [x if rng.random() > 0.03 else "odd" for x in s]
        return " ".join(w + prose(rng, rng.randrange(3), 5000).split(" "))

    known = {}
    for t in [text() for _ in range(40)]:
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        words = passages.tv.Words(data, np.array([0, len(data)]))
        known[int(passages.text_mark(words)[0])] = (t, words.hash & np.uint64(0xFFFFFFFF), passages.anchors(words, passages.shingles(words)).tolist())
    pack = lambda both: np.array(both, dtype="<u4").tobytes()
    marks, rows, wanted = sorted(known), [], set()
    for b in marks[:20]:
        asked = {a: [(p, q) for p in known[a][2] for q in known[b][2] if rng.random() < 0.7] for a in rng.sample(marks[20:], 12)}
        asked = {a: both + both[:3] for a, both in asked.items() if both}
        rows.append((b, 0, 0, b, pack([x for both in asked.values() for x in both]), known[b][0]))
        rows += [(b, 0, 1, a, pack(both), known[a][0]) for a, both in asked.items()]
        for a, both in asked.items():
            good = []
            for p, q in sorted(set(both)):
                x, y = ({tuple(known[m][1][at + k : at + k + passages.WORDS].tolist()) for k in range(passages.SHINGLES)} for m, at in ((a, p), (b, q)))
                if len(x & y) >= passages.SIMILAR * len(x | y):
                    before = next(k for k in range(17) if k == passages.SPAN or min(p, q) - k < 1 or known[a][1][p - k - 1] != known[b][1][q - k - 1])
                    end = [(known[m][1], at + passages.WINDOW) for m, at in ((a, p), (b, q))]
                    behind = next(k for k in range(17) if k == passages.SPAN or any(e + k >= len(h) for h, e in end) or end[0][0][end[0][1] + k] != end[1][0][end[1][1] + k])
                    good.append((p, q, before, behind))
            if good:
                good = np.array(good)
                wanted |= {(a, s, e, b, f, t) for s, e, f, t in passages._run_together(good[:, :2], good[:, 2], good[:, 3])}
    names = ["b", "part", "role", "mark", "payload", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]

    def batches(rows: list, names: list, kinds: list, most: int) -> list:
        return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + most], strict=True), kinds, strict=True)], names) for i in range(0, len(rows), most)]

    cut = []
    real = passages.tv.Words
    monkeypatch.setattr(passages.tv, "Words", lambda data, start: cut.append(len(start) - 1) or real(data, start))
    by_text = sorted([*rows, (1, 0, 0, marks[0], rows[0][4], "another text under its mark")], key=lambda r: (r[3], r[5]))
    pieces = [r for x in passages.cut_out(iter(batches(by_text, names, kinds, 1000))) for r in x.to_pylist()]
    assert sum(cut) == len({r[3] for r in rows}) + 1 and len(pieces) == len(rows)
    pieces = sorted((tuple(r.values()) for r in pieces), key=lambda r: r[:3])
    assert len(wanted) > 100
    for most, together in ((1000, 1 << 13), (7, 1 << 13), (1000, 50), (3, 1)):
        monkeypatch.setattr(passages, "COMPARED", together)
        dealt = batches(pieces, ["b", "part", "role", "mark", "places", "cuts"], [*kinds[:5], pa.binary()], most)
        dealt.insert(1, dealt[0].slice(0, 0))
        found = [tuple(r.values()) for x in passages.compare(iter(dealt)) for r in x.to_pylist()]
        assert len(found) == len(set(found)) and set(found) == wanted


def test_repetitive_texts_keep_their_runs_whole():
    import numpy as np

    both = np.array([(p, q) for p in range(0, 400, 8) for q in range(p % 16, 400, 16)])
    none = np.zeros(len(both), dtype=np.int64)
    runs = list(passages._run_together(both, none, none))
    assert any(e - s >= 390 and t - f >= 390 for s, e, f, t in runs)


def test_paragraph_banding_reaches_its_recall():
    bands, rows = passages.tune()
    assert 1 - (1 - passages.SIMILAR**rows) ** bands >= passages.RECALL


def test_pipeline_stages(spark, tmp_path):
    """All stages over a small corpus against what each must do by itself."""
    import hashlib

    import public_tokenizers

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    rows = []
    for k in range(300):
        words = prose(rng, 60, 2000).split(" ")
        if k % 6 == 0:
            words[::9] = [f"foul{rng.randrange(6)}" for _ in words[::9]]
        rows.append((k, " ".join(words)))
    rows[11] = (11, rows[7][1])
    rows[13] = (13, changed(rng, rows[7][1], 0.01))
    rows[17] = (17, f"{rows[17][1]} {ITEMS[0][1]}")
    rows[19] = (19, f"{rows[19][1]} password = hunter2hunter2")
    rows += [(900, None), (901, "")]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {i: t for i, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns, name
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        gone = set(seen) - set(left)
        if name == "toxicity":
            assert len(gone ^ set(range(0, 300, 6))) <= 6
        elif name == "n-gram Jaccard join":
            assert gone == {11, 13}
        elif name == "benchmark decontamination":
            assert gone == {17}
        else:
            assert not gone and left[19] == re.sub(r"password = \w+$", "[secret]", seen[19])
        seen = left
    out = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, path).collect()}
    assert out == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in seen.items()}


def test_pipeline_stands_odd_tables(spark, tmp_path):
    """An empty table, repeated rows, nulls in every column, a text of 5 MB; decisions are defined for all of them."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(18)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{rng.randrange(90_000)}" for _ in range(800_000))
    rows = [(k, prose(rng, 60, 2000), "en", "web", 1) for k in range(30)]
    tables = {"none": [], "odd": [*rows, rows[3], rows[3], (40, None, None, None, None), (None, "no id", None, None, None), (None, None, None, None, None), (41, "", "en", "", 0), (42, long, "en", "web", len(long))]}
    for name, own in tables.items():
        path = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(30)] if own else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame(ITEMS if own else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        ids = sorted((r["doc_id"] for r in out), key=str)
        assert ids == sorted((r[0] for r in own), key=str)
    assert max(r["n_tokens"] for r in out) > 800_000


def test_empty_tables(spark, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find(none, items).count() == decontaminate.clean(none, items).count() == passages.find(none).count() == 0
    assert jaccard and secrets and bpe
