"""Searches that don't compare all pairs, against comparing all pairs in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recollect.functions import statistics as S
from recollect.model import MemoryBasedLearner
from recollect.operators import blocks, edit, lists, products, search, subsets, versions
from recollect.operators.search import Feature
from recollect.options import Options
from recollect.plans.views import PART
from recollect.storage import fresh
from recollect.streaming import classify

SF = "/root/testdata/sf0.01"


def _names(m: int) -> list[str]:
    return [f"f{i}" for i in range(1, m + 1)]


@pytest.fixture(scope="module")
def tables(spark):
    """By number of features: rows of training and queries, with missing and unknown values, repeated rows, a value that fills a third."""
    out = {}
    for m in (1, 3, 8):
        rng = random.Random(m)
        value = lambda: rng.choice(["hot"] * 5 + [None, "", "a", "b", "c", "d", "e", "f"])  # noqa: E731, B023
        rows = [(i, *(value() for _ in range(m)), rng.choice("XYZ")) for i in range(300)]
        rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:40])]
        asked = [(i, *(value() if rng.random() < 0.9 else "unknown" for _ in range(m)), rng.choice("XYZ")) for i in range(60)] + [(99, *["unknown"] * m, "X")]
        kind = lambda key: f"{key} long, " + ", ".join(f"{n} string" for n in _names(m)) + ", class string"  # noqa: E731, B023
        out[m] = rows, asked, spark.createDataFrame(rows, kind("iid")).repartition(3).cache(), spark.createDataFrame(asked, kind("qid")).repartition(3).cache()
    return out


def _plain(rows, asked, weights, k, without_self=False):
    """By query, the k + 1 nearest distances with counts by class, and whether a pattern there equals the query."""
    out = {}
    for q in asked:
        near = defaultdict(lambda: defaultdict(int))
        for r in rows:
            if without_self and r[0] == q[0]:
                continue
            d = round(sum(w * (a != b) for w, a, b in zip(weights, q[1:-1], r[1:-1])), 10)
            near[d][r[-1], q[1:-1] == r[1:-1]] += 1
        out[q[0]] = {d: dict(near[d]) for d in sorted(near)[: k + 1]}
    return out


def _nearest(found, k):
    out = defaultdict(lambda: defaultdict(dict))
    for r in found.collect():
        out[r["qid"]][r["d"]][r["class"], r["exact"]] = r["cnt"]
    return {q: {d: near[d] for d in sorted(near)[: k + 1]} for q, near in out.items()}


WEIGHTS = {1: [(0.7,), (0.0,)], 3: [(0.5, 0.2, 0.1), (1.0, 1.0, 1.0), (0.3, 0.0, 0.3)], 8: [(0.9, 0.5, 0.4, 0.4, 0.3, 0.2, 0.1, 0.0), (1.0,) * 8]}


@pytest.mark.parametrize(("m", "k", "way"), [(1, 1, "subsets"), (3, 1, "subsets"), (3, 3, "subsets"), (3, 50, "subsets"), (1, 1, "lists"), (3, 1, "lists"), (3, 50, "lists"), (8, 1, "lists"), (8, 4, "lists")])
def test_shared_values_find_what_all_pairs_do(spark, tables, monkeypatch, m, k, way):
    rows, asked, train, queries = tables[m]
    monkeypatch.setattr(search, "MOST", 6 if way == "subsets" else 0)
    monkeypatch.setattr(lists, "PROBES", 20)
    symbols = lambda df, key: df.select(key, *S.symbols(df, _names(m)), "class")
    base = search.base_table(symbols(train, "iid"), _names(m))
    for weights in WEIGHTS[m]:
        plan = [Feature(n, "O", w) for n, w in zip(_names(m), weights)]
        found = search.distances(symbols(queries, "qid"), base, plan, k)
        assert _nearest(found, k) == _plain(rows, asked, weights, k)
        own = symbols(train, "iid").withColumn("qid", F.col("iid"))
        found = search.distances(own, base, plan, k, leave_out=True)
        assert _nearest(found, k) == _plain(rows, rows, weights, k, without_self=True)


def test_rows_that_must_agree(spark, tables):
    """Neighbours within a block only."""
    rows, asked, train, queries = tables[3]
    block = lambda df, key: df.select(key, *S.symbols(df, _names(3)), "class", (F.col(key) % 2).alias("block"))
    base = search.base_table(block(train, "iid"), [*_names(3), "block"])
    plan = [Feature(n, "O", w) for n, w in zip(_names(3), (0.5, 0.2, 0.1))]
    got = _nearest(search.distances(block(queries, "qid"), base, plan, 2, block=["block"]), 2)
    assert got == {q[0]: _plain([r for r in rows if r[0] % 2 == q[0] % 2], [q], (0.5, 0.2, 0.1), 2)[q[0]] for q in asked}


@pytest.mark.parametrize("k", [1, 5])
def test_few_pairs_are_looked_at(spark, monkeypatch, k):
    """At most a tenth of all pairs of queries and patterns (for lists: where few of the possible distances are asked for)."""
    learner = MemoryBasedLearner(Options(k=k)).fit(PART.train(spark, SF), PART.names)
    queries = PART.queries(spark, SF)
    q, p = search.sides(queries, learner.fitted.base, learner.plan(), [], False, False)
    every = q.count() * p.count()
    cube = search.shared(q, p, learner.plan(), k)
    assert isinstance(cube, subsets.Subsets) and cube.within(cube.counts()).join(cube.counts(), ["mask", "values"]).count() <= every / 10
    if k > 1:
        return
    monkeypatch.setattr(search, "MOST", 0)
    way = search.shared(q, p, learner.plan(), k)
    sized = way.sized()
    probes = way.probes(sized)
    assert probes.count() + way.pairs(way.chosen(sized, probes)).count() <= every / 10


def test_exact_matches_are_not_searched(spark, tables, monkeypatch):
    """The grid gets the queries that the base lacks and those with a tie; asked for, an exact match alone answers."""
    rows, asked, train, queries = tables[3]
    seen = []
    plain = search.distances
    monkeypatch.setattr(search, "distances", lambda q, *a, **b: seen.append({r["qid"] for r in q.collect()}) or plain(q, *a, **b))
    by_pattern = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by_pattern[r[1:-1]][r[-1]] += 1
    best = lambda q: [c for c, n in by_pattern[q[1:-1]].items() if n == max(by_pattern[q[1:-1]].values())]
    tied, missing = {q[0] for q in asked if len(best(q)) > 1}, {q[0] for q in asked if not best(q)}
    assert tied and missing
    for options, searched in (({"metric": "M"}, tied | missing), ({"metric": "M", "exact": "on", "k": 3}, missing), ({"exact": "on", "k": 3}, missing)):
        seen.clear()
        out = {r["qid"]: r for r in MemoryBasedLearner(Options(**options)).fit(train, _names(3)).transform(queries).collect()}
        assert seen == [searched] and len(out) == len(asked)
        assert all(out[q[0]]["exact"] and out[q[0]]["predicted"] in best(q) for q in asked if q[0] not in searched)


def _scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("options", [{}, {"k": 3, "weighting": "ig", "decay": "ID"}, {"weighting": "nw", "k": 2}, {"diversify": True}])
def test_folds_at_once_are_folds_one_by_one(spark, tables, monkeypatch, options):
    *_, train, _ = tables[3]
    rows = train.withColumn("fold", F.pmod(F.xxhash64("iid"), F.lit(4)))
    rows = rows.withColumn("fold", F.when(F.col("class") == "Z", F.lit(1)).otherwise(F.col("fold")))  # fold 1 has a class of its own
    learner = MemoryBasedLearner(Options(**options))
    plain = lambda df: sorted((r["fold"], r["qid"], r["class"], r["predicted"], round(r["distance"], 8), r["tie"]) for r in df.collect())
    at_once = plain(learner.cross_validate(rows, _names(3)))
    monkeypatch.setattr(search, "MOST", 0)
    assert at_once == plain(learner.cross_validate(rows, _names(3))) and len(at_once) == 340


def test_scans_do_not_grow_with_folds(spark):
    rows = PART.instances(spark, SF)
    scans = [_scans(MemoryBasedLearner(Options()).cross_validate(rows.withColumn("fold", (F.col("iid") % n).cast("long")), PART.names)) for n in (2, 6)]
    assert scans[0] == scans[1]


# -- leave-one-out with numbers ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), str(rng.randrange(40)), str(rng.choice((1, 2, 2.5, 7, 100 + i))), rng.choice("XYZ")) for i in range(70)]
    rows += [(70, "a", "999", "-5", "X"), (71, "b", "-40", "7.0", "Y")]
    return spark.createDataFrame(rows, "iid long, f1 string, f2 string, f3 string, class string").cache()


@pytest.mark.parametrize("options", [{}, {"weighting": "sd"}, {"weighting": "x2", "k": 3}, {"weighting": "sv", "bins": 5}, {"diversify": True}, {"metric": "M:N2,3"}, {"metric": "O:E2:N3", "weighting": "ig"}])
def test_strict_leave_one_out_of_numbers_is_fitting_without_the_row(numbers, options):
    options = {"metric": "O:N2,3", "exact": "off", **options}
    found = {r["qid"]: (r["predicted"], r["distance"]) for r in MemoryBasedLearner(Options(**options)).fit(numbers, _names(3)).leave_one_out().collect()}
    assert len(found) == 72
    for i in (0, 13, 70, 71):  # the only rows of the greatest and least numbers are among them
        row = MemoryBasedLearner(Options(**options)).fit(numbers.where(f"iid <> {i}"), _names(3)).transform(numbers.where(f"iid = {i}").withColumn("qid", F.col("iid"))).first()
        assert found[i][0] == row["predicted"] and abs(found[i][1] - row["distance"]) < 1e-6, i


# -- a base of versions --------------------------------------------------------------------------------------------


def _same(a: MemoryBasedLearner, b: MemoryBasedLearner, queries) -> None:
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert rows(a.fitted.table, "fidx", "fval", "class", "cnt") == rows(b.fitted.table, "fidx", "fval", "class", "cnt")
    assert rows(a.fitted.classes, "class", "class_idx", "gfreq") == rows(b.fitted.classes, "class", "class_idx", "gfreq")
    assert rows(a.transform(queries), "qid", "predicted", "distance") == rows(b.transform(queries), "qid", "predicted", "distance")


@pytest.mark.parametrize("options", [{}, {"metric": "M", "k": 3}, {"metric": "O:I2"}, {"algorithm": "IGTREE"}])
def test_maintained_base_is_a_refit(spark, tables, options):
    rows, _, train, queries = tables[3]
    base = versions.VersionedBase(spark, fresh(spark, "base"), _names(3))
    with pytest.raises(ValueError):
        base.patterns()
    assert base.update(train.where("iid < 100")) and base.update(train.where("iid >= 100 AND iid < 1000"))
    assert base.update(train.where("iid >= 50 AND iid < 80"), -1)
    kept = train.where("iid < 1000 AND NOT (iid >= 50 AND iid < 80)")
    learner = lambda: MemoryBasedLearner(Options(**options)).learn(base.patterns(), base.cells(), _names(3))
    _same(learner(), MemoryBasedLearner(Options(**options)).fit(kept, _names(3)), queries)
    assert all(base.path.split(":")[-1] in f for f in base.patterns().inputFiles())
    base.compact()
    assert len({f.rpartition("/")[0] for f in base.patterns().inputFiles()}) == 1
    other = versions.VersionedBase(spark, fresh(spark, "base"), _names(3))
    other.update(train.where("iid >= 1000"))
    base.merge(other)
    base.compact()
    _same(learner(), MemoryBasedLearner(Options(**options)).fit(kept.unionByName(train.where("iid >= 1000")), _names(3)), queries)
    with pytest.raises(ValueError):
        base.merge(versions.VersionedBase(spark, fresh(spark, "base"), ["f1"]))


@pytest.mark.parametrize("how", ["maintained", "compacted", "merged", "partial_fit", "changed"])
def test_classes_come_in_the_order_of_the_rows_that_are_left(spark, how):
    """The first row of a class goes and others of its pattern stay: of equally frequent classes the one that is first now wins a tie."""
    rows = [(1, "a", "A"), (2, "a", "A"), (3, "a", "B"), (4, "a", "B"), (5, "a", "A"), (6, "c", "C")]
    df = spark.createDataFrame(rows, "iid long, f1 string, class string")
    df = df.unionByName(df.where("iid = 2").withColumn("iid", F.lit(7).cast("long"))).where("iid <> 2")
    gone, query = df.where("iid = 1"), spark.createDataFrame([(0, "a")], "qid long, f1 string")
    if how == "partial_fit":
        learner = MemoryBasedLearner(Options()).fit(df.where("iid < 7"), ["f1"]).partial_fit(df.where("iid = 7")).partial_fit(gone, -1)
    elif how == "changed":
        learner = MemoryBasedLearner(Options()).fit(edit.changed(df, gone, ["f1"], -1), ["f1"])
    else:
        base = versions.VersionedBase(spark, fresh(spark, "base"), ["f1"])
        base.update(df)
        if how == "compacted":
            base.compact()
        if how == "merged":
            base, other = versions.VersionedBase(spark, fresh(spark, "base"), ["f1"]), base
            base.merge(other)
        base.update(gone, -1)
        learner = MemoryBasedLearner(Options()).learn(base.patterns(), base.cells(), ["f1"])
    _same(learner, MemoryBasedLearner(Options()).fit(df.where("iid <> 1"), ["f1"]), query)
    assert learner.transform(query).first()["predicted"] == "B"
    assert {r["class"]: r["first"] for r in learner.fitted.base.collect()} == {"A": 5, "B": 3, "C": 6}


def test_a_change_counts_once_and_whole(spark, tables):
    *_, train, _ = tables[3]
    base = versions.VersionedBase(spark, fresh(spark, "base"), _names(3))
    total = lambda: (base.patterns().agg(F.sum("cnt")).first()[0], base.cells().agg(F.sum("cnt")).first()[0])
    assert base.update(train.where("iid < 10"), version=4) and not base.update(train.where("iid < 10"), version=4)
    assert total() == (10, 30)
    base._write(versions.delta(train, _names(3)), 0, 5)  # broke off before it was named
    assert total() == (10, 30)
    base.update(train.where("iid >= 10 AND iid < 25"), version=5)
    base.compact()
    assert not base.update(train, version=5) and total() == (25, 75)
    base._write(base.patterns(), 2, base.WHOLE)  # a compaction that broke off
    assert total() == (25, 75) and base.update(train.where("iid = 0"), -1) and total() == (24, 72)
    with pytest.raises(ValueError):
        base.update(train, version=-1)


def test_partial_fits_read_no_old_rows(spark, tables):
    *_, train, queries = tables[3]
    part = lambda r: train.where(f"iid % 3 = {r}")
    learner = MemoryBasedLearner(Options(k=2)).fit(part(0), _names(3)).partial_fit(part(1)).partial_fit(part(2)).partial_fit(part(1), -1)
    _same(learner, MemoryBasedLearner(Options(k=2)).fit(train.where("iid % 3 <> 1"), _names(3)), queries)
    learner.release()


def test_a_stream_maintains_a_base(spark, tables, tmp_path):
    *_, train, _ = tables[3]
    train.write.parquet(str(tmp_path / "rows"))
    base = versions.VersionedBase(spark, fresh(spark, "base"), _names(3))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(train.schema).parquet(str(tmp_path / "rows"))
        classify.maintain(base, stream, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert base.patterns().agg(F.sum("cnt")).first()[0] == 340


# -- blocks --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["M", "J:O1", "S", "O:N2,3", "O:E2:N3", "DC", "L", "D", "C", "D:I1"])
@pytest.mark.parametrize("leave_out", [False, True])
def test_blocks_find_what_the_grid_does(spark, numbers, monkeypatch, metric, leave_out):
    vectors = metric[0] in "DC" and metric != "DC"
    rows = numbers.withColumn("f1", F.when(F.col("iid") % 9 == 0, "0").otherwise(F.col("iid") % 5 - 2).cast("string")) if vectors else numbers
    rows = rows.withColumns({c: F.when(F.col("iid") == 5, "0").otherwise(F.col(c)) for c in _names(3)}) if vectors else rows
    learner = MemoryBasedLearner(Options(metric=metric, weighting="ig" if vectors else "gr", k=2)).fit(rows, _names(3))
    queries = rows.withColumn("qid", F.col("iid"))
    if leave_out:
        queries = learner.fitted.instances.withColumn("qid", F.col("iid"))
    found = lambda: _nearest(learner.found(queries, 2, leave_out=leave_out), 2)
    whole = found()
    for name, value in (("PAIRS", 0), ("BLOCK", 5), ("PART", 7)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(blocks, "BLOCKS", 6)
    monkeypatch.setattr(blocks, "PIVOTS", 4)
    assert found() == whole and len(whole) == 72


@pytest.mark.parametrize("metric", ["D", "C", "M"])
def test_blocks_are_left_out(spark, monkeypatch, metric):
    """Of rows in groups that lie apart, a query visits few blocks."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        g = i % 12
        if metric == "M":
            rows.append((i, f"v{g}", f"w{rng.randrange(3)}", f"u{rng.randrange(3)}", f"c{g}"))
        else:
            size = 2.0**g if metric == "D" else 1.0
            rows.append((i, *(str(round(size * ((1.0 if metric == "D" else [1.0, g / 3, (g % 4) * 1.5][j]) + rng.random() / 50), 4)) for j in range(3)), f"c{g}"))
    df = spark.createDataFrame(rows, "iid long, f1 string, f2 string, f3 string, class string")
    learner = MemoryBasedLearner(Options(metric=metric, weighting="nw" if metric != "M" else "user", weights={"1": 1.0, "2": 0.1, "3": 0.1} if metric == "M" else None)).fit(df.where("iid % 10 > 0"), _names(3))
    queries = df.where("iid % 10 = 0").withColumn("qid", F.col("iid"))
    seen = []
    plain = search._meeting
    monkeypatch.setattr(search, "PAIRS", 0)
    monkeypatch.setattr(search, "_meeting", lambda q, p, keys, *a: seen.append(q.select("qid", "block").distinct().count()) or plain(q, p, keys, *a))
    out = learner.found(queries, 1)
    every = {"D": blocks.BLOCKS, "C": blocks.PIVOTS, "M": 12}[metric] * 60
    assert len(seen) == 2 and sum(seen) <= every / 3, seen
    assert out.select("qid").distinct().count() == 60


@pytest.mark.parametrize("kind", ["N", "E"])
@pytest.mark.parametrize("strict", [False, True])
def test_numbers_far_away_are_left_out(spark, monkeypatch, kind, strict):
    """Of numbers that hardly repeat, a query visits the blocks around its own; numbers written in odd ways and weights of the size of their sum included."""
    rng = random.Random(5)
    number = lambda i: [str(i), f"{i}.0", f"+{i}", f"{i}e0", f"-{i}"][rng.randrange(5)]
    rows = [(i, rng.choice("123"), number(rng.randrange(400)), rng.choice("XYZ")) for i in range(500)]
    df = spark.createDataFrame(rows, "iid long, f1 string, f2 string, class string")
    learner = MemoryBasedLearner(Options(metric=f"O:{kind}2", weighting="sd", exact="off", sloppy=not strict)).fit(df, _names(2))
    assert learner.fitted.metrics == ["O", kind] and learner.fitted.weights[1] > 1000
    answers = lambda: sorted(map(str, learner.leave_one_out().select("qid", "class", "predicted", "distance", "tie").collect()))
    whole = answers()
    seen, plain = [], search._meeting
    monkeypatch.setattr(search, "PAIRS", 0)
    monkeypatch.setattr(blocks, "BLOCKS", 40)
    monkeypatch.setattr(search, "_meeting", lambda q, p, keys, *a: seen.append(q.select("qid", "block").distinct().count()) or plain(q, p, keys, *a))
    assert answers() == whole and len(whole) == 500
    assert len(seen) == 2 and sum(seen) < 500 * 40 / 3, seen


def test_equal_rows_ask_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, "abc"[i % 3], str(i % 5), "XY"[i % 2]) for i in range(90)] + [(90, "a", "0", "X")], "iid long, f1 string, f2 string, class string")
    asked, plain = [], search.distances
    monkeypatch.setattr(search, "distances", lambda q, *a, **b: asked.append(q.count()) or plain(q, *a, **b))
    for sloppy in (True, False):
        out = {r["qid"]: r["predicted"] for r in MemoryBasedLearner(Options(metric="O:N2", sloppy=sloppy, exact="off")).fit(df, _names(2)).leave_one_out().collect()}
        assert set(out) == set(range(91)) and out[0] == out[30] == out[60] == out[90]
    assert asked == [30, 30]


@pytest.mark.parametrize(("kind", "pairs"), [("C", search.PAIRS), ("D", search.PAIRS), ("D", 0)])
@pytest.mark.parametrize("leave_out", [False, True])
def test_vectors_of_one_length_are_not_copied_to_blocks(spark, monkeypatch, kind, leave_out, pairs):
    """No bound excludes any; pairs are compared without copies of queries and patterns in a shuffle, and no statistics of all their values are taken."""
    rng = random.Random(6)
    rows = []
    for i in range(200):
        x = [rng.gauss(0, 1) for _ in range(3)]
        x = [v / sum(u * u for u in x) ** 0.5 for v in x] if i % 20 else [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0]][i // 20 % 2]
        rows.append((i, *(None if v == 0 and i % 40 else [str(v), f"+{v}"][i % 60 == 0] for v in x), rng.choice("XY")))
    rows += [(300 + i, *r[1:]) for i, r in enumerate(rows[:30])]
    df = spark.createDataFrame(rows, "iid long, f1 string, f2 string, f3 string, class string").repartition(3)
    monkeypatch.setattr(S, "weights", lambda *a, **b: pytest.fail("statistics"))
    learner = MemoryBasedLearner(Options(metric=kind, weighting="nw", k=2)).fit(df, _names(3))
    queries = df.withColumn("qid", F.col("iid"))
    for module, name, value in ((search, "PAIRS", pairs), (search, "HELD", 300), (products, "QUERIES", 50), (products, "PATTERNS", 60), (products, "LEAST", 40), (search, "DENSE", 64 if leave_out else 1)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(search, "_meeting", lambda *a, **b: pytest.fail("copies"))
    found = _nearest(learner.found(queries if not leave_out else learner.fitted.instances.withColumn("qid", F.col("iid")), 2, leave_out=leave_out), 2)
    number = lambda r: [float(v or 0) for v in r[1:-1]]
    for q in rows:
        near = defaultdict(lambda: defaultdict(int))
        for r in rows:
            if leave_out and r[0] == q[0]:
                continue
            x, y = number(q), number(r)
            dot, both = sum(a * b for a, b in zip(x, y)), sum(a * a for a in x) * sum(b * b for b in y)
            near[round(1 - dot / (both**0.5 + S.EPSILON) if kind == "C" else (search.INT_MAX - dot) / search.INT_MAX, 10)][r[-1], q[1:-1] == r[1:-1]] += 1
        least = sorted(near)[:3]
        assert [pytest.approx(d, abs=2e-10) for d in least] == sorted(found[q[0]]), q
        # A distance between two roundings may fall either way; all else is counted alike.
        assert sum(sum(near[d].values()) for d in least) == sum(sum(x.values()) for x in found[q[0]].values())
        assert sum(n for d in least for (_, e), n in near[d].items() if e) == sum(n for x in found[q[0]].values() for (_, e), n in x.items() if e)


@pytest.mark.parametrize("options", [Options(), Options(metric="M"), Options(exact="on"), Options(metric="O:N3", weighting="nw")])
def test_settings_of_one_search_are_those_of_many(spark, options):
    """Each setting's answers are those of a learner of its own; the plan's search doesn't grow with the settings."""
    sf = "/root/testdata/sf0.001"
    fitted = MemoryBasedLearner(options).fit(PART.train(spark, sf), PART.names)
    queries = PART.queries(spark, sf)
    settings = [options.but(k=k, decay=decay, decay_a=0.5, exact=exact) for k, decay, exact in ((1, "Z", "reference"), (1, "Z", "off"), (2, "IL", "reference"), (4, "ED", "off"), (3, "ID", "on"))]
    shown = ("qid", "class", "predicted", "distance", "tie", "exact")
    every = fitted.test_each(queries, settings)
    out = {n: set() for n in range(len(settings))}
    for r in every.collect():
        out[r["setting"]].add(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in shown)))
    for n, o in enumerate(settings):
        own = MemoryBasedLearner(o).fit(PART.train(spark, sf), PART.names).test(queries)
        assert out[n] == {tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in shown)) for r in own.collect()}
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert scans(every) == scans(fitted.test_each(queries, settings[-2:]))


def test_settings_that_change_distances_need_a_search_of_their_own(spark):
    fitted = MemoryBasedLearner(Options()).fit(PART.train(spark, "/root/testdata/sf0.001"), PART.names)
    for other in ([Options(metric="M")], [Options(weighting="ig")], []):
        with pytest.raises(ValueError):
            fitted.test_each(PART.queries(spark, "/root/testdata/sf0.001"), other)
