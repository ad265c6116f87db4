"""Readers, writers and streams."""

from __future__ import annotations

import pytest

from recollect.model import MemoryBasedLearner
from recollect.options import Options
from recollect.sources import readers, writers
from recollect.streaming import classify as streams


def put(tmp_path, text: str, name: str = "rows.txt") -> str:
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df) -> list[tuple]:
    return [tuple(r)[1:] for r in df.orderBy("iid").collect()]


WANTED = [("a", "b", "X"), ("a", "c", "Y")]


@pytest.mark.parametrize(
    ("text", "how"),
    [
        ("a,b,X.\n\na,c,Y.\na,Z.\n", {}),
        ("a  b X\na\tc Y\n", {}),
        ("a\tb\tX\na\tc\tY\n", {"fmt": "Tabbed"}),
        ("abX\nacY\n", {}),
        ("@relation r\n@attribute a\n@DATA\na,b,X\na,c,Y\n", {"fmt": "ARFF"}),
        ("X,a,b\nY,a,c\n", {"target": 1}),
    ],
)
def test_formats(spark, tmp_path, text, how):
    assert rows(readers.read(spark, put(tmp_path, text), **how)) == WANTED


def test_sparse_and_binary(spark, tmp_path):
    assert rows(readers.read(spark, put(tmp_path, "(1,0.5),(3,x),P.\n(2,7)Q\n"), fmt="Sparse", n=3)) == [("0.5", readers.SPARSE_FILL, "x", "P"), (readers.SPARSE_FILL, "7", readers.SPARSE_FILL, "Q")]
    assert rows(readers.read(spark, put(tmp_path, "1,3,P.\n2,Q\n"), fmt="Binary", n=3)) == [("1", "0", "1", "P"), ("0", "1", "0", "Q")]


def test_variants_and_skipped_lines(spark, tmp_path):
    path = put(tmp_path, "a,b,X 2.5\na,c,Y 3\na,c 1\n")
    assert rows(readers.read(spark, path, fmt="C4.5", variant="exemplar")) == [("a", "b", "X", 2.5), ("a", "c", "Y", 3.0)]
    assert rows(readers.skipped(spark, path, fmt="C4.5", variant="exemplar")) == [("a,c",)]
    assert rows(readers.read(spark, path, fmt="C4.5", variant="exemplar", ignore_weights=True)) == WANTED


def test_line_order_over_files_and_splits(spark, tmp_path):
    for k in range(3):
        put(tmp_path, "".join(f"v{k},w{i},X\n" for i in range(500)), f"part{k}.txt")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = rows(readers.read(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(f"v{k}", f"w{i}", "X") for k in range(3) for i in range(500)]


def test_sniffing_and_folds(spark, tmp_path):
    assert [readers.sniff(x) for x in ("abc", "a,b c", "a b,c d")] == ["Compact", "C4.5", "Columns"]
    paths = [put(tmp_path, "a,b,X\na,c,Y\n", f"{k}.txt") for k in range(3)]
    assert readers.folds(spark, paths).groupBy("fold").count().count() == 3
    with pytest.raises(ValueError):
        readers.folds(spark, paths[:2])


@pytest.fixture(scope="module")
def learner(spark):
    data = [(k, f"a{k % 3}", f"b{k % 4}", "X" if k % 3 else "Y") for k in range(60)]
    return MemoryBasedLearner().fit(spark.createDataFrame(data, "iid long, f1 string, f2 string, class string"), ["f1", "f2"])


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(k, f"a{k % 4}", f"b{k % 5}", "X") for k in range(12)], "qid long, f1 string, f2 string, class string")


def test_weights_round_trip(spark, tmp_path, learner):
    writers.write_weights(learner, str(tmp_path / "w"))
    back = readers.read_weights(spark, str(tmp_path / "w"), "gr")
    assert back == pytest.approx({r["fidx"]: r["gr"] for r in learner.weights().collect()})


def test_saved_learner_answers_the_same(spark, tmp_path, learner, queries):
    learner.save(str(tmp_path / "m"))
    again = MemoryBasedLearner.load(spark, str(tmp_path / "m"))
    ask = lambda m: sorted(tuple(r)[:3] for r in m.transform(queries).select("qid", "predicted", "distance").collect())
    assert ask(again) == ask(learner)


def test_written_answers(spark, tmp_path, learner, queries):
    answered = learner.transform(queries)
    writers.write_lines(writers.classified(queries, answered, ["f1", "f2"], True, True), str(tmp_path / "out"))
    text = [r["value"] for r in readers.lines(spark, str(tmp_path / "out")).orderBy("iid").collect()]
    assert len(text) == 12 and text[0].startswith("a0,b0,X,Y { Y ")
    assert '"category":"Y"' in writers.as_json(answered).where("qid = 0").first()["value"]
    assert {r["fidx"]: r["value"] for r in writers.names(learner).collect()} == {0: "Y,X", 1: "a0,a1,a2", 2: "b0,b1,b2,b3"}


def test_streams(spark, tmp_path, learner, queries):
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    streams.classify(learner, stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "predicted").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, learner.transform(queries).select("qid", "predicted").collect()))
    grown = streams.patterns(stream.withColumnRenamed("qid", "iid"), ["f1", "f2"]).writeStream.outputMode("complete").format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    grown.awaitTermination(120)
    assert spark.table("grown").agg({"occ": "sum"}).first()[0] == 12


def test_level_lines_have_classes_and_next_values(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x", "P"), (2, "a", "x", "P"), (3, "a", "y", "Q"), (4, "b", "x", "Q"), (5, "b", None, "Q")], "iid long, f1 string, f2 string, class string")
    fitted = MemoryBasedLearner(Options(weighting="user", weights={"1": 2.0, "2": 1.0}, tree_order="UDO")).fit(rows, ["f1", "f2"])
    got = [r["value"] for r in writers.level_lines(fitted).orderBy("place").collect()]
    order = [fitted.fitted.features[i - 1] for i in fitted.fitted.order]
    assert [v for v in got if v.startswith("2 ")] and all(v.endswith("< >") for v in got if v.startswith("2 "))
    if order[0] == "f1":
        assert "1 [ a ] { P 2, Q 1 } < x y >" in got and "2 [ a x ] { P 2 } < >" in got
    else:
        assert "1 [ x ] { P 2, Q 1 } < a b >" in got and "2 [ x a ] { P 2 } < >" in got
    writers.write_lines(writers.level_lines(fitted, 2), str(tmp_path / "levels"), "place")
    assert spark.read.text(str(tmp_path / "levels")).count() == 4
