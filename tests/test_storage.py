"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from seqgraph.plans import fixture as fx
from seqgraph.sources import files, sinks
from seqgraph.streaming import counts


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 5)], "k string, n long")
    new = spark.createDataFrame([("b", 2), ("c", 3), ("c", 3)], "k string, n long")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(sinks.merge_add(old, new, ["k"])) == {("a", 1), ("b", 7), ("c", 6)}
    assert as_set(sinks.merge_min(old, new, ["k"])) == {("a", 1), ("b", 2), ("c", 3)}
    assert as_set(sinks.merge_replace(old, new, ["k"])) == {("a", 1), ("b", 2), ("c", 3)}
    fresh, told = sinks.insert_missing(old, new, ["k"])
    assert as_set(fresh) == {("c", 3)} and tuple(told.first()) == (3, 1, 2)
    path = str(tmp_path / "t")
    sinks.replace(spark, old, path)
    sinks.replace(spark, sinks.merge_add(spark.read.parquet(path), new, ["k"]), path)
    assert as_set(spark.read.parquet(path)) == {("a", 1), ("b", 7), ("c", 6)}
    sinks.overwrite_partitions(old, str(tmp_path / "p"), "k")
    sinks.overwrite_partitions(spark.createDataFrame([("b", 9)], "k string, n long"), str(tmp_path / "p"), "k")
    assert as_set(spark.read.parquet(str(tmp_path / "p")).select("k", "n")) == {("a", 1), ("b", 9)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("eco\tname\tpgn\nA00\tX: y\t1. a3\nA01\tempty\t\n")
    assert [r["eco"] for r in files.read_taxonomy(spark, str(tmp_path / "t.tsv")).collect()] == ["A00"]
    (tmp_path / "r.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    good, bad = files.read_json_lines(spark, str(tmp_path / "r.jsonl"), "id int")
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and [r["line"] for r in bad.collect()] == ["not json"]
    (tmp_path / "d.json").write_text(json.dumps({"meta": {"n": 2}, "groups": [{"id": "x"}]}, indent=1))
    assert files.read_document(spark, str(tmp_path / "d.json"), "meta struct<n:int>, groups array<struct<id:string>>").select(F.size("groups")).first()[0] == 1
    files.write_lines(spark.range(50).withColumn("x", -F.col("id")), str(tmp_path / "out"), "x")
    lines = [json.loads(x)["id"] for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == list(range(49, -1, -1))
    (tmp_path / "q.csv").write_text("key,n\na,1\n")
    assert files.read_queue(spark, str(tmp_path / "q.csv"), "key string, n int").first()["n"] == 1


def test_stream_equals_batch(spark, small, tmp_path):
    rows = fx.first_visits(spark, small).select("state", "action", "outcome").cache()
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts = rows.randomSplit([0.5, 0.5], seed=3)
    parts[0].coalesce(2).write.mode("append").parquet(source)
    counts.ingest(spark, source, target, checkpoint)
    so_far = counts.counts(spark, target).agg(F.sum("games")).first()[0]
    parts[1].coalesce(1).write.mode("append").parquet(source)
    counts.ingest(spark, source, target, checkpoint)
    counts.ingest(spark, source, target, checkpoint)  # nothing new arrives: nothing is added
    got = {tuple(r) for r in counts.counts(spark, target).select("state", "action", "games", "w", "d", "b").collect()}
    want = {tuple(r) for r in counts.move_counts(rows).select("state", "action", "games", "w", "d", "b").collect()}
    assert got == want and 0 < so_far < rows.count()


def test_sessions(spark, small):
    events = fx.table(spark, small, "events")
    got = counts.sessions(events, "1 hour", "6 hours")
    assert got.agg(F.sum("n")).first()[0] == events.count() and got.where("closed <= opened").count() == 0
