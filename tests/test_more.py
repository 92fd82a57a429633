"""States, contracts, sinks, sources and streams on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from foldlog.operators import states as S
from foldlog.operators.contracts import violations
from foldlog.operators.reporting import export_rows, incidents, search, service_health
from foldlog.operators.timeline import compare_runs, running_snapshots
from foldlog.plans import registry
from foldlog.sources import lines, sinks
from foldlog.streaming.signals import drained, stream_modes, window_counts

SF = "/root/testdata/sf0.001"


def test_state_pieces(spark):
    df = spark.createDataFrame([([" a  b ", "", None, "c"], [("t1", "completed"), ("t2", "Pending"), ("t3", "pending"), ("t4", "odd")])], "xs array<string>, tasks array<struct<title: string, status: string>>")
    r = df.select(S.clean_list(F.col("xs")).alias("xs"), S.active_task(F.col("tasks")).alias("t")).first()
    assert r.xs == ["a b", "c"] and r.t.title == "t2"
    none = spark.createDataFrame([([("t", "odd")],)], "tasks array<struct<title: string, status: string>>").select(S.active_task(F.col("tasks")).alias("t")).first()
    assert none.t is None
    e = spark.createDataFrame([(["z", "y", "x", "w", "v", "u"], ["z"])], "e array<string>, r array<string>").select(S.budgeted_entities(F.col("e"), F.col("r")).alias("x")).first()
    assert e.x == ["u", "v", "w", "x", "z"]
    d = spark.createDataFrame([([("b", "1"), ("a", " "), ("a", "2")],)], "d array<struct<x: string, y: string>>").select(S.ordered_records(F.col("d"), ["x", "y"]).alias("d")).first()
    assert [(x.x, x.y) for x in d.d] == [("a", "2"), ("b", "1")]


def test_survival_of_missing_replay(spark):
    a = spark.createDataFrame([(1, ["x"], []), (2, ["x", "y"], ["z"])], "id int, p array<string>, q array<string>")
    b = a.where("id = 2").withColumn("p", F.array(F.lit("x")))
    got = {r.id: (r.p_coverage, r.q_coverage, r.consistency) for r in S.survival(a, b, "id", ["p", "q"]).collect()}
    assert got == {1: (0.0, 0.0, 0.0), 2: (0.5, 1.0, 0.5)}


def test_contract_rules(spark):
    rows = [(1, '{"a": 1, "b": "x"}'), (2, '{"a": true}'), (3, "[1]"), (4, None), (5, '{"a": null, "b": null}'), (6, '{"b": {"c": 1}, "z": 2}')]
    df = spark.createDataFrame(rows, "id int, j string")
    got = sorted((r.id, r.path, r.problem) for r in violations(df, "id", "j", [("a", "integer|null", True), ("b", "string|object", False)], additional=False).collect())
    assert got == [(2, "a", "type"), (3, "", "invalid"), (4, "", "invalid"), (5, "b", "type"), (6, "a", "missing"), (6, "z", "unknown")]


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "t")
    first = sinks.write_once(df, path)
    assert sinks.write_once(df.orderBy(F.desc("k")), path) == first
    with pytest.raises(ValueError):
        sinks.write_once(df.limit(1), path)
    sinks.write_json_lines(df.limit(1).select("v", "k"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"k":1,"v":"a"}'
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.log").write_text("one  \n\ntwo\n")
    assert sorted(r.raw for r in lines.read_lines(spark, str(tmp_path)).collect()) == ["", "one", "two"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.jsonl").write_text('{"id": 1}\n{broken\n')
    got = lines.read_records(spark, str(tmp_path / "r"), "id int").collect()
    assert [r.id for r in got if r._corrupt_record is None] == [1] and len(got) == 2 and got[0].file == "x.jsonl"
    assert lines.read_documents(spark, str(tmp_path / "a.log")).first().text == "one  \n\ntwo\n"


def test_reports(spark):
    h = service_health(spark.createDataFrame([("a", 9.0, 0), ("b", 1.0, 2), ("c", 1.0, 0)], "service string, peak double, failures long"), 5.0)
    f = spark.createDataFrame([("d1", "HIGH"), ("d2", "LOW")], "d string, level string")
    assert {(r.incident, r.about) for r in incidents(h, f, "d").collect()} == {("degraded-0001", "a"), ("failing-0001", "b"), ("drift-0001", "d1")}
    t = spark.createDataFrame([("Red x", None), ("blue", "red")], "p string, q string")
    assert search(t, " RED ", ["p", "q"]).count() == 2 and search(t, " ", ["p"]).count() == 2
    assert export_rows(t.select("p"), t.select("q")).columns == ["p", "q"]


def test_runs(spark):
    e = spark.createDataFrame([(1, 0, 2, 0, "a", None), (1, 1, 0, 3, "b", 0.5), (1, 2, 1, 0, "a", None), (2, 0, 4, 0, "b", None)], "execution_id int, seq int, token_in long, token_out long, ref string, quality double")
    s = running_snapshots(e).where("execution_id = 1").orderBy("seq").collect()
    assert [(r.token_in, r.token_out, r.refs_so_far, r.quality) for r in s] == [(2, 0, 1, None), (2, 3, 2, 0.5), (3, 3, 2, 0.5)]
    c = compare_runs(e, spark.createDataFrame([(1, 2)], "left_id int, right_id int")).first()
    assert (c.added, c.removed, c.shared, c.cost_delta, c.snapshot_cost_delta) == ("", "a", "b", -2, -9)


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    schema = "execution_id long, window_id long, at long, error double"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 1, 0.7), (1, 2, 2, 0.7)], schema).coalesce(1).write.parquet(source)
    run = lambda: stream_modes(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    run()
    spark.createDataFrame([(1, 3, 3, 0.5), (1, 9, 0, 0.9), (2, 1, 1, 0.9)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {(r.execution_id, r.window_id): r.mode for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # deliberation lasts over the restart; the row behind the last one evaluated is not evaluated
    assert got == {(1, 1): "monitor", (1, 2): "deliberation", (1, 3): "deliberation", (2, 1): "rollback_required"}


def test_window_counts(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(t, "a"), (t + datetime.timedelta(minutes=5), "a"), (t + datetime.timedelta(hours=5), "b")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = drained(window_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))), "t")
    assert [(r.event_type, r.n) for r in out.collect()] == [("a", 2)]


def test_every_window_is_counted(spark):
    got = registry.QUERIES["stream_counts_all"](spark, SF)
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert got.where("start >= '2024-01-30 00:00:00'").count() > 0


def test_keyword_sets_of_every_language(spark, tmp_path):
    rows = [(1, "Über the house Haus", "de"), (2, "the cat", None), (3, None, "fr"), (4, "dog", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.keywords for r in registry.QUERIES["keyword_sets_all"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[2] == "cat" and got[3] == "" and {"house", "haus"} <= set(got[1].split(","))
