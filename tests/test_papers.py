"""Papers: states, compact forms, replays, evidence and audits of small excerpts, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from foldlog.functions import text as T
from foldlog.operators import papers as P

TEXT = """PAPER_ID: one
TITLE: A Title: with marks.

SECTION: problem
Wide Tables need the engine. The engine can harm tables!

  It waits.
SECTION: method
StepView maps state. Rather than memory systems, execution  state is kept? prefix reuse 1.5 times
SECTION: metrics
Latency 1
SECTION: metrics
AUPRC and latency. 2 rows. 12 more
SECTION: other
ignored Words
"""


def papers(spark, rows):
    return spark.createDataFrame(rows, "pid string, text string, need array<string>, value int, title int")


@pytest.fixture(scope="module")
def states(spark):
    return P.paper_states(papers(spark, [("one", TEXT, ["StepView", "Prefix reuse", "DFA"], 1, 2), ("none", None, None, 1, 2), ("empty", "", [], 1, 2), ("crlf", "TITLE: t\r\nSECTION: method\r\nOne two.\r\nThree", ["two"], 1, 2)]), "pid", "text", "need").persist()


def test_states(states):
    r = {x.pid: x for x in states.collect()}
    one = r["one"]
    assert one.title == "A Title: with marks."
    assert one.problem == ["engine", "harm", "need", "tables", "waits", "wide"]
    assert one.metrics == ["12", "2", "auprc", "latency", "more", "rows"]
    assert one.limitations == [] and one.baselines == ["execution", "kept", "memory", "state", "systems"]
    assert one.required_entities == ["Prefix reuse", "StepView"]
    assert {"AUPRC", "Latency", "StepView", "Tables", "Wide", "prefix reuse", "Prefix reuse"} <= set(one.entities) and "The" not in one.entities and "It" not in one.entities
    assert one.entities == sorted(one.entities, key=lambda e: (e.lower(), e))
    for k in ("none", "empty"):
        assert all(getattr(r[k], f) == [] for f in P.FIELDS) and r[k].title == ""
    assert r["crlf"].method == ["one", "three", "two"] and r["crlf"].required_entities == ["two"]


def test_sentences_keep_their_digits(spark):
    got = spark.createDataFrame([("0 a. 1 b! 2 c? 3.14",)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s
    assert got == ["0 a.", "1 b!", "2 c?", "3.", "14"]


def test_budgets_and_kept_entities(spark, states):
    compact = {x.pid: x for x in P.compact_paper(states, "pid", {**P.BUDGETS, "problem": 2}).collect()}
    assert compact["one"].problem == ["engine", "harm"]
    df = spark.createDataFrame([(["a", "B", "c", "D", "e", "F"], ["F", "x"]), (["a"], []), ([], [])], "e array<string>, r array<string>")
    assert [x.k for x in df.select(P.kept_entities(F.col("e"), F.col("r")).alias("k")).collect()] == [["a", "B", "c", "D", "F"], ["a"], []]


def test_thresholds_differ_by_field(spark):
    df = spark.createDataFrame([(list("abcdefghij"), list("abcdef")), (list("abcdefghij"), list("abcdefg")), ([], [])], "o array<string>, r array<string>")
    held = lambda f: [x.h for x in df.select(P.survives(f, F.col("o"), F.col("r")).alias("h")).collect()]
    assert held("problem") == [True, True, False] and held("metrics") == [False, True, False]
    assert held("entities") == [False, False, False] and held("baselines") == [True, True, False] and held("required_entities") == [False, False, False]


def test_evidence_by_locator(spark, states):
    compact = P.compact_paper(states, "pid")
    raw = papers(spark, [("one", TEXT, None, 1, 2), ("crlf", "SECTION: method\r\nOne two.\r\nThree", None, 1, 2)])
    rows = [("one", "a", "method:0", "HIGH"), ("one", "b", "metrics:2", "LOW"), ("one", "c", "metrics:9", "LOW"), ("one", "d", "line:0", "HIGH"), ("one", "e", "other:0", "LOW"), ("one", "f", "nothing", "LOW"), ("one", "g", "metrics:0", None), ("crlf", "a", "method:1", "high"), ("lost", "a", "method:0", "LOW")]
    spec = spark.createDataFrame(rows, "pid string, evidence_id string, locator string, criticality string")
    got = {x.pid: x for x in P.paper_evidence(spec, raw, compact, "pid", "text").collect()}
    assert (got["one"].evidence_total, got["one"].evidence_survived, got["one"].has_high, got["one"].high_survival_rate) == (7, 3, True, 0.5)
    assert got["crlf"].evidence_survived == 1 and got["lost"].evidence_survived == 0
    cut = compact.withColumn("method", F.slice("method", 1, 1))
    again = {x.pid: x.evidence_survived for x in P.paper_evidence(spec, raw, cut, "pid", "text").collect()}
    assert again == {"one": 2, "crlf": 0, "lost": 0}


def test_rows_and_summary(spark, states):
    raw = papers(spark, [("one", TEXT, None, 1, 2), ("crlf", "SECTION: method\r\nOne two.\r\nThree", None, 1, 2), ("none", None, None, 1, 2)])
    compact = P.compact_paper(states, "pid")
    spec = spark.createDataFrame([("one", "a", "method:0", "HIGH"), ("one", "b", "line:0", "LOW")], "pid string, evidence_id string, locator string, criticality string")
    rows = P.paper_validation(states, compact.withColumn("metrics", P.no_texts()), compact, raw, spec, "pid", "text")
    got = {x.pid: x for x in rows.collect()}
    one = got["one"]
    assert one.failure_labels == ["EVIDENCE_LOSS"] and one.has_evidence and one.metric_survival_rate == 0.0 and one.section_survival_rate == round(3 / 6, 6)
    assert not got["none"].has_evidence and got["none"].failure_labels == [] and got["none"].replay_consistency == 0.0 and got["none"].original_token_count == 0
    assert one.compact_token_count == 11 + sum(len(__import__("re").findall(T.WORD, " , ".join(x))) for x in (compact.where("pid = 'one'").select(*P.FIELDS).first()))
    total = P.validation_summary(rows).first()
    assert total.paper_count == 3 and total.failure_labels == ["EVIDENCE_LOSS"] and total.avg_evidence_survival_rate == round(0.5 / 3, 6)
    empty = P.validation_summary(rows.limit(0)).first()
    assert empty.paper_count == 0 and empty.avg_replay_consistency == 0.0 and empty.failure_labels == []


def test_audit(states):
    whole = {x.pid: x for x in P.retention_audit(states, states, "pid", ["problem", "metrics"]).collect()}
    assert (whole["one"].score, whole["one"].passed) == (1.0, True) and (whole["empty"].score, whole["empty"].passed) == (0.65, False)
    lost = states.withColumns({"entities": P.no_texts(), "required_entities": P.no_texts(), "method": P.no_texts(), "metrics": P.no_texts()})
    one = {x.pid: x for x in P.retention_audit(states, lost, "pid", ["problem", "metrics"]).collect()}["one"]
    assert one.lost == ["Prefix reuse", "StepView"] and one.score == 0.15 and not one.passed


def test_queries_read_each_text_once(spark):
    from foldlog.plans import paper_queries as Q

    for query in (Q.paper_evidence, Q.paper_validation, Q.paper_retention):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Exchange" not in plan, query.__name__
