"""Repeated compaction: rounds on contents, early stops, limits, both kinds of runs."""

import pytest
from pyspark.sql import functions as F

from foldlog.operators import cycles as C
from foldlog.operators import papers as P


@pytest.fixture(scope="module")
def made(spark):
    text = "TITLE: t\nSECTION: method\n" + " ".join(f"word{k:02d}" for k in range(30)) + ". And Some Names.\nSECTION: metrics\nOne two three."
    raw = spark.createDataFrame([(1, text, ["Names"]), (2, "", [])], "doc_id long, text string, need array<string>")
    evidence = spark.createDataFrame([(1, "a", "method:0", "HIGH"), (1, "b", "metrics:0", "LOW")], "doc_id long, evidence_id string, locator string, criticality string")
    return raw, P.paper_states(raw, "doc_id", "text", "need").persist(), evidence


def rows_of(df):
    return {(r.profile, r.id, r.cycle): r for r in C.run_names(df, "id").collect()}


def test_profiles_lose_more_round_after_round(made):
    raw, states, evidence = made
    got = rows_of(C.paper_cycles(states, evidence, raw, "doc_id", "text"))
    assert len(got) == 2 * 3 * 3 and all(r.reason is None for r in got.values())
    at = lambda p, k: got[p, 1, k]
    # 22 of 31 keywords stay under the budget: the sentence of 30 matches at 0.60, not after another third is gone
    assert at("CONSERVATIVE", 1).evidence_survival_rate == at("CONSERVATIVE", 3).evidence_survival_rate == 1.0
    assert at("BALANCED", 1).evidence_survival_rate == 0.5 and at("BALANCED", 1).failure_labels == ["EVIDENCE_LOSS", "HIGH_CRITICAL_EVIDENCE_LOSS"]
    assert at("AGGRESSIVE", 3).replay_consistency <= at("AGGRESSIVE", 1).replay_consistency < at("CONSERVATIVE", 1).replay_consistency
    assert got["BALANCED", 2, 1].replay_consistency == 0.0 and not got["BALANCED", 2, 1].failure_labels


def test_runs_stop_by_themselves(made):
    raw, states, evidence = made
    got = rows_of(C.paper_cycles(states, evidence, raw, "doc_id", "text", C.Limits(least_critical=0.5, fatal=("CONSTRAINT_DRIFT",))))
    assert {k for k in got if k[1] == 1} == {("CONSERVATIVE", 1, 1), ("CONSERVATIVE", 1, 2), ("CONSERVATIVE", 1, 3), ("BALANCED", 1, 1), ("AGGRESSIVE", 1, 1)}
    assert got["BALANCED", 1, 1].reason == "min_high_critical_evidence_survival_rate"
    all_at_once = rows_of(C.paper_cycles(states, evidence, raw, "doc_id", "text", C.Limits(least_consistency=1.0)))
    assert {k[2] for k in all_at_once} == {1} and {r.reason for r in all_at_once.values()} == {"min_replay_consistency"}
    summary = {r.profile: r for r in C.cycle_summary(C.paper_cycles(states, evidence, raw, "doc_id", "text", C.Limits(least_critical=0.5)).withColumn("profile", F.substring_index("run", ":", 1)), ["profile"]).collect()}
    assert (summary["BALANCED"].runs, summary["BALANCED"].collapse_rate, summary["BALANCED"].highest_collapse_cycle) == (2, 0.5, 1) and summary["CONSERVATIVE"].collapse_rate == 0.0


def test_limits_are_checked(made):
    for bad in ({"cycles": 0}, {"most_drift": 1.5}, {"least_consistency": -0.1}):
        with pytest.raises(ValueError):
            C.Limits(**bad)
    raw, states, evidence = made
    assert C.paper_cycles(states.limit(0), evidence, raw, "doc_id", "text").collect() == []


def test_rounds_need_no_shuffle(made):
    raw, states, _ = made
    rows = states.withColumn("_named", F.expr("cast(null as array<struct<high: boolean, field: string, o: array<string>>>)"))
    plan = C.paper_cycles_in_rows(rows, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan ExistingRDD" not in plan.split("InMemoryRelation")[0]
