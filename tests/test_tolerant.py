"""Health summaries with every wrong type: each field falls back by itself."""

import json

from foldlog.operators import tolerant as T

DOCS = [
    {"overall_status": "green", "generated_at": "now", "synthetic": True, "summary_type": "s", "safety_notes": ["a", 1, None, "b"], "checks": {"x": {"key": "k", "status": "ok", "present": True, "required": False, "path": "p", "size_bytes": 12}, "y": {"size_bytes": 1.5, "status": 3, "present": "yes"}, "z": [1], "w": None}, "missing_artifacts": {"m": ["q", {}], "n": "no"}},
    {"overall_status": 1, "generated_at": {}, "synthetic": "true", "summary_type": [], "safety_notes": {"a": 1}, "required_artifacts_present": "x", "checks": [1, 2], "missing_artifacts": 5},
    [], None, "text",
]


def test_each_field_falls_back_alone(spark):
    df = spark.createDataFrame([(i, None if d is None else json.dumps(d)) for i, d in enumerate(DOCS)] + [(9, "{broken"), (10, "{}")], "id int, body string")
    rows = {r.id: r for r in T.summaries(df, "id", "body").collect()}
    assert sorted(rows) == [0, 1, 10]
    assert (rows[0].overall_status, rows[0].generated_at, rows[0].synthetic, rows[0].summary_type, rows[0].safety_notes) == ("green", "now", True, "s", ["a", "b"])
    for k in (1, 10):
        assert (rows[k].overall_status, rows[k].generated_at, rows[k].synthetic, rows[k].summary_type) == ("unknown", None, None, None)
        assert rows[k].safety_notes == rows[k].required_artifacts_present == rows[k].next_recommended_actions == []
    got = {(r.id, r.name): tuple(r)[2:] for r in T.checks(df, "id", "body").collect()}
    assert got == {(0, "x"): ("k", "ok", True, False, "p", 12.0), (0, "y"): ("y", None, None, None, None, 1.5), (0, "z"): ("z", "unknown", False, None, None, None), (0, "w"): ("w", "unknown", False, None, None, None)}
    assert {(r.id, r.kind): r.artifacts for r in T.missing_artifacts(df, "id", "body").collect()} == {(0, "m"): ["q"], (0, "n"): []}
