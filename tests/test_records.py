"""Canonical JSON, unsafe keys, source hashes and findings, case by case."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foldlog.functions import json_text as J
from foldlog.functions.hashing import VOLATILE
from foldlog.operators import records as R
from foldlog.operators.frame import frames
from foldlog.operators.parse import parse_lines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_canonical_json(spark):
    deep = {"b": [{"pid": 4, "z": 1.5, "a": None}], "é": "x", "A": True, **dict.fromkeys(VOLATILE, 7)}
    got = json.loads(one(spark, J.canonical_json(F.lit(json.dumps(deep)), volatile=True)))
    assert got == {"b": [{"pid": VOLATILE["pid"], "z": 1.5, "a": None}], "é": "x", "A": True, **VOLATILE} and list(got) == sorted(got)
    assert one(spark, J.canonical_json(F.lit('{"b": 0.1234567, "a": [NaN, -Infinity]}'), digits=3)) == '{"a":["[NON_FINITE_NUMBER_NAN]","[NON_FINITE_NUMBER_NEGATIVE_INFINITY]"],"b":0.123}'
    assert one(spark, J.canonical_json(F.lit("no json"))) is None and one(spark, J.canonical_json(F.lit(None).cast("string"))) is None
    nested = "[" * 12 + "1" + "]" * 12
    assert J.TOO_DEEP in one(spark, J.canonical_json(F.lit(nested)))
    assert one(spark, J.stable_hash(F.lit("a"))) == "fnv1a:e40c292c"


def test_unsafe_paths_and_string_arrays(spark):
    at = lambda v: one(spark, J.first_unsafe_path(F.lit(json.dumps(v))))
    assert at({"a": [{"b": {"rawPayload": 1}}]}) == "a[0].b.rawPayload" and at({"body": 1}) is None and at({"metadata": {"x": {"content": 1}}}) == "metadata.x.content"
    refs = lambda v: one(spark, J.string_array(F.lit(json.dumps({"r": v})), "r"))
    assert refs(["a", "b"]) == ["a", "b"] and refs(["a", 1]) == refs("a") == refs(None) == []


def test_source_hash_stands_in_both_frames(spark):
    rows = [("a", 2, "INFO CPC ok"), ("a", 1, "ERROR ABS P0301 brake"), ("b", 1, "x=1"), ("b", 2, None), *(("c", k, "ERROR ABS P0301 brake") for k in range(5))]
    lines = spark.createDataFrame(rows, "log_id string, line_no int, raw string")
    got = {r.log_id: r.fp for r in R.source_hashes(lines).collect()}
    want = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16].upper()
    assert got == {"a": want("ERROR ABS P0301 brake\nINFO CPC ok"), "b": want("x=1\n"), "c": want("\n".join(["ERROR ABS P0301 brake"] * 5))}
    payloads = {r.log_id: r.payload for r in frames(parse_lines(lines.where("raw is not null")), hashes=R.source_hashes(lines)).collect()}
    assert f"|{got['a']}|" in payloads["a"] and json.loads(payloads["c"])["h"]["fp"] == got["c"]
    assert R.source_hashes(lines.limit(0)).count() == 0


def test_findings_are_numbered_in_order(spark):
    rows = [("a.b", k, "HIGH" if k % 2 else None, "lost_event") for k in range(0, 9000, 30)]
    got = R.enriched_findings(spark.createDataFrame(rows, "d string, at int, level string, kind string"), "d", "at", "level", "kind").collect()
    assert sorted(r.id for r in got) == sorted(f"FND-A-B-{k + 1:03d}" for k in range(300)) and {r.title for r in got} == {"Lost Event"}
    assert {r.owner for r in got if r.severity == "INFO"} == {"Validation SRE"}


def test_texts_and_reasons(spark):
    assert one(spark, R.rate_text(F.lit(0.5))) == "0.500000" and one(spark, R.rate_text(F.lit(float("nan")))) == "N/A"
    reason = lambda labels, replay: one(spark, R.collapse_reason(F.array(*map(F.lit, labels)), ["A"], F.lit(replay), 0.5, F.lit(True), F.lit(1.0), 1.0, F.lit(0.9), 0.5))
    assert reason(["B", "A"], 0.1) == "fatal_failure_mode:A" and reason(["B"], 0.1) == "min_replay_consistency" and reason(["B"], 0.9) == "max_operational_drift_rate"
    assert one(spark, R.reference_id(F.lit("mem"), F.lit("fnv1a:12ab-34cd-56ef-78"))) == "mem-ab34cd56ef78"
    assert one(spark, R.request_id(F.lit(" a.b-1 "))) == "a.b-1" and one(spark, R.request_id(F.lit("a b"))) is None


def test_canonical_text_is_the_walks_text():
    long = J.LONGEST - 1
    texts = [
        '{"pid": [1], "b": {"uptime": {"pid": 3}, "a": 1.0}, "a": [2.50, -0.0, 1e21, 1e400, NaN, 12345678901234567890, true, null, "\\ud83d\\ude00", "\\u00e9\\""]}', "[]", "{}", '"x"', "1.5", '[{"pid": 1, "pid": 2, "": 0}]',
        "[" * 8 + "1" + "]" * 8, "[" * 9 + "1" + "]" * 9, "[" * 10 + "1" + "]" * 10, *(json.dumps([c * n, 1], ensure_ascii=e) for c in ("x", "é", "😀", '"') for n in (long // 2, long // 2 + 2, long, long + 1, long + 2) for e in (True, False)),
    ]
    for t in texts:
        for volatile, digits in ((True, None), (False, None), (True, 3), (False, 3)):
            assert J.canonical_text(volatile, digits, digits is None)(t) == J.written(J.read(t), volatile, digits, digits is None), t[:50]
    with pytest.raises(ValueError):
        J.canonical_text(True, None, True)("{1")


def test_plain_payloads_are_not_walked(monkeypatch):
    monkeypatch.setattr(J, "written", None)
    keys = {k: "1" for k in J.VOLATILE}
    assert J.canonical_text(True, None, True)(json.dumps({"steps": [keys], **keys, "a": 1.0})).startswith('{"a":1,"createdAt":"[TIMESTAMP_STRIPPED]"')
