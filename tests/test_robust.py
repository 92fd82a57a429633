"""Inputs that once went wrong: ids beside nulls, deep JSON, long texts in payloads, findings without an order, other folders."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldlog.functions import json_text as J
from foldlog.operators import records as R
from foldlog.operators.references import budget_select

ROOT = Path(__file__).resolve().parents[1]


def one(spark, expression):
    return spark.range(1).select(expression.alias("y")).first().y


def test_ids_beside_nulls_stay_exact(spark):
    big = 2**60 + 1
    rows = [(big, 1, 0.9, 60), (big, 2, 0.8, 50), (big, big, 0.7, 40), (None, 3, 0.9, 100), (None, 4, 0.1, 1), (big, 5, 0.6, None)]
    got = budget_select(spark.createDataFrame(rows, "g long, id long, relevance double, tokens long"), "g", 100).collect()
    assert {(r.g, r.id): r.taken for r in got} == {(big, 1): True, (big, 2): False, (big, big): True, (big, 5): False, (None, 3): True, (None, 4): False}


@pytest.mark.parametrize("levels", [3_000, 10_000, 200_000])
def test_deep_json(spark, levels):
    deep = '{"a":[' * (levels // 2) + '{"rawPayload":1}' + "]}" * (levels // 2)
    df = spark.createDataFrame([(deep,), (deep + "]",), (deep[:-1],), ("[" * levels,)], "t string")
    rows = df.select(J.first_unsafe_path(F.col("t")).alias("p"), J.canonical_json(F.col("t"), volatile=True).alias("c"), F.char_length(J.canonical_json(F.col("t"), digits=6)).alias("n")).collect()
    assert rows[0].p == ".".join(["a[0]"] * (levels // 2)) + ".rawPayload" and rows[0].n == len(deep)
    assert rows[0].c == '{"a":[' * 4 + '{"a":"[MAX_DEPTH_EXCEEDED]"}' + "]}" * 4
    assert all(r.p is None and r.c is None for r in rows[1:])


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(-1e9, 1e9) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_written_is_sorted_json(value):
    assert J.written(value, False, 6, False) == json.dumps(json.loads(json.dumps(value), parse_float=lambda x: round(float(x), 6)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@settings(max_examples=200, deadline=None)
@given(JSON, st.integers(0, 60), st.sampled_from(["", "]", ",", "x", '"']))
def test_reader_with_a_stack_is_the_librarys(value, cut, junk):
    deep = "[" * 30_000 + json.dumps(value, indent=1) + "]" * 30_000
    got = J.read(deep)
    for _ in range(30_000):
        (got,) = got
    assert got == json.loads(json.dumps(value))
    if junk or cut:
        spoilt = "[" * 30_000 + json.dumps(value)[:cut] + junk + "]" * 30_000
        try:
            json.loads(json.dumps(value)[:cut] + junk)
        except ValueError:
            if (json.dumps(value)[:cut] + junk).strip() and "]" not in junk and "," not in junk:
                with pytest.raises(ValueError):
                    J.read(spoilt)


def test_long_texts_become_hash_and_length(spark):
    long, just = "é" * 1025, "x" * 1024
    got = json.loads(one(spark, J.canonical_json(F.lit(json.dumps({"b": long, "a": just, "😀": "😀" * 513})))))
    assert got["a"] == just and got["b"] == f"[TRUNCATED_STRING_HASH_{J.short_hash(long)}_LENGTH_1025]" and got["😀"].endswith("_LENGTH_1026]")
    assert J.short_hash("a") == "e40c292c" and J.short_hash("") == "811c9dc5"
    assert len(one(spark, J.canonical_json(F.lit(json.dumps([long])), digits=6))) == 1029


def test_a_finding_without_order_is_kept(spark):
    rows = [("d", None, "HIGH", "b"), ("d", 5, "LOW", "a"), ("d", None, None, "c")]
    got = R.enriched_findings(spark.createDataFrame(rows, "d string, at int, level string, kind string"), "d", "at", "level", "kind").collect()
    assert {(r.id, r.severity) for r in got} == {("FND-D-001", "LOW"), ("FND-D-002", "HIGH"), ("FND-D-003", "INFO")}


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").config("spark.local.dir", {str(tmp_path)!r}).getOrCreate()
from foldlog.functions.json_text import canonical_json
from foldlog.session import ship
ship(spark)
assert spark.range(3).select(canonical_json(F.lit('{{"b":1,"a":2}}')).alias("c")).distinct().first().c == '{{"a":2,"b":1}}'
print("found")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "found" in said.stdout, said.stderr[-2000:]
