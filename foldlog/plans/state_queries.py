"""Queries over conversations as operational states, and over JSON contracts, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.functions.text import words
from foldlog.operators.contracts import event_problems, integrity_problems, violations
from foldlog.operators.schemas import compiled, nested_violations
from foldlog.operators.states import compact, degradation_summary, degrade, survival
from foldlog.operators.tolerant import checks, summaries
from foldlog.session import spread, table

FIELDS = ["system", "user", "assistant"]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation and role: the distinct words of the role's first turn, sorted."""
    c = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    first = c.groupBy("conv_id").agg(*(F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn"))).alias(r) for r in FIELDS))
    return first.select("conv_id", *(F.coalesce(F.sort_array(F.array_distinct(words(F.col(r)))), none).alias(r) for r in FIELDS))


def state_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    return survival(s, compact(s, {"system": 20, "user": 15, "assistant": 25}), "conv_id", FIELDS)


def state_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrade(states(spark, sf_dir), "conv_id", FIELDS)


def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degradation_summary(degrade(states(spark, sf_dir), "conv_id", FIELDS), "conv_id")


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, some of them spoilt, against a contract of an integer k and nothing else."""
    e = table(spark, sf_dir, "events")
    spoilt = F.when(F.col("event_id") % 11 == 0, F.replace("props", F.lit('"k"'), F.lit('"q"'))).when(F.col("event_id") % 13 == 0, F.regexp_replace("props", r": (\d+)", ': "$1"')).when(F.col("event_id") % 17 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return violations(e.select("event_id", spoilt.alias("json")), "event_id", "json", [("k", "integer", True)], additional=False)


def nested_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested documents of two schemas, spoilt at every level, against rules compiled from the schemas' text."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    text = F.concat(
        F.lit('{"id":'), F.when(n % 11 == 1, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string")), F.when(n % 13 == 2, "").otherwise(F.concat(F.lit(',"kind":"'), "event_type", F.lit('"'))), F.lit(',"metrics":{"value":'), F.when(n % 7 == 3, "null").otherwise(F.format_string("%.2f", "value")),
        F.when(n % 17 == 4, ',"odd":1').otherwise(""), F.lit(',"props":'), F.when(n % 19 == 5, "[]").otherwise(F.col("props")), F.lit("}"), F.when(n % 23 == 6, ',"more":{}').otherwise(""), F.when(n % 29 == 7, "").otherwise("}"),
    )
    props = {"type": "object", "required": ["k", "j"], "properties": {"k": {"type": "integer"}, "j": {"type": "string"}}}
    schema = lambda closed, props: json.dumps({"title": "t", "description": "d", "type": "object", "required": ["id", "kind"], "additionalProperties": not closed, "properties": {"id": {"type": "integer"}, "kind": {"type": "string"}, "metrics": {"type": "object", "required": ["value"], "additionalProperties": False, "properties": {"value": {"type": "number"}, "props": props}}}})
    schema_of = F.when(n % 2 == 0, "open").otherwise("closed").alias("schema")
    named = spread(e.select("event_id", "event_type", "value", "props"), "event_id").select("event_id", schema_of, text.alias("json"))
    texts = F.when(F.col("schema") == "open", schema(False, {"type": ["object", "array"]})).otherwise(schema(True, props))
    rules = compiled(e.select(schema_of).distinct().withColumn("json", texts), "schema", "json")
    return nested_violations(named, rules, "event_id", "schema", "json")


def health_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A health summary of each user as JSON text, with checks of their event types; by the user's number fields have wrong types."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    k = F.col("user_id")
    check = F.when((k + F.col("n")) % 5 == 0, F.concat(F.lit('"'), "event_type", F.lit('":[1]'))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('":{"key":'), F.when(k % 3 == 0, "7").otherwise(F.concat(F.lit('"c-'), "event_type", F.lit('"'))), F.lit(',"present":'), F.when(k % 4 == 1, '"yes"').otherwise((F.col("n") > 3).cast("string")), F.lit(',"size_bytes":'), F.when(k % 7 == 2, "null").otherwise(F.col("n").cast("string")), F.lit(',"status":"s"}')))
    each = e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(check)), ",").alias("cs"), F.sum("n").alias("n"))
    status = F.when(k % 6 == 1, "3").when(k % 6 == 2, "null").otherwise(F.concat(F.lit('"st-'), k % 2, F.lit('"')))
    notes = F.when(k % 5 == 3, '"note"').otherwise(F.concat(F.lit('["a",'), k, F.lit(',"b'), k, F.lit('",null]')))
    text = F.concat(F.lit('{"overall_status":'), status, F.lit(',"synthetic":'), F.when(k % 2 == 0, "true").otherwise("1"), F.lit(',"safety_notes":'), notes, F.lit(',"checks":{'), "cs", F.when(k % 11 == 4, "").otherwise("}}"))
    return each.select("user_id", text.alias("json"))


def tolerant_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(health_texts(spark, sf_dir), "user_id", "json").select("user_id", "overall_status", "synthetic", F.array_join("safety_notes", ",").alias("notes"))


def tolerant_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(health_texts(spark, sf_dir), "user_id", "json").select("user_id", "name", "key", "status", "present", "size_bytes")


def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against a list of types that lacks one, a value that must be at least 5, and short properties."""
    e = table(spark, sf_dir, "events").withColumn("above", F.floor(F.col("value") - 5).cast("long"))
    return event_problems(e, "event_id", ["click", "view", "purchase", "signup"], "event_type", ["above"], "props", 8)


def mapping_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps; those of odd priority marks are mapped, the others not, some both, some neither, some unknown."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    mapped = o.where((k % 2 == 1) & (k % 70 != 1) | (k % 50 == 0)).unionByName(o.where(k % 90 == 2).select((-k - 1).alias("o_orderkey")))
    return integrity_problems(o, mapped, o.where(k % 2 == 0), "o_orderkey")


STATES = r"""t AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS s, arg_min(text, turn) FILTER (WHERE role = 'user') AS u, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY 1),
n AS (SELECT conv_id, CAST(len(list_distinct(list_transform(regexp_extract_all(coalesce(s, ''), '[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*'), lambda x: lower(x)))) AS DOUBLE) AS s, CAST(len(list_distinct(list_transform(regexp_extract_all(coalesce(u, ''), '[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*'), lambda x: lower(x)))) AS DOUBLE) AS u, CAST(len(list_distinct(list_transform(regexp_extract_all(coalesce(a, ''), '[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*'), lambda x: lower(x)))) AS DOUBLE) AS a FROM t)"""
RUNS = (
    STATES
    + """, p AS (SELECT * FROM (VALUES ('CONSERVATIVE', 12.0::DOUBLE), ('BALANCED', 8.0), ('AGGRESSIVE', 5.0)) x(profile, k)),
l AS (SELECT conv_id, profile, k, s, u, a, 0::BIGINT AS cycle, s AS ls, u AS lu, a AS la FROM n, p
  UNION ALL SELECT conv_id, profile, k, s, u, a, cycle + 1, least(ls, greatest(1, ceil(ls * k / 12))), least(lu, greatest(1, ceil(lu * k / 12))), least(la, greatest(1, ceil(la * k / 12))) FROM l WHERE cycle < 3),
r AS (SELECT conv_id, profile, cycle, round((CASE WHEN ls >= s * 0.9::DOUBLE AND s > 0 THEN 1 ELSE 0 END + CASE WHEN lu >= u * 0.9::DOUBLE AND u > 0 THEN 1 ELSE 0 END + CASE WHEN la >= a * 0.9::DOUBLE AND a > 0 THEN 1 ELSE 0 END) / 3.0::DOUBLE, 6) AS consistency FROM l WHERE cycle > 0)"""
)

QUERIES = {"state_survival": state_survival, "state_degradation": state_degradation, "state_summary": state_summary, "contract_violations": contract_violations, "nested_contracts": nested_contracts, "tolerant_summaries": tolerant_summaries, "tolerant_checks": tolerant_checks, "event_validation": event_validation, "mapping_integrity": mapping_integrity}

ORACLE_SQL = {
    "tolerant_summaries": "SELECT DISTINCT user_id, CASE WHEN user_id % 6 IN (1, 2) THEN 'unknown' ELSE 'st-' || (user_id % 2) END AS overall_status, CASE WHEN user_id % 2 = 0 THEN true END AS synthetic, CASE WHEN user_id % 5 = 3 THEN '' ELSE 'a,b' || user_id END AS notes FROM events WHERE user_id % 11 <> 4",
    "tolerant_checks": """WITH e AS (SELECT user_id AS k, event_type AS t, count(*) AS n FROM events WHERE user_id % 11 <> 4 GROUP BY ALL) SELECT k AS user_id, t AS name, CASE WHEN (k + n) % 5 = 0 OR k % 3 = 0 THEN t ELSE 'c-' || t END AS key, CASE WHEN (k + n) % 5 = 0 THEN 'unknown' ELSE 's' END AS status,
  CASE WHEN (k + n) % 5 = 0 THEN false WHEN k % 4 = 1 THEN NULL ELSE n > 3 END AS present, CASE WHEN (k + n) % 5 = 0 OR k % 7 = 2 THEN NULL ELSE CAST(n AS DOUBLE) END AS size_bytes FROM e""",
    "nested_contracts": """WITH e AS (SELECT event_id AS n, event_id % 29 = 7 AS cut, event_id % 2 = 1 AS closed FROM events) SELECT n AS event_id, '' AS path, 'invalid' AS problem FROM e WHERE cut
UNION ALL SELECT n, 'id', 'type' FROM e WHERE NOT cut AND n % 11 = 1 UNION ALL SELECT n, 'kind', 'missing' FROM e WHERE NOT cut AND n % 13 = 2 UNION ALL SELECT n, 'metrics.value', 'type' FROM e WHERE NOT cut AND n % 7 = 3
UNION ALL SELECT n, 'metrics.odd', 'unknown' FROM e WHERE NOT cut AND n % 17 = 4 UNION ALL SELECT n, 'metrics.props', 'type' FROM e WHERE NOT cut AND closed AND n % 19 = 5
UNION ALL SELECT n, 'metrics.props.j', 'missing' FROM e WHERE NOT cut AND closed AND n % 19 <> 5 UNION ALL SELECT n, 'more', 'unknown' FROM e WHERE NOT cut AND closed AND n % 23 = 6""",
    "state_survival": f"WITH {STATES}, c AS (SELECT conv_id, round(CASE WHEN s = 0 THEN 0.0 ELSE least(s, 20) / s END, 6) AS x, round(CASE WHEN u = 0 THEN 0.0 ELSE least(u, 15) / u END, 6) AS y, round(CASE WHEN a = 0 THEN 0.0 ELSE least(a, 25) / a END, 6) AS z FROM n), d AS (SELECT *, round((CASE WHEN x >= 0.9 THEN 1 ELSE 0 END + CASE WHEN y >= 0.9 THEN 1 ELSE 0 END + CASE WHEN z >= 0.9 THEN 1 ELSE 0 END) / 3.0::DOUBLE, 6) AS consistency FROM c) SELECT conv_id, x AS system_coverage, y AS user_coverage, z AS assistant_coverage, consistency, round(1 - consistency, 6) AS drift FROM d",
    "state_degradation": f"WITH RECURSIVE {RUNS} SELECT conv_id, profile, cycle, consistency, round(1 - consistency, 6) AS drift, consistency < 0.5 AS collapsed FROM r",
    "state_summary": f"WITH RECURSIVE {RUNS}, q AS (SELECT profile, conv_id, arg_max(consistency, cycle) AS consistency, min(cycle) FILTER (WHERE consistency < 0.5) AS c FROM r GROUP BY ALL) SELECT profile, count(*) AS runs, round(avg(CASE WHEN consistency < 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS collapse_rate, round(avg(consistency), 6) AS consistency, max(c) AS highest_collapse_cycle FROM q GROUP BY 1",
    "event_validation": "SELECT event_id, 'type' AS problem FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'above' FROM events WHERE value < 5 UNION ALL SELECT event_id, 'payload' FROM events WHERE length(props) > 8",
    "mapping_integrity": "SELECT o_orderkey, 'both' AS problem FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_orderkey, 'neither' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 70 = 1 UNION ALL SELECT -o_orderkey - 1, 'unknown' FROM orders WHERE o_orderkey % 90 = 2",
    "contract_violations": "SELECT event_id, 'k' AS path, 'missing' AS problem FROM events WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 'q', 'unknown' FROM events WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 'k', 'type' FROM events WHERE event_id % 11 <> 0 AND event_id % 13 = 0 UNION ALL SELECT event_id, '', 'invalid' FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 = 0",
}
