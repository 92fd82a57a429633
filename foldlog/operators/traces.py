"""Agent traces: their operational state, a compact form of it, its replay, and what of it survived.

A trace is JSON text; a state is a row with a name, a task, lists of texts and a list of dependency records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.functions.numbers import failure_labels
from foldlog.functions.text import coverage, normalized, one_space, word_count
from foldlog.operators.audit import evidence_survival
from foldlog.operators.states import STATUS_ORDER, clean_list

# The shape of a trace, the fields of a state and their short keys.
TRACE = (
    "trace string, tasks array<struct<id: string, title: string, details: string, status: string>>, constraints array<string>, architecture_references array<struct<node: string, role: string>>, "
    "dependencies array<struct<id: string, `from`: string, `to`: string, type: string, detail: string>>, tool_calls array<struct<`index`: int, tool: string, command: string, result: string>>, "
    "unresolved_blockers array<string>, deployment_requirements array<string>, recoveries array<string>"
)
SHORT = {"active_task": "a", "architecture_nodes": "ar", "unresolved_blockers": "b", "constraints": "c", "dependencies": "d", "deployment_requirements": "dr", "recovery_actions": "r", "tool_sequence": "t"}
AVERAGES = ["blocker_survival_rate", "compression_ratio", "constraint_survival_rate", "dependency_survival_rate", "evidence_survival_rate", "high_critical_evidence_survival_rate", "operational_drift_rate", "replay_consistency", "tool_sequence_survival_rate"]
RATES = {"blocker": "unresolved_blockers", "constraint": "constraints", "dependency": "dependencies", "tool_sequence": "tool_sequence"}

_none = lambda kind: F.array().cast(f"array<{kind}>")


def by_letters(values: Column) -> Column:
    """Texts in alphabetical order, letters of either case alike; of equal ones the first stays first."""
    keyed = F.transform(values, lambda x, i: F.struct(F.lower(x).alias("l"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


def tool_sequence(calls: Column) -> Column:
    """tool::command::result of whole calls, by their index."""
    placed = F.transform(F.coalesce(calls, F.array()), lambda c, i: F.struct(F.coalesce(c["index"], F.lit(0)).alias("k"), i.alias("i"), F.array(*(one_space(c[f]) for f in ("tool", "command", "result"))).alias("parts")))
    whole = F.filter(F.sort_array(placed), lambda s: ~F.array_contains(s["parts"], ""))
    return F.transform(whole, lambda s: F.array_join(s["parts"], "::"))


def nodes(references: Column) -> Column:
    pairs = F.transform(F.coalesce(references, F.array()), lambda r: F.array(one_space(r["node"]), one_space(r["role"])))
    return by_letters(F.transform(F.filter(pairs, lambda p: ~F.array_contains(p, "")), lambda p: F.array_join(p, ": ")))


def dependencies(records: Column) -> Column:
    """Whole records, by id, from and to; keys in name order."""
    names = ["detail", "from", "id", "to", "type"]
    clean = F.transform(F.coalesce(records, F.array()), lambda r: F.struct(*(one_space(r[n]).alias(n) for n in names)))
    whole = F.filter(clean, lambda r: reduce(lambda a, b: a & b, [r[n] != "" for n in names]))
    keyed = F.transform(whole, lambda r, i: F.struct(F.lower(r["id"]).alias("a"), F.lower(r["from"]).alias("b"), F.lower(r["to"]).alias("c"), i.alias("i"), r.alias("r")))
    return F.transform(F.sort_array(keyed), lambda s: s["r"])


def task_text(tasks: Column) -> Column:
    """Id, title and details of the first task of the foremost status; null without such a task."""
    rank = lambda t: F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.lower(one_space(t["status"])))
    ranked = F.transform(tasks, lambda t, i: F.struct(rank(t).alias("k"), i.alias("i"), one_space(F.concat_ws(" ", *(F.coalesce(t[f], F.lit("")) for f in ("id", "title", "details")))).alias("x")))
    return F.array_min(F.filter(ranked, lambda s: s["k"] > 0))["x"]


def agent_states(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, trace, a column a field) of traces as JSON text; what is no trace has null and empty fields."""
    read = df.select(id_col, F.from_json(json_col, TRACE).alias("x"))
    texts = lambda c: by_letters(clean_list(F.col(f"x.{c}")))
    return read.select(
        id_col, one_space(F.col("x.trace")).alias("trace"), task_text(F.col("x.tasks")).alias("active_task"), nodes(F.col("x.architecture_references")).alias("architecture_nodes"), texts("unresolved_blockers").alias("unresolved_blockers"),
        texts("constraints").alias("constraints"), dependencies(F.col("x.dependencies")).alias("dependencies"), texts("deployment_requirements").alias("deployment_requirements"), texts("recoveries").alias("recovery_actions"), tool_sequence(F.col("x.tool_calls")).alias("tool_sequence"),
    )


def compact_text(states: DataFrame, id_col: str) -> DataFrame:
    """(id, compact): the state under short keys, as JSON with sorted keys."""
    fields = F.struct(*(F.col(f).alias(k) for f, k in sorted(SHORT.items(), key=lambda x: x[1])))
    return states.select(id_col, F.to_json(F.struct(fields.alias("f"), F.lit(1).alias("v"), F.col("trace").alias("x")), {"ignoreNullFields": "false"}).alias("compact"))


def replayed(compact: DataFrame, id_col: str) -> DataFrame:
    """The states that compact texts hold."""
    kinds = {"active_task": "string", "dependencies": "array<struct<detail: string, `from`: string, id: string, `to`: string, type: string>>"}
    shape = "f struct<" + ", ".join(f"{k}: {kinds.get(f, 'array<string>')}" for f, k in SHORT.items()) + ">, v int, x string"
    read = compact.select(id_col, F.from_json("compact", shape).alias("s"))
    return read.select(id_col, F.col("s.x").alias("trace"), *(F.col(f"s.f.{k}").alias(f) for f, k in SHORT.items()))


def survived(field: str, original: Column, again: Column) -> Column:
    """Whether a field is there and came back as it was."""
    there = original != "" if field == "active_task" else F.size(original) > 0
    return F.coalesce(there & (original == again), F.lit(False))


def survival_rates(original: DataFrame, again: DataFrame, id_col: str) -> DataFrame:
    """(id, a survival rate of each of the RATES lists, replay_consistency, operational_drift_rate)."""
    right = again.select(id_col, *(F.col(f).alias(f"_{f}") for f in SHORT), F.lit(True).alias("_there"))
    both = original.join(right, id_col, "left")
    held = reduce(lambda a, b: a + b, [survived(f, F.col(f), F.col(f"_{f}")).cast("int") for f in SHORT])
    rate = lambda f: F.round(coverage(F.col(f), F.coalesce(F.col(f"_{f}"), F.slice(F.col(f), 1, 0)), 0.0), 6)
    rows = both.where("_there").select(id_col, *(rate(f).alias(f"{k}_survival_rate") for k, f in RATES.items()), F.round(held / len(SHORT), 6).alias("replay_consistency"))
    return rows.withColumn("operational_drift_rate", F.round(1 - F.col("replay_consistency"), 6))


def field_texts(states: DataFrame, id_col: str) -> DataFrame:
    """(id, field, value): each field of a state as text; lists as JSON."""
    shown = lambda f: F.col(f) if f == "active_task" else F.to_json(F.struct(F.col(f).alias("x")))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), shown(f).alias("value")) for f in SHORT)))
    return states.select(id_col, rows.alias("x")).select(id_col, "x.*")


def agent_evidence(evidence: DataFrame, original: DataFrame, again: DataFrame, id_col: str) -> DataFrame:
    """evidence_survival() of locators `event:field`: both sides are the field, alike but for blanks and case.

    evidence: (id, evidence_id, locator, criticality). Other locators, and fields that are not there, find nothing.
    """
    named = evidence.where(F.trim("locator").startswith("event:")).select(id_col, "evidence_id", F.replace(F.trim("locator"), F.lit("event:"), F.lit("")).alias("field"))
    side = lambda states: named.join(field_texts(states, id_col), [id_col, "field"]).select(id_col, "evidence_id", "value")
    return evidence_survival(evidence, side(original), side(again), id_col, normalized(F.col("o")) == normalized(F.col("r")))


def validation(original: DataFrame, again: DataFrame, compact: DataFrame, raw: DataFrame, id_col: str, json_col: str, evidence: DataFrame | None = None) -> DataFrame:
    """A row a trace: survival rates of its lists, consistency and drift over its fields, tokens before and after.

    With evidence also what survived of it, and the labels of what was lost; without evidence of a trace its rates are 0, its flags false.
    """
    fields = F.struct(*(F.col(f) for f in sorted(SHORT)))
    replay = again.select(id_col, word_count(F.to_json(F.struct(fields.alias("operational_fields"), "trace"), {"ignoreNullFields": "false"})).alias("replay_token_count"))
    sizes = compact.select(id_col, word_count(F.col("compact")).alias("compact_token_count"))
    rows = survival_rates(original, again, id_col).join(sizes, id_col).join(replay, id_col).join(raw.select(id_col, word_count(F.col(json_col)).alias("original_token_count")), id_col)
    ratio = F.when(F.col("compact_token_count") > 0, F.round(F.col("original_token_count") / F.col("compact_token_count"), 6)).otherwise(0.0)
    rows = rows.withColumn("compression_ratio", ratio)
    if evidence is None:
        return rows
    of = lambda c, none, name: F.coalesce(F.col(c), F.lit(none)).alias(name)
    kept = rows.columns
    rows = rows.join(agent_evidence(evidence, original, again, id_col), id_col, "left").select(*kept, of("evidence_survival_rate", 0.0, "evidence_survival_rate"), of("high_survival_rate", 0.0, "high_critical_evidence_survival_rate"), of("evidence_survived", 0, "evidence_survived"), of("evidence_total", 0, "evidence_total"), F.col("evidence_total").isNotNull().alias("has_evidence"), of("has_high", False, "has_high_critical_evidence"))
    labels = failure_labels(F.col("has_evidence"), F.col("evidence_survived"), F.col("evidence_total"), F.col("evidence_survival_rate"), F.col("has_high_critical_evidence"), F.col("high_critical_evidence_survival_rate"), F.col("constraint_survival_rate"), F.col("blocker_survival_rate"))
    return rows.withColumn("failure_labels", labels)
