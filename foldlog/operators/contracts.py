"""Contracts: which rules a JSON document breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a value of a type looks like as JSON text.
SHAPES = {"integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "boolean": "^(true|false)$", "string": '^".*"$', "object": r"(?s)^\{.*\}$", "array": r"(?s)^\[.*\]$", "null": "^null$"}


def violations(df: DataFrame, id_col: str, json_col: str, rules: list[tuple[str, str, bool]], additional: bool = True) -> DataFrame:
    """(id, path, problem) of documents that break rules (key, types joined by "|", required) at their top level.

    Problems: `invalid` for text that is no JSON object, `missing`, `type`, and, unless additional keys are
    allowed, `unknown`. Values are compared as JSON text, so a number in quotes is a string.
    """
    entries = F.from_json(json_col, "map<string,string>")
    raw = F.try_parse_json(F.col(json_col))
    value = lambda k: F.to_json(F.try_variant_get(raw, f"$.{k}", "variant"))

    def broken(key: str, types: str, required: bool) -> list[Column]:
        v = value(key)
        shape = "|".join(SHAPES[t] for t in types.split("|"))
        there = F.coalesce(F.array_contains(F.map_keys(entries), key), F.lit(False))
        out = [F.when(there & ~F.coalesce(v, F.lit("null")).rlike(shape), F.struct(F.lit(key).alias("path"), F.lit("type").alias("problem")))]
        return out + ([F.when(~there, F.struct(F.lit(key).alias("path"), F.lit("missing").alias("problem")))] if required else [])

    known = [k for k, _, _ in rules]
    found = F.array_compact(F.array(*(x for r in rules for x in broken(*r))))
    if not additional:
        found = F.concat(found, F.transform(F.filter(F.map_keys(entries), lambda k: ~k.isin(known)), lambda k: F.struct(k.alias("path"), F.lit("unknown").alias("problem"))))
    bad = F.array(F.struct(F.lit("").alias("path"), F.lit("invalid").alias("problem")))
    is_object = F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))
    return df.select(F.col(id_col), F.explode(F.when(is_object, found).otherwise(bad)).alias("v")).select(id_col, "v.path", "v.problem")


def event_problems(df: DataFrame, id_col: str, types: list[str], type_col: str, counts: list[str], payload_col: str, longest: int = 4096) -> DataFrame:
    """(id, problem) of events of an unknown type, with a negative or missing count, or too long a payload."""
    rules = [F.when(~F.coalesce(F.col(type_col).isin(types), F.lit(False)), F.lit("type"))]
    rules += [F.when(F.coalesce(F.col(c) < 0, F.lit(True)), F.lit(c)) for c in counts]
    rules += [F.when(F.char_length(payload_col) > longest, F.lit("payload"))]
    return df.select(F.col(id_col), F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def integrity_problems(ids: DataFrame, mapped: DataFrame, unmapped: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids that are in neither or both of mapped and unmapped, and members of these that are no ids.

    One grouping of three tagged tables instead of anti-joins in each direction.
    """
    tag = lambda df, a, b, c: df.select(key, F.lit(a).alias("known"), F.lit(b).alias("m"), F.lit(c).alias("u"))
    each = tag(ids, 1, 0, 0).unionByName(tag(mapped, 0, 1, 0)).unionByName(tag(unmapped, 0, 0, 1))
    held = each.groupBy(key).agg(F.max("known").alias("known"), F.max("m").alias("m"), F.max("u").alias("u"))
    problem = F.when(F.col("known") == 0, "unknown").when((F.col("m") == 1) & (F.col("u") == 1), "both").when((F.col("m") == 0) & (F.col("u") == 0), "neither")
    return held.select(key, problem.alias("problem")).where("problem is not null")
