"""Tolerant reading of health summaries: every field that has not the expected type falls back by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands where a summary or a check says nothing usable.
UNKNOWN = "unknown"
LISTS = ["required_artifacts_present", "next_recommended_actions", "safety_notes"]
KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "double": ("BIGINT", "DOUBLE", "DECIMAL")}


def typed(raw: Column, path: str, kind: str) -> Column:
    """What stands at a path of a VARIANT if it has the type, else null; an integer is a number."""
    found = F.schema_of_variant(F.try_variant_get(raw, path, "variant"))
    fits = F.substring_index(found, "(", 1).isin(*KINDS[kind])
    return F.when(fits, F.try_variant_get(raw, path, kind))


def is_object(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))


def texts(raw: Column, path: str) -> Column:
    """The texts of the array at a path, other entries left out; empty where there is no array."""
    entries = F.try_variant_get(raw, path, "array<variant>")
    return F.coalesce(F.transform(F.filter(entries, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def entries(raw: Column, path: str) -> Column:
    """The entries of the object at a path as MAP<STRING, STRING> of JSON texts; empty where there is none."""
    inner = F.try_variant_get(raw, path, "variant")
    return F.when(is_object(inner), F.from_json(F.to_json(inner), "map<string,string>"))


def summaries(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, overall_status, generated_at, synthetic, summary_type, the LISTS) of JSON texts; what is no object gives no row.

    Fields of a wrong type, and missing ones, are null, the status `unknown`, lists empty. Repeated ids are rows of their own.
    """
    rows = df.select(id_col, F.try_parse_json(F.col(json_col)).alias("v")).where(is_object(F.col("v")))
    v = F.col("v")
    plain = [typed(v, "$.generated_at", "string").alias("generated_at"), typed(v, "$.synthetic", "boolean").alias("synthetic"), typed(v, "$.summary_type", "string").alias("summary_type")]
    return rows.select(id_col, F.coalesce(typed(v, "$.overall_status", "string"), F.lit(UNKNOWN)).alias("overall_status"), *plain, *(texts(v, f"$.{c}").alias(c) for c in LISTS))


def checks(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, name, key, status, present, required, path, size_bytes): the checks of summaries; one that is no object is unknown and absent."""
    rows = df.select(id_col, F.explode(entries(F.try_parse_json(F.col(json_col)), "$.checks")).alias("name", "json"))
    v = F.col("v")
    read = rows.select(id_col, "name", F.try_parse_json("json").alias("v")).withColumn("ok", is_object(v))
    of = lambda c, kind: typed(v, f"$.{c}", kind)
    return read.select(
        id_col, "name", F.coalesce(of("key", "string"), F.col("name")).alias("key"), F.when(F.col("ok"), of("status", "string")).otherwise(UNKNOWN).alias("status"), F.when(F.col("ok"), of("present", "boolean")).otherwise(False).alias("present"),
        of("required", "boolean").alias("required"), of("path", "string").alias("path"), of("size_bytes", "double").alias("size_bytes"),
    )


def missing_artifacts(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, kind, artifacts): the texts listed as missing under each kind; a kind without a list has none."""
    rows = df.select(id_col, F.explode(entries(F.try_parse_json(F.col(json_col)), "$.missing_artifacts")).alias("kind", "json"))
    return rows.select(id_col, "kind", texts(F.try_parse_json("json"), "$").alias("artifacts"))
