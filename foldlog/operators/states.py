"""Operational states: extraction, compaction under budgets, what survives, and repeated compaction.

A state is a row with an id and one ARRAY<STRING> column a field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.functions.numbers import PROFILES, list_limit
from foldlog.functions.text import coverage, limited, one_space

# Which status an active task is taken from first, and the list length that budgets refer to.
STATUS_ORDER = ["active", "in_progress", "pending", "completed"]
BASE = 12
#: A field survives if so much of it does; a state collapses below this share of surviving fields.
SURVIVES, COLLAPSES = 0.9, 0.5


def clean_list(values: Column) -> Column:
    """Items with single spaces, without empty ones; null counts as no items."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), one_space), lambda x: x != "")


def active_task(tasks: Column) -> Column:
    """Of ARRAY<STRUCT<title, status, ..>> the first task of the foremost status; null where none has a known status."""
    rank = lambda t: F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.lower(F.trim(t["status"])))
    ranked = F.transform(tasks, lambda t, i: F.struct(rank(t).alias("r"), i.alias("i"), t.alias("t")))
    return F.array_min(F.filter(ranked, lambda x: x["r"] > 0))["t"]


def ordered_records(values: Column, fields: list[str]) -> Column:
    """Structs of which all fields hold text, sorted by them."""
    whole = lambda x: F.array_min(F.array(*(F.char_length(F.coalesce(F.trim(x[f]), F.lit(""))) for f in fields))) > 0
    return F.array_sort(F.transform(F.filter(values, whole), lambda x: F.struct(*(F.trim(x[f]).alias(f) for f in fields))))


def compact(states: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Each field cut to the first so many distinct items, sorted."""
    return states.withColumns({f: limited(F.col(f), n) for f, n in budgets.items()})


def budgeted_entities(entities: Column, required: Column) -> Column:
    """All required entities, and of the others the first four fifths (at least one) in alphabetical order."""
    rest = F.sort_array(F.array_except(entities, required))
    return F.sort_array(F.array_union(required, F.slice(rest, 1, F.greatest(F.lit(1), F.bround(F.size(rest) * 0.8).cast("int")))))


def survival(original: DataFrame, replayed: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, a coverage a field, consistency, drift): consistency is the share of fields that survive."""
    right = replayed.select(id_col, *(F.col(f).alias(f"_{f}") for f in fields))
    both = original.join(right, id_col, "left")
    rates = {f"{f}_coverage": F.round(coverage(F.col(f), F.coalesce(F.col(f"_{f}"), F.array().cast("array<string>")), 0.0), 6) for f in fields}
    out = both.select(id_col, *(c.alias(n) for n, c in rates.items()))
    held = sum((F.col(n) >= SURVIVES).cast("int") for n in rates) / len(fields)
    return out.withColumn("consistency", F.round(held, 6)).withColumn("drift", F.round(1 - F.col("consistency"), 6))


def degrade(states: DataFrame, id_col: str, fields: list[str], cycles: int = 3) -> DataFrame:
    """(id, profile, cycle, consistency, drift, collapsed): compaction repeated under each profile.

    A cycle keeps the first items of each list by the profile's share, so the length after a cycle is all that
    the next depends on: lengths are unrolled as columns, and rows are exploded once, profiles x cycles an id.
    """
    sized = states.select(id_col, *(F.size(f).alias(f) for f in fields))
    rows = []
    for name, params in PROFILES.items():
        lengths = {f: F.col(f) for f in fields}
        for cycle in range(1, cycles + 1):
            lengths = {f: list_limit(n, params[1], BASE) for f, n in lengths.items()}
            held = sum(((n >= F.col(f) * SURVIVES) & (F.col(f) > 0)).cast("int") for f, n in lengths.items()) / len(fields)
            rows.append(F.struct(F.lit(name).alias("profile"), F.lit(cycle).cast("long").alias("cycle"), F.round(held, 6).alias("consistency")))
    out = sized.select(id_col, F.explode(F.array(*rows)).alias("r")).select(id_col, "r.*")
    return out.withColumns({"drift": F.round(1 - F.col("consistency"), 6), "collapsed": F.col("consistency") < COLLAPSES})


def degradation_summary(runs: DataFrame, id_col: str) -> DataFrame:
    """Per profile over the last cycle of each run: runs, share collapsed, mean consistency; and the last cycle before which none collapsed."""
    last = runs.groupBy("profile", id_col).agg(F.max_by("consistency", "cycle").alias("consistency"), F.max_by("collapsed", "cycle").alias("collapsed"), F.min(F.when(F.col("collapsed"), F.col("cycle"))).alias("at"))
    return last.groupBy("profile").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("collapsed").cast("double")), 6).alias("collapse_rate"), F.round(F.avg("consistency"), 6).alias("consistency"), F.max("at").alias("highest_collapse_cycle"))
