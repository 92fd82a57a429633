"""Execution timelines: summaries, running snapshots, comparisons of runs.

Events: (execution_id, seq, step_id, event_type, status, token_in, token_out, ref, quality).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlog.functions.text import difference, joined, shared

# The event types that every summary counts.
EVENT_TYPES = ["system", "user", "assistant"]


def timeline_summary(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """One row an execution: counts by type (0 where absent), token sums, distinct references, last status."""
    counts = [F.sum((F.col("event_type") == t).cast("long")).alias(f"n_{t}") for t in types or EVENT_TYPES]
    return events.groupBy("execution_id").agg(
        F.count("*").alias("event_count"), F.min("seq").alias("started"), F.max("seq").alias("completed"), F.max_by("status", "seq").alias("status"),
        F.sum("token_in").alias("token_in"), F.sum("token_out").alias("token_out"), F.count_distinct("ref").alias("refs"), *counts,
    )


def running_snapshots(events: DataFrame) -> DataFrame:
    """Per event: sums and the last known quality up to and including it, and how many references were new so far.

    One window an execution over running frames; the first appearance of a reference is marked beforehand, so
    no frame gathers a growing list.
    """
    w = Window.partitionBy("execution_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = (F.row_number().over(Window.partitionBy("execution_id", "ref").orderBy("seq")) == 1) & F.col("ref").isNotNull()
    out = events.withColumn("fresh", fresh.cast("long"))
    return out.select("execution_id", "seq", F.sum("token_in").over(upto).alias("token_in"), F.sum("token_out").over(upto).alias("token_out"), F.sum("fresh").over(upto).alias("refs_so_far"), F.last("quality", ignorenulls=True).over(upto).alias("quality"))


def compare_runs(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (left_id, right_id): references added, removed and shared, the difference of token costs of the runs'
    snapshots, which are sums so far and so count early tokens again, and of the plain sums."""
    snaps = running_snapshots(events).groupBy("execution_id").agg(F.sum(F.col("token_in") + F.col("token_out")).alias("cost"))
    plain = events.groupBy("execution_id").agg(F.sum(F.col("token_in") + F.col("token_out")).alias("plain"), F.sort_array(F.collect_set("ref")).alias("refs"))
    run = plain.join(snaps, "execution_id")
    side = lambda s: run.select(F.col("execution_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("cost", "plain", "refs")))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    l, r = F.col("left_refs"), F.col("right_refs")
    return both.select("left_id", "right_id", (F.col("right_cost") - F.col("left_cost")).alias("snapshot_cost_delta"), (F.col("right_plain") - F.col("left_plain")).alias("cost_delta"), joined(difference(r, l)).alias("added"), joined(difference(l, r)).alias("removed"), joined(shared(l, r)).alias("shared"))
