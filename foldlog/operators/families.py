"""Families, bursts and headers of parsed logs: counting first, ranking afterwards on the few rows that remain.

Events of no log (a null `by`) are left out where parts of a log are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.session import cut


def family_counts(events: DataFrame, by: str = "log_id", key: str = "family") -> DataFrame:
    """(by, family, n, first_line) of each family of a log."""
    return events.groupBy(by, F.col(key).alias("family")).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def best_families(counts: DataFrame, limit: int, by: str = "log_id") -> DataFrame:
    """The `limit` most frequent of family_counts() in each log with their rank; ties go to the earlier family.

    A rank that is filtered at once is cut before the exchange: each task sends at most `limit` families of a log.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first_line", "family"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def top_families(events: DataFrame, limit: int, by: str = "log_id", key: str = "family") -> DataFrame:
    """(by, family, n, first_line, rank, share): the most frequent families of a log; share is of all its events."""
    counts = cut(family_counts(events, by, key))
    everything = counts.groupBy(by).agg(F.sum("n").alias("all"))
    return best_families(counts, limit, by).join(everything, by).select(by, "family", "n", "first_line", "rank", (F.col("n") / F.col("all")).alias("share"))


def top_codes(events: DataFrame, limit: int = 10, by: str = "log_id") -> DataFrame:
    """(by, code, n, rank): the most frequent codes; ties go to the one first seen."""
    each = events.select(by, "line_no", F.posexplode("codes").alias("pos", "code"))
    counts = each.groupBy(by, "code").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select(by, "code", "n", "rank")


def header(events: DataFrame, by: str = "log_id") -> DataFrame:
    """One row a log: events, first and last time, counts of severities in name order as "name:n,..".

    Severities are few, so the second grouping gathers a handful of rows a log.
    """
    part = events.groupBy(by, "severity").agg(F.count("*").alias("n"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    shown = F.transform(F.sort_array(F.collect_list(F.struct("severity", "n"))), lambda s: F.concat(s["severity"], F.lit(":"), s["n"]))
    return part.groupBy(by).agg(F.sum("n").alias("event_count"), F.min("t0").alias("first_timestamp"), F.max("t1").alias("last_timestamp"), F.array_join(shown, ",").alias("severity_counts"))


def numbered_lines(lines: DataFrame, by: str = "log_id", block: int = 4096) -> DataFrame:
    """Adds `place`, 0, 1, 2 .. in line order within a log, from counts of blocks of line numbers: no task numbers a whole log."""
    of = lines.withColumn("_block", F.floor(F.col("line_no") / block))
    sizes = of.groupBy(by, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(by, "_block").orderBy("line_no")) - 1
    return of.withColumn("_inside", inside).join(sizes.withColumn("_before", before).drop("_n"), [by, "_block"]).withColumn("place", F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def buckets(events: DataFrame, seconds: int, by: str = "log_id") -> DataFrame:
    """Adds `bucket`: windows of `seconds` from the log's first time; untimed events take 0, 1, 2 .. in line order.

    The numbers of untimed events meet those of timed ones on purpose. The log's first time comes from an aggregate.
    """
    start = events.groupBy(by).agg(F.min("timestamp").alias("_t0"))
    timed = events.where("timestamp is not null").join(start, by)
    exact = F.floor((F.unix_micros("timestamp") - F.unix_micros("_t0")) / 1_000_000)
    timed = timed.withColumn("bucket", F.greatest(F.lit(0), F.floor(exact / seconds)).cast("long")).drop("_t0")
    untimed = numbered_lines(events.where("timestamp is null"), by).withColumn("bucket", F.col("place").cast("long")).drop("place")
    return timed.unionByName(untimed)


def bursts(events: DataFrame, seconds: int, limit: int, inside: int = 4, by: str = "log_id", key: str = "family") -> DataFrame:
    """(by, rank, bucket, n, families): the fullest buckets, each with its most frequent families as "family x n".

    Buckets by events, then number; families of a bucket by events, then first line in it. Buckets are chosen first, from counts
    of which each task sends `limit` a log; only their families are ranked.
    """
    once = cut(events.select(by, "line_no", "timestamp", key))  # read three times: lines are parsed once
    counts = cut(buckets(once, seconds, by).groupBy(by, "bucket", key).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")))
    sizes = counts.groupBy(by, "bucket").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("total"), "bucket"))
    fullest = sizes.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)
    place = F.row_number().over(Window.partitionBy(by, "bucket").orderBy(F.desc("n"), "first_line", key))
    shown = counts.join(fullest, [by, "bucket"]).withColumn("place", place).where(F.col("place") <= inside)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat(key, F.lit("x"), F.col("n")).alias("t")))), lambda x: x["t"])
    return shown.groupBy(by, "rank", "bucket", F.col("total").alias("n")).agg(F.array_join(listed, ",").alias("families"))


def family_coverage(events: DataFrame, limit: int, by: str = "log_id", key: str = "family") -> DataFrame:
    """(by, families, coverage): distinct families, and the share of events in the `limit` most frequent."""
    counts = cut(family_counts(events, by, key))
    everything = counts.groupBy(by).agg(F.count("*").alias("families"), F.sum("n").alias("all"))
    most = best_families(counts, limit, by).groupBy(by).agg(F.sum("n").alias("most"))
    return everything.join(most, by).select(by, "families", (F.col("most") / F.col("all")).alias("coverage"))


def plain_family(ecu: Column, severity: Column, codes: Column) -> Column:
    """The family of a line by module, severity and first code alone."""
    return F.concat_ws(":", ecu, severity, F.when(F.size(codes) > 0, codes[0]).otherwise("NO_CODE"))
