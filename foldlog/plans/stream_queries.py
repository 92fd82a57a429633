"""Queries that read the events table as a stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.functions.numbers import three_places
from foldlog.plans.run_queries import AT
from foldlog.session import table
from foldlog.streaming.signals import drained, drained_whole, stream_modes, window_counts


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files as they come; a pattern, as a stream's source is a folder or a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, every hour: the aggregate is drained whole, so no window waits for a watermark."""
    out = drained_whole(window_counts(event_stream(spark, sf_dir)), "counts")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def stream_mode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a window of its user, its value as the error."""
    e = event_stream(spark, sf_dir)
    windows = e.select(F.col("user_id").alias("execution_id"), F.col("event_id").alias("window_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), three_places(F.col("value") / 250).alias("error"))
    return drained(stream_modes(windows), "modes").select("execution_id", "window_id", "error", "mode", "triggered")


QUERIES = {"stream_counts": stream_counts, "stream_counts_all": stream_counts, "stream_modes": stream_mode_query}

HOURLY = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL"

ORACLE_SQL = {
    "stream_counts": HOURLY,
    "stream_counts_all": HOURLY,
    "stream_modes": f"""WITH RECURSIVE x AS (SELECT user_id, event_id, {AT} AS sec, floor((least(1, greatest(0, value / 250)) + 2.220446049250313e-16) * 1000 + 0.5) / 1000 AS error FROM events),
y AS (SELECT *, coalesce(sum(CASE WHEN error >= 0.62 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS 2 PRECEDING), 0) >= 2 AS entering, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS k FROM x),
z AS (SELECT user_id, event_id, k, error, CASE WHEN error >= 0.85 THEN 'rollback_required' WHEN entering THEN 'deliberation' WHEN error < 0.3 THEN 'habit' ELSE 'monitor' END AS mode FROM y WHERE k = 1
UNION ALL SELECT y.user_id, y.event_id, y.k, y.error, CASE WHEN y.error >= 0.85 THEN 'rollback_required' WHEN z.mode = 'deliberation' AND y.error > 0.42 THEN 'deliberation' WHEN y.entering THEN 'deliberation' WHEN y.error < 0.3 THEN 'habit' ELSE 'monitor' END FROM z JOIN y ON y.user_id = z.user_id AND y.k = z.k + 1)
SELECT user_id AS execution_id, event_id AS window_id, error, mode, mode IN ('deliberation', 'rollback_required') AS triggered FROM z""",
}
