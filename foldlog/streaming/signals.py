"""The signal machine and event counts on streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldlog.functions.numbers import DEBOUNCE_LAST, DEBOUNCE_REQUIRED, ENTER_DELIBERATION, EXIT_DELIBERATION, HABIT_MAX, ROLLBACK_MIN
from foldlog.session import checkpoint_dir

OUT = "execution_id long, window_id long, at long, error double, mode string, triggered boolean"
STATE = "mode string, recent array<double>, last_at long, late long"


def step(mode: str, recent: list[float], error: float) -> tuple[str, list[float]]:
    """One window: the next mode, and the errors that the debounce looks back on."""
    recent = [*recent, error][-DEBOUNCE_LAST:]
    high = sum(e >= ENTER_DELIBERATION for e in recent) >= DEBOUNCE_REQUIRED
    if error >= ROLLBACK_MIN:
        return "rollback_required", recent
    if (mode == "deliberation" and error > EXIT_DELIBERATION) or high:
        return "deliberation", recent
    return ("habit" if error < HABIT_MAX else "monitor"), recent


def stream_modes(windows: DataFrame) -> DataFrame:
    """The mode of each window of a stream (execution_id, window_id, at, error), per execution.

    State is a mode and three numbers an execution. Rows of one micro-batch are ordered by (at, window_id);
    a row older than the last one evaluated is late: it is counted in the state and not evaluated, as a mode
    once given is never taken back.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, recent, last, late = state.get if state.exists else ("habit", [], -(1 << 62), 0)
        rows = pd.concat(list(batches)).sort_values(["at", "window_id"], kind="stable")
        out: list[tuple[Any, ...]] = []
        recent = list(recent)
        for r in rows.itertuples():
            if r.at < last:
                late += 1
                continue
            mode, recent = step(mode, recent, r.error)
            last = r.at
            out.append((key[0], r.window_id, r.at, r.error, mode, mode in ("deliberation", "rollback_required")))
        state.update((mode, recent, int(last), late))
        yield pd.DataFrame(out, columns=["execution_id", "window_id", "at", "error", "mode", "triggered"])

    return windows.groupBy("execution_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): counts in tumbling windows of event time; rows behind the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", span), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream over the data now there gives: run until that is read, and read back from the shared folder."""
    spark: SparkSession = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drained_whole(stream: DataFrame, name: str) -> DataFrame:
    """The whole result of an aggregate over the data now there, windows that the watermark has not passed included."""
    spark: SparkSession = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out")

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
