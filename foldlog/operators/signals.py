"""Compression signals: parts and prediction error of a window, the mode machine, and the steps of a window.

Signals: (execution_id, window_id, at, compression_ratio, base_ratio, sparse_rate, base_sparse, unseen_rate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.functions.numbers import DEBOUNCE_LAST, DEBOUNCE_REQUIRED, ENTER_DELIBERATION, EXIT_DELIBERATION, HABIT_MAX, ROLLBACK_MIN, drop, mode_band, prediction_error, rise, three_places

# The reasons of a window, by what they say.
REASONS = {
    "ratio": "compression_ratio_drop exceeded baseline", "sparse": "sparse_frame_rate increased", "unseen": "unseen_signature_rate elevated", "unseen_long": "unseen_signature_rate remained elevated across debounce window",
    "cost": "token_cost increased", "replay": "replay_consistency dropped", "rollback": "prediction_error reached rollback threshold", "entered": "deliberation debounce satisfied", "pending": "deliberation debounce pending",
    "left": "prediction_error below exit threshold", "habit": "prediction_error within habit band", "monitor": "prediction_error within monitor band",
}


def signal_windows(signals: DataFrame) -> DataFrame:
    """Adds the parts, `error`, `band` (the stateless mode) and `entering`: two of the last three errors are high."""
    parts = {
        "compression_ratio_drop": drop(F.col("compression_ratio"), F.col("base_ratio")),
        "sparse_frame_spike": rise(F.col("sparse_rate"), F.col("base_sparse"), bare=True),
        "unseen_signature": three_places(F.col("unseen_rate")),
    }
    out = signals.withColumns(parts)
    out = out.withColumn("error", prediction_error({k: F.col(k) for k in parts}))
    recent = Window.partitionBy("execution_id").orderBy("at", "window_id").rowsBetween(1 - DEBOUNCE_LAST, 0)
    high = F.sum((F.col("error") >= ENTER_DELIBERATION).cast("int")).over(recent)
    return out.withColumns({"band": mode_band(F.col("error")), "entering": high >= DEBOUNCE_REQUIRED})


def next_mode(prior: Column, error: Column, entering: Column) -> Column:
    """One step of the machine: deliberation holds until the error falls to the exit threshold."""
    stays = (prior == "deliberation") & (error > EXIT_DELIBERATION)
    return F.when(error >= ROLLBACK_MIN, "rollback_required").when(stays | entering, "deliberation").when(error < HABIT_MAX, "habit").otherwise("monitor")


def signal_modes(windows: DataFrame) -> DataFrame:
    """Adds `mode` and `triggered` to rows of signal_windows().

    The state only matters where an error lies between exit and rollback without two high ones: there the mode
    is deliberation exactly if it was before. Every other row decides by itself, so a mode is that of the last
    deciding row: one running `last` over a window, no loop.
    """
    error, entering = F.col("error"), F.col("entering")
    decides = (error >= ROLLBACK_MIN) | entering | (error <= EXIT_DELIBERATION)
    holds = F.when(decides, (error < ROLLBACK_MIN) & entering)
    w = Window.partitionBy("execution_id").orderBy("at", "window_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.last("_holds", ignorenulls=True).over(w), F.lit(False))
    out = windows.withColumn("_holds", holds)
    out = out.withColumn("mode", next_mode(F.when(prior, "deliberation").otherwise("habit"), error, entering)).drop("_holds")
    return out.withColumn("triggered", F.col("mode").isin("deliberation", "rollback_required"))


def window_reasons(windows: DataFrame) -> DataFrame:
    """Adds `reasons` to rows of signal_modes(): what rose or fell, then what the machine made of it, each once.

    Of token_cost_spike and replay_consistency_drop, where there are such columns, a null is no reason.
    """
    w = Window.partitionBy("execution_id").orderBy("at", "window_id")
    mode, error = F.col("mode"), F.col("error")
    entered = (error < ROLLBACK_MIN) & F.col("entering")
    left = (F.coalesce(F.lag("mode").over(w), F.lit("habit")) == "deliberation") & (error <= EXIT_DELIBERATION)
    rose = lambda c, said: F.when(F.col(c) > 0, said) if c in windows.columns else F.lit(None).cast("string")
    machine = F.when(mode == "rollback_required", REASONS["rollback"]).when(entered, REASONS["entered"]).when(error >= ENTER_DELIBERATION, REASONS["pending"]).when(left, REASONS["left"]).when(mode == "habit", REASONS["habit"]).when(mode == "monitor", REASONS["monitor"])
    unseen = F.when(mode == "deliberation", F.lit(REASONS["unseen_long"])).otherwise(F.lit(REASONS["unseen"]))
    parts = [rose("compression_ratio_drop", F.lit(REASONS["ratio"])), rose("sparse_frame_spike", F.lit(REASONS["sparse"])), rose("unseen_signature", unseen), rose("token_cost_spike", F.lit(REASONS["cost"])), rose("replay_consistency_drop", F.lit(REASONS["replay"]))]
    return windows.withColumn("_machine", machine).withColumn("reasons", F.array_distinct(F.array_compact(F.array(*parts, F.col("_machine"))))).drop("_machine")


def map_steps(signals: DataFrame, steps: DataFrame, by: str, span: int) -> DataFrame:
    """(by, window_id, step_id): steps within [start, end] of a window, both inclusive, times in whole seconds.

    signals: (by, window_id, start, end); steps: (by, step_id, at). An interval is dealt to the spans of `span`
    seconds that it touches and joined by equality on them; nothing is compared across spans. Where every
    window is at most `span` long, a row is dealt to two spans at most.
    """
    dealt = signals.withColumn("_span", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.col("end") / span))))
    placed = steps.withColumn("_span", F.floor(F.col("at") / span))
    return dealt.join(placed, [by, "_span"]).where("at >= start and at <= end").select(by, "window_id", "step_id").distinct()


def steps_up_to(signals: DataFrame, steps: DataFrame, by: str) -> DataFrame:
    """(by, step_id, window_id): each step to the first window that ends at or after it; null for later ones.

    Windows and steps are ordered together, and each step takes the next window's id: no pairs are made.
    """
    both = signals.select(by, F.col("end").alias("at"), F.lit(1).alias("kind"), "window_id", F.lit(None).cast("string").alias("step_id")).unionByName(steps.select(by, "at", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("window_id"), F.col("step_id").cast("string")))
    following = Window.partitionBy(by).orderBy("at", "kind", "window_id").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("window_id", F.first("window_id", ignorenulls=True).over(following)).where("kind = 0").select(by, "step_id", "window_id")
