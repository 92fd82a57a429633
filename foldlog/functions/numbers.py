"""Column functions over numbers: guarded ratios, clamps, signal parts, policy and severity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and weights that results depend on.
EPSILON = 2.220446049250313e-16
SIGNAL_WEIGHTS = {"compression_ratio_drop": 0.35, "sparse_frame_spike": 0.35, "unseen_signature": 0.3}
HABIT_MAX, MONITOR_MAX, DELIBERATION_MIN, ROLLBACK_MIN = 0.3, 0.55, 0.62, 0.85
ENTER_DELIBERATION, EXIT_DELIBERATION = 0.62, 0.42
DEBOUNCE_REQUIRED, DEBOUNCE_LAST = 2, 3
PROFILE_FLOORS = {"evidence": 0.95, "replay": 0.95, "constraint": 0.90, "blocker": 0.90}
PROFILE_HEIGHTS = {"evidence": 0.99, "replay": 0.99, "constraint": 0.98, "blocker": 0.98}
MOST_REDUCTION = 45.0
#: profile: window seconds, families, bursts, sparse frames
PROFILES = {"CONSERVATIVE": (900, 12, 24, False), "BALANCED": (600, 8, 16, True), "AGGRESSIVE": (300, 5, 10, True)}
FAILURE_LABELS = ["EVIDENCE_LOSS", "HIGH_CRITICAL_EVIDENCE_LOSS", "CONSTRAINT_DRIFT", "BLOCKER_DETACHMENT"]
QUALITY_PARTS = ["validity", "specificity", "correctness", "traceability", "rollback_safety", "token_efficiency"]


def clamp(x: Column) -> Column:
    """x within [0, 1]; null and what is not finite become 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(0.0)


def three_places(x: Column) -> Column:
    """clamp() rounded half up to three places."""
    return F.floor((clamp(x) + EPSILON) * 1000 + 0.5) / 1000


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, clamp(part / whole)).otherwise(0.0)


def drop(now: Column, base: Column) -> Column:
    """How far a value fell below its baseline, as a share of it; 0 without a positive baseline."""
    return F.when(now.isNotNull() & (base > 0), three_places((base - now) / base)).otherwise(0.0)


def rise(now: Column, base: Column, bare: bool = False) -> Column:
    """How far a value rose above its baseline; without a positive one 0, or with `bare` the value itself."""
    alone = F.when(now.isNotNull(), three_places(now)).otherwise(0.0) if bare else F.lit(0.0)
    return F.when(now.isNotNull() & (base > 0), three_places((now - base) / base)).otherwise(alone)


def prediction_error(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = weights or SIGNAL_WEIGHTS
    return three_places(reduce(lambda a, b: a + b, [F.lit(w) * parts[k] for k, w in weights.items()]))


def mode_band(error: Column) -> Column:
    """The stateless mode of a prediction error."""
    e = clamp(error)
    return F.when(e >= ROLLBACK_MIN, "rollback_required").when(e < HABIT_MAX, "habit").when(e <= MONITOR_MAX, "monitor").when(e >= DELIBERATION_MIN, "deliberation").otherwise("monitor")


def reduction_percent(original: Column, compact: Column) -> Column:
    return F.when(original == 0, 0.0).otherwise((1 - compact / original) * 100)


def selected_profile(evidence: Column, has_evidence: Column, critical: Column, has_critical: Column, replay: Column, constraint: Column, blocker: Column, reduction: Column) -> Column:
    """CONSERVATIVE when quality is lost, AGGRESSIVE when it is whole and the reduction modest, else BALANCED."""
    f, h = PROFILE_FLOORS, PROFILE_HEIGHTS
    lost = (has_evidence & (evidence < f["evidence"])) | (has_critical & (critical < 1)) | (replay < f["replay"]) | (constraint < f["constraint"]) | (blocker < f["blocker"])
    whole = (~has_evidence | (evidence >= h["evidence"])) & (replay >= h["replay"]) & (constraint >= h["constraint"]) & (blocker >= h["blocker"]) & (reduction < MOST_REDUCTION)
    return F.when(lost, "CONSERVATIVE").when(whole, "AGGRESSIVE").otherwise("BALANCED")


def failure_labels(has_evidence: Column, survived: Column, total: Column, rate: Column, has_critical: Column, critical: Column, constraint: Column, blocker: Column) -> Column:
    """Labels in their fixed order; a rate that is missing counts as 1, a flag as false."""
    is_on = lambda x: F.coalesce(x, F.lit(False))
    below = lambda x: F.coalesce(x, F.lit(1.0)) < 1
    rules = [is_on(has_evidence) & ((survived < total) | below(rate)), is_on(has_critical) & below(critical), below(constraint), below(blocker)]
    return F.array_compact(F.array(*(F.when(r, F.lit(name)) for r, name in zip(rules, FAILURE_LABELS))))


def merged_labels(lists: Column) -> Column:
    """The labels of an array of label lists, once each, in their fixed order."""
    return F.filter(F.array(*map(F.lit, FAILURE_LABELS)), lambda x: F.array_contains(F.flatten(lists), x))


def degradation_severity(collapsed: Column, failures: Column, consistency: Column, drift: Column) -> Column:
    return F.when(collapsed > 0, "CRITICAL").when((failures > 0) | (consistency < 1) | (drift > 0), "WARNING").otherwise("INFO")


def list_limit(n: Column, allowed: int, base: int) -> Column:
    """How many of n entries a profile keeps: their share of `allowed` in `base`, rounded up, one at least."""
    return F.least(n, F.greatest(F.lit(1), F.ceil(n * allowed / base))).cast("int")
