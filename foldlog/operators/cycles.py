"""Repeated compaction: states are compacted, replayed and judged round after round, until a run collapses or the rounds are over.

A run is a state under a profile, named `PROFILE:id`. Each round works on the contents of all runs still going, as one set of Spark
jobs for all profiles; a run that collapses takes no part in later rounds. What a round leaves is cut from its lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.functions.numbers import PROFILES, failure_labels, list_limit, merged_labels
from foldlog.operators import papers as P
from foldlog.operators import traces as T
from foldlog.operators.audit import evidence_survival
from foldlog.operators.records import collapse_reason
from foldlog.session import cut
from foldlog.sources.lines import lookup

RUN = "run"
FAMILIES, BURSTS = 1, 2
RATES = ["replay_consistency", "operational_drift_rate", "evidence_survival_rate"]


@dataclass(frozen=True)
class Limits:
    """How many rounds, and when a run has collapsed; by default it never does."""

    cycles: int = 3
    least_consistency: float = 0.0
    least_critical: float = 0.0
    most_drift: float = 1.0
    fatal: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.cycles < 1 or not all(0 <= x <= 1 for x in (self.least_consistency, self.least_critical, self.most_drift)):
            raise ValueError("at least one cycle, and limits between 0 and 1")


def under_profiles(df: DataFrame, id_col: str, profiles: list[str] | None = None) -> DataFrame:
    """df with `run` in place of its id, a row a profile."""
    names = F.array(*map(F.lit, profiles or list(PROFILES)))
    return df.withColumn("_profile", F.explode(names)).withColumn(RUN, F.concat("_profile", F.lit(":"), F.col(id_col).cast("string"))).drop("_profile", id_col)


def run_names(df: DataFrame, id_col: str, kind: str = "long") -> DataFrame:
    """df with the profile and the id that `run` names."""
    return df.withColumns({"profile": F.substring_index(RUN, ":", 1), id_col: F.regexp_extract(RUN, "^[^:]*:(.*)$", 1).cast(kind)}).drop(RUN)


def pruned(values: Column, budget: int) -> Column:
    """The first entries of a list, by the share that the run's profile has of the widest profile's budget."""
    allowed = lookup({k: str(p[budget]) for k, p in PROFILES.items()}, F.substring_index(RUN, ":", 1), "0").cast("int")
    return F.slice(values, 1, list_limit(F.size(values), allowed, PROFILES["CONSERVATIVE"][budget]))


Round = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def cycle_row(cycle: int, prefix: str, limits: Limits, rates: list[str] | None = None) -> Column:
    """STRUCT of what repeated() tells of a run in a cycle, from judgements under a prefix; rates: which of constraints and blockers they hold."""
    at = lambda c: F.col(f"{prefix}{c}")
    constraint, blocker = (at(c) if c in (rates or []) else F.lit(1.0) for c in ("constraint_survival_rate", "blocker_survival_rate"))
    drift = F.round(1 - at("replay_consistency"), 6)
    labels = failure_labels(at("has_evidence"), at("evidence_survived"), at("evidence_total"), at("evidence_survival_rate"), at("has_high_critical_evidence"), at("high_critical_evidence_survival_rate"), constraint, blocker)
    reason = collapse_reason(labels, list(limits.fatal), at("replay_consistency"), limits.least_consistency, at("has_high_critical_evidence"), at("high_critical_evidence_survival_rate"), limits.least_critical, drift, limits.most_drift)
    plain = (at(c).alias(c) for c in ("evidence_survival_rate", "high_critical_evidence_survival_rate", "has_high_critical_evidence"))
    return F.struct(F.lit(cycle).cast("long").alias("cycle"), at("replay_consistency").alias("replay_consistency"), drift.alias("operational_drift_rate"), *plain, constraint.alias("constraint_survival_rate"), blocker.alias("blocker_survival_rate"), labels.alias("failure_labels"), reason.alias("reason"))


def repeated(runs: DataFrame, round_of: Round, limits: Limits) -> DataFrame:
    """A row a run and cycle: rates, flags, labels, and why the run collapsed (null where it did not).

    round_of: from states to (replayed states, judgements by run). Ends early once no run is left. No runs, no rows.
    """
    current, out = runs, None
    for cycle in range(1, limits.cycles + 1):
        again, judged = round_of(current)
        has = [c for c in ("constraint_survival_rate", "blocker_survival_rate") if c in judged.columns]
        rows = judged.select(RUN, cycle_row(cycle, "", limits, has).alias("r")).select(RUN, "r.*")
        rows = cut(rows)
        out = rows if out is None else out.unionByName(rows)
        going = rows.where("reason is null").select(RUN)
        if cycle == limits.cycles or going.isEmpty():
            break
        current = cut(again.join(going, RUN, "left_semi"))
    return out


def with_evidence(judged: DataFrame, found: DataFrame) -> DataFrame:
    """Judgements with what survived of each run's evidence; rates are 0 where there is none."""
    of = lambda c, none, name: F.coalesce(F.col(c), F.lit(none)).alias(name)
    both = judged.join(found, RUN, "left")
    return both.select(*judged.columns, of("evidence_survival_rate", 0.0, "evidence_survival_rate"), of("high_survival_rate", 0.0, "high_critical_evidence_survival_rate"), of("evidence_survived", 0, "evidence_survived"), of("evidence_total", 0, "evidence_total"), F.col("evidence_total").isNotNull().alias("has_evidence"), of("has_high", False, "has_high_critical_evidence"))


def paper_cycles(states: DataFrame, evidence: DataFrame, papers: DataFrame, id_col: str, text_col: str, limits: Limits = Limits(), profiles: list[str] | None = None) -> DataFrame:
    """paper_cycles_in_rows() of states, evidence (id, evidence_id, locator, criticality) and texts, put together by id."""
    listed = evidence.groupBy(id_col).agg(F.collect_list(F.struct("locator", "criticality")).alias("evidence"))
    texts = papers.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).join(listed, id_col)
    named = P.with_named(texts.withColumn("_blocks", P.blocks(P.plain_breaks(F.col("_text")))), "_text").select(id_col, "_named")
    return paper_cycles_in_rows(states.join(named, id_col, "left"), id_col, limits, profiles)


def paper_cycles_in_rows(rows: DataFrame, id_col: str, limits: Limits = Limits(), profiles: list[str] | None = None) -> DataFrame:
    """repeated() of papers: keyword and entity budgets, then the profile's share of every list but the required entities.

    rows: states with `_named`, see papers.with_named(). Every round of a run works on the run's own row, so no state is shuffled, joined or
    kept between rounds, whatever their number; texts are read once.
    """
    at = rows.select(id_col, "_named", *P.FIELDS, F.explode_outer(F.array(*map(F.lit, profiles or list(PROFILES)))).alias("_profile"))
    at = at.select(F.concat("_profile", F.lit(":"), F.col(id_col).cast("string")).alias(RUN), "_named", *P.FIELDS, *(F.col(f).alias(f"o_{f}") for f in P.FIELDS)).where(F.col(RUN).isNotNull())
    cycles = []
    for cycle in range(1, limits.cycles + 1):
        at = at.withColumns(P.compact_columns())
        at = at.withColumns({f: pruned(F.col(f), FAMILIES) for f in P.FIELDS if f != "required_entities"})
        held = sum((P.survives(f, F.col(f"o_{f}"), F.col(f)).cast("int") for f in P.FIELDS), F.lit(0))
        at = at.withColumns({"_counts": P.survival_in_row(F.col("_named")), "_consistency": F.round(held / len(P.FIELDS), 6)})
        at = at.withColumn("_found", F.struct("_consistency", *P.survival_columns("_counts")))
        of = lambda c, none: F.coalesce(F.col(f"_found.{c}"), F.lit(none)).alias(c)
        judged = F.struct(F.col("_consistency").alias("replay_consistency"), of("evidence_survival_rate", 0.0), of("high_survival_rate", 0.0).alias("high_critical_evidence_survival_rate"), of("evidence_survived", 0), of("evidence_total", 0), F.col("_found.evidence_total").isNotNull().alias("has_evidence"), of("has_high", False).alias("has_high_critical_evidence"))
        at = at.withColumn("_judged", judged)
        at = at.withColumn(f"_cycle{cycle}", cycle_row(cycle, "_judged.", limits)).drop("_counts", "_consistency", "_found", "_judged")
        cycles.append(f"_cycle{cycle}")
    every = at.select(RUN, F.array(*cycles).alias("_rows")).withColumn("_last", F.array_position(F.transform("_rows", lambda r: r["reason"].isNotNull()), True))
    going = F.slice("_rows", 1, F.when(F.col("_last") > 0, F.col("_last")).otherwise(limits.cycles).cast("int"))
    return every.select(RUN, F.explode_outer(going).alias("r")).select(RUN, "r.*")


def agent_cycles(states: DataFrame, evidence: DataFrame, id_col: str, limits: Limits = Limits(), profiles: list[str] | None = None) -> DataFrame:
    """repeated() of agent states: compact texts, then the profile's share of tool calls by its bursts, of other lists by its families."""
    start = cut(under_profiles(states, id_col, profiles))
    wanted = cut(under_profiles(evidence, id_col, profiles))

    def round_of(current: DataFrame) -> tuple[DataFrame, DataFrame]:
        read = T.replayed(T.compact_text(current, RUN), RUN)
        again = cut(read.withColumns({f: pruned(F.col(f), BURSTS if f == "tool_sequence" else FAMILIES) for f in T.SHORT if f != "active_task"}))
        found = T.agent_evidence(wanted.join(again.select(RUN), RUN, "left_semi"), start, again, RUN)
        rates = T.survival_rates(start, again, RUN)
        return again, with_evidence(rates.select(RUN, "replay_consistency", "constraint_survival_rate", "blocker_survival_rate"), found)

    return repeated(start, round_of, limits)


def cycle_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per `by`, over the last cycle of each run: runs, share collapsed, mean rates, labels that any run ended with, last cycle of a collapse."""
    last = rows.groupBy(*by, RUN).agg(F.max_by(F.struct(*RATES, "failure_labels", "reason"), "cycle").alias("x"), F.max(F.when(F.col("reason").isNotNull(), F.col("cycle"))).alias("at"))
    means = (F.round(F.avg(f"x.{c}"), 6).alias(f"average_{c}") for c in RATES)
    return last.groupBy(*by).agg(F.count("*").alias("runs"), F.round(F.avg(F.col("x.reason").isNotNull().cast("double")), 6).alias("collapse_rate"), *means, merged_labels(F.collect_set("x.failure_labels")).alias("failure_labels"), F.max("at").alias("highest_collapse_cycle"))
