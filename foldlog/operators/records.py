"""Rows of checks and results: gates and statuses, label counts, enrichment of findings, evidence, references, source hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.functions.numbers import FAILURE_LABELS, clamp, drop, rise
from foldlog.functions.text import TOKEN

# Owners, weights and reasons that results depend on.
SAFETY, VALIDATION = "Safety Assurance", "Validation SRE"
BLEND = {"family": 0.70, "severity": 0.20, "code": 0.09, "most": 0.99, "codes": 4.0}
COLLAPSE = {"replay": "min_replay_consistency", "critical": "min_high_critical_evidence_survival_rate", "drift": "max_operational_drift_rate"}
REQUEST_ID = r"^[A-Za-z0-9._:-]{1,128}$"


def gates(checks: DataFrame, by: str, passed: str) -> DataFrame:
    """(by, n, n_passed, pass_rate, all_passed, any_passed). No check, no row; a null counts as failed."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return checks.groupBy(by).agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_passed"), F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"), F.bool_and(ok).alias("all_passed"), F.bool_or(ok).alias("any_passed"))


def overall_status(records: DataFrame, by: str, required: str, present: str) -> DataFrame:
    """(by, status): red if a required artifact is missing, yellow if an optional one is, else green."""
    gone = ~F.coalesce(F.col(present), F.lit(False))
    need = F.coalesce(F.col(required), F.lit(False))
    return records.groupBy(by).agg(F.when(F.bool_or(need & gone), "red").when(F.bool_or(~need & gone), "yellow").otherwise("green").alias("status"))


def label_counts(labels: Column, names: list[str] | None = None) -> dict[str, Column]:
    """{name: 0 or 1} for each label; what is no label counts for none."""
    return {n.lower(): F.coalesce(F.array_contains(labels, n), F.lit(False)).cast("int") for n in names or FAILURE_LABELS}


def collapse_reason(labels: Column, fatal: list[str], consistency: Column, least: float, has_critical: Column, critical: Column, least_critical: float, drift: Column, most_drift: float) -> Column:
    """Why a cycle counts as collapsed: the first fatal label, then the limits in their order; null where it does not."""
    rules = [F.when(F.array_contains(labels, x), F.lit(f"fatal_failure_mode:{x}")) for x in fatal]
    rules += [F.when(consistency < least, F.lit(COLLAPSE["replay"])), F.when(has_critical & (critical < least_critical), F.lit(COLLAPSE["critical"])), F.when(drift > most_drift, F.lit(COLLAPSE["drift"]))]
    return F.coalesce(*rules)


def rate_text(rate: Column) -> Column:
    """Six decimals, or N/A for null and for what is not finite."""
    finite = rate.isNotNull() & ~F.isnan(rate) & (F.abs(rate) != float("inf"))
    return F.when(finite, F.format_string("%.6f", F.bround(rate, 6))).otherwise("N/A")


def enriched_findings(findings: DataFrame, by: str, order: str, level: str, category: str) -> DataFrame:
    """(id, by, severity, title, owner): findings numbered within `by` in the given order.

    Numbers come from counts of blocks of the order (a number), so that no task numbers all findings of one `by`. Findings without
    an order come last.
    """
    block = F.coalesce(F.floor(F.col(order) / 4096), F.lit(1 << 62)).alias("_block")
    blocks = findings.groupBy(by, block).agg(F.count("*").alias("_n"))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by, "_block").orderBy(order, category))
    numbered = findings.withColumn("_block", block).withColumn("_k", inside).join(before, [by, "_block"])
    name = F.upper(F.replace(F.col(by).cast("string"), F.lit("."), F.lit("-")))
    shown = F.coalesce(F.col(level), F.lit("INFO"))
    return numbered.select(
        F.concat(F.lit("FND-"), name, F.lit("-"), F.format_string("%03d", F.col("_before") + F.col("_k"))).alias("id"), by, shown.alias("severity"),
        F.initcap(F.replace(F.coalesce(F.col(category), F.lit("semantic")), F.lit("_"), F.lit(" "))).alias("title"), F.when(shown.isin("CRITICAL", "HIGH"), SAFETY).otherwise(VALIDATION).alias("owner"),
    )


def retention_blend(events: Column, retained: Column, severities: Column, codes: Column) -> Column:
    """One number for how much of a log survived: events, whether severities did, and up to four codes."""
    parts = BLEND["family"] * retained / events + BLEND["severity"] * F.when(severities > 0, 1.0).otherwise(0.0) + BLEND["code"] * F.least(F.lit(1.0), codes / BLEND["codes"])
    return F.when(events <= 0, 0.0).otherwise(F.least(F.lit(BLEND["most"]), parts))


def missing_evidence(evidence: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(by, position, evidence_id): evidence without a surviving match, in its order, a row each. evidence: (by, position, evidence_id)."""
    return evidence.join(found.select(by, "evidence_id").distinct(), [by, "evidence_id"], "left_anti").select(by, "position", "evidence_id")


def request_id(raw: Column) -> Column:
    """The id if it is of safe characters only, else null."""
    return F.when(F.trim(raw).rlike(REQUEST_ID), F.trim(raw))


def reference_id(kind: Column, digest: Column) -> Column:
    """`kind-` and the last twelve letters and digits of a digest."""
    return F.concat(kind, F.lit("-"), F.right(F.regexp_replace(digest, "(?i)[^a-z0-9]", ""), F.lit(12)))


def reference_problem(relevance: Column, tokens: Column) -> Column:
    """Why a reference is refused: a relevance that is no finite number, a token estimate that is no whole number from 0."""
    bad = relevance.isNull() | F.isnan(relevance) | (F.abs(relevance) == float("inf"))
    return F.when(bad, "relevance").when(tokens.isNull() | (tokens < 0) | (tokens != F.floor(tokens)), "tokens")


def clamped_relevance(relevance: Column) -> Column:
    return clamp(relevance)


def token_signals(df: DataFrame) -> DataFrame:
    """Adds token_cost_spike and replay_consistency_drop of (token_estimate, base_tokens, consistency, base_consistency); null where an input is."""
    spike = F.when(F.col("token_estimate").isNotNull() & F.col("base_tokens").isNotNull(), rise(F.col("token_estimate"), F.col("base_tokens")))
    fall = F.when(F.col("consistency").isNotNull() & F.col("base_consistency").isNotNull(), drop(F.col("consistency"), F.col("base_consistency")))
    return df.withColumns({"token_cost_spike": spike, "replay_consistency_drop": fall})


def quality_explanation(score: Column, traceability: Column, rollback: Column, used: Column, budget: Column) -> Column:
    within = F.when(used <= budget, "tokens used within budget").otherwise("tokens exceeded budget")
    return F.concat(
        F.lit("Deterministic quality score "), score, F.lit(": "), F.when(traceability > 0, "linked replay/reference evidence present").otherwise("no replay/reference evidence linked"), F.lit("; "),
        F.when(rollback > 0, "rollback evidence includes snapshots or artifacts").otherwise("rollback evidence missing"), F.lit("; "), used, F.lit("/"), budget, F.lit(" "), within, F.lit("."),
    )


def source_hashes(lines: DataFrame, by: str = "log_id") -> DataFrame:
    """(by, fp): sixteen hexadecimal digits of the SHA-256 of each log's lines, joined by line feeds.

    The lines of a log come in order within one partition and pass through as a stream that keeps one digest, so a
    log of any length needs the memory of a batch. Null lines count as empty.
    """
    kind = dict(lines.dtypes)[by]
    rows = lines.select(F.col(by).alias("log"), "line_no", F.coalesce("raw", F.lit("")).alias("raw")).repartition("log").sortWithinPartitions("log", "line_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, digest = None, None
        for b in batches:
            out = []
            for name, raw in zip(b["log"], b["raw"]):
                if digest is None or name != log:
                    if digest is not None:
                        out.append((log, digest.hexdigest()[:16].upper()))
                    log, digest = name, hashlib.sha256(raw.encode())
                else:
                    digest.update(b"\n" + raw.encode())
            yield pd.DataFrame(out, columns=["log", "fp"])
        if digest is not None:
            yield pd.DataFrame([(log, digest.hexdigest()[:16].upper())], columns=["log", "fp"])

    made = rows.withColumn("log", F.col("log").cast("string")).select("log", "raw").mapInPandas(run, "log string, fp string")
    return made.select(F.col("log").cast(kind).alias(by), "fp")


def resolved(locators: DataFrame, by: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Adds `value` to (.., by, locator): what a locator `kind:key` names; null where nothing is there.

    sources: {kind: (by, key, value)}, keys unique within `by`. One join against the tagged union of the sources.
    """
    union = None
    for kind, df in sources.items():
        part = df.select(by, F.concat(F.lit(f"{kind}:"), F.col("key").cast("string")).alias("_at"), F.col("value").cast("string").alias("value"))
        union = part if union is None else union.unionByName(part)
    at = F.concat(F.lower(F.trim(F.substring_index("locator", ":", 1))), F.lit(":"), F.trim(F.regexp_extract("locator", "^[^:]*:(.*)$", 1)))
    return locators.withColumn("_at", at).join(union, [by, "_at"], "left").drop("_at")


def last_quality(events: DataFrame, by: str, order: str, quality: str) -> DataFrame:
    """(by, quality): the last known quality of each timeline; null where none is known."""
    return events.groupBy(by).agg(F.max_by(quality, F.when(F.col(quality).isNotNull(), F.col(order))).alias("quality"))


def first_references(events: DataFrame, by: str, order: str, ref: str) -> DataFrame:
    """(by, ref, first, k): the distinct references of a timeline in order of appearance, a row each."""
    seen = events.where(F.col(ref).isNotNull()).groupBy(by, ref).agg(F.min(order).alias("first"))
    return seen.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("first", ref)).cast("long"))


def entity(text: Column) -> Column:
    """Without punctuation at the ends."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(".,;:()[]{} "))


def holds_entity(name: Column, text: Column) -> Column:
    """Whether the text holds the entity, letters of either case alike; an empty one is held by none."""
    e = F.lower(entity(name))
    return (e != "") & F.contains(F.lower(F.coalesce(text, F.lit(""))), e)


def mean_or_one(x: Column) -> Column:
    """The mean of a group; 1 where nothing is known."""
    return F.coalesce(F.avg(x), F.lit(1.0))


def reconstruction_line(ecu: Column, severity: Column, codes: Column, fields: dict[str, Column]) -> Column:
    """A parsed event as one JSON line with sorted keys."""
    parts = {"codes": codes, "ecu": ecu, "severity": severity, **fields}
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(parts.items()))))


def signal_reasons(parts: list[str], band: Column, entering: Column) -> Column:
    """Why a window stands out, in order and once each: parts above 0, the band it is in, and whether it enters deliberation."""
    named = [F.when(F.col(p) > 0, F.lit(p)) for p in parts]
    return F.array_distinct(F.array_compact(F.array(*named, F.when(band != "habit", F.concat(F.lit("band:"), band)), F.when(entering, F.lit("entered_deliberation")))))


def artifact_summary(windows: DataFrame, by: str, triggered: Column, ratio: str, tokens: str, reasons: str) -> DataFrame:
    """(by, windows, triggered, mean_ratio, tokens, reasons): tokens are null where no window knows them; reasons sorted, once each.

    Reasons are few names, so what is gathered for a run is bounded by their number.
    """
    each = windows.groupBy(by).agg(F.count("*").alias("windows"), F.sum(F.coalesce(triggered, F.lit(False)).cast("long")).alias("triggered"), F.round(F.avg(ratio), 6).alias("mean_ratio"), F.sum(tokens).alias("tokens"))
    names = windows.select(by, F.explode(reasons).alias("r")).distinct().groupBy(by).agg(F.array_join(F.sort_array(F.collect_list("r")), ",").alias("reasons"))
    return each.join(names, by, "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))


def token_digest(text: Column) -> Column:
    """A digest of the list of technical tokens of a text."""
    return F.sha2(F.to_json(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))), 256)
