"""Audits: records against re-parsed events, replays against each other, evidence against what survived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.functions.hashing import sha256


def drift_findings(records: DataFrame, events: DataFrame, key: list[str], fields: dict[str, str]) -> DataFrame:
    """(key.., field, level): what differs between each record and its event; a missing event is CRITICAL.

    fields: {column of both sides: level of a difference}. A positional comparison names the position as its
    key. One join; findings are exploded from an array of the row's own differences.
    """
    right = events.select(*(F.col(k) for k in key), *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_there"))
    both = records.join(right, key, "left")
    missing = F.col("_there").isNull()
    found = [F.when(missing, F.struct(F.lit("event").alias("field"), F.lit("CRITICAL").alias("level")))]
    found += [F.when(~missing & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.struct(F.lit(c).alias("field"), F.lit(level).alias("level"))) for c, level in fields.items()]
    return both.select(*key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*key, "f.field", "f.level")


def retention(records: DataFrame, findings: DataFrame, by: str, key: list[str]) -> DataFrame:
    """(by, records, kept, retention, critical, high, passed): share of records without a finding, and the gate."""
    worst = findings.groupBy(*key).agg(F.sum((F.col("level") == "CRITICAL").cast("long")).alias("c"), F.sum((F.col("level") == "HIGH").cast("long")).alias("h"))
    both = records.join(worst, key, "left")
    out = both.groupBy(by).agg(F.count("*").alias("records"), F.sum(F.col("c").isNull().cast("long")).alias("kept"), F.coalesce(F.sum("c"), F.lit(0)).alias("critical"), F.coalesce(F.sum("h"), F.lit(0)).alias("high"))
    return out.withColumns({"retention": F.round(F.col("kept") / F.greatest(F.col("records"), F.lit(1)), 6), "passed": (F.col("critical") == 0) & (F.col("high") == 0)})


def replay_stability(passes: DataFrame, by: str, parts: list[str]) -> DataFrame:
    """(by, passes, digests, digest, stable): whether every pass over a data set gave one and the same digest of its parts; the least digest."""
    digest = sha256(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)))
    return passes.select(by, digest.alias("d")).groupBy(by).agg(F.count("*").alias("passes"), F.count_distinct("d").alias("digests"), F.min("d").alias("digest")).withColumn("stable", F.col("digests") == 1)


def evidence_survival(evidence: DataFrame, original: DataFrame, replayed: DataFrame, by: str, matches: Column | None = None) -> DataFrame:
    """Per `by`: totals and rates of evidence found on both sides with matching values, also of HIGH evidence.

    evidence: (by, evidence_id, criticality); original, replayed: (by, evidence_id, value). Rates are 0 where
    there is no evidence, beside flags that say so. matches: over columns o and r; equality by default.
    """
    both = evidence.join(original.withColumnRenamed("value", "o"), [by, "evidence_id"], "left").join(replayed.withColumnRenamed("value", "r"), [by, "evidence_id"], "left")
    alike = F.col("o") == F.col("r") if matches is None else matches
    ok = F.coalesce(F.col("o").isNotNull() & F.col("r").isNotNull() & alike, F.lit(False)).cast("long")
    high = (F.upper(F.trim("criticality")) == "HIGH").cast("long")
    out = both.groupBy(by).agg(F.count("*").alias("evidence_total"), F.sum(ok).alias("evidence_survived"), F.sum(high).alias("h"), F.sum(high * ok).alias("hs"))
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return out.select(by, "evidence_total", "evidence_survived", rate("evidence_survived", "evidence_total").alias("evidence_survival_rate"), (F.col("h") > 0).alias("has_high"), rate("hs", "h").alias("high_survival_rate"))
