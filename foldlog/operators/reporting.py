"""Roll-ups for reports: severity pivots, service health, incidents, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def drift_pivot(findings: DataFrame, by: str) -> DataFrame:
    """(by, critical, high, medium, low): counts of findings; the pivot's values are given, so one pass suffices."""
    return findings.groupBy(by).agg(*(F.sum((F.col("level") == x).cast("long")).alias(x.lower()) for x in LEVELS))


def service_health(stats: DataFrame, limit: float) -> DataFrame:
    """Adds `status` to (service, peak, failures): failing with failures, degraded above the limit, else nominal."""
    return stats.withColumn("status", F.when(F.col("failures") > 0, "failing").when(F.col("peak") > limit, "degraded").otherwise("nominal"))


def incidents(health: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """(incident, about, reason): one for each service that is not nominal, one for each data set with high findings.

    Numbered over the incidents alone, which are at most the services and data sets.
    """
    ill = health.where("status <> 'nominal'").select(F.col("service").alias("about"), F.col("status").alias("reason"))
    drifted = drift_pivot(findings, by).where("high > 0").select(F.col(by).cast("string").alias("about"), F.lit("drift").alias("reason"))
    number = F.row_number().over(Window.partitionBy("reason").orderBy("about"))
    return ill.unionByName(drifted).select(F.format_string("%s-%04d", F.col("reason"), number).alias("incident"), "about", "reason")


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the query, without regard to case; all rows for a blank query."""
    q = query.strip().lower()
    if not q:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q)), F.lit(False))
    return df.where(hit)


def export_rows(*parts: DataFrame) -> DataFrame:
    """Rows of several tables under one header; cells that a table lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, 0 where one side does not vary."""
    c = F.corr(x, y)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def quality_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the parts, three places."""
    total = sum(weights.values())
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + parts[k] * w
    return F.round(out / total if total else F.lit(0.0), 3)
