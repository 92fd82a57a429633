"""Series of scores: acceleration, first collapse, half-life, longevity, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_measures(series: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Per chain: mean second difference, first point below 0.5 (0: none), half-life, longevity, final value.

    half_life: the first point at or below 0.5, else the last. longevity: the last point at or above 0.8, else 0.
    """
    w = Window.partitionBy(by).orderBy(at)
    x = F.col(value)
    rows = series.withColumn("_d2", x - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w))
    return rows.groupBy(by).agg(
        F.round(F.coalesce(F.avg("_d2"), F.lit(0.0)), 6).alias("acceleration"),
        F.coalesce(F.min(F.when(x < 0.5, F.col(at))), F.lit(0)).alias("collapse"),
        F.coalesce(F.min(F.when(x <= 0.5, F.col(at))), F.max(at)).alias("half_life"),
        F.coalesce(F.max(F.when(x >= 0.8, F.col(at))), F.lit(0)).alias("longevity"),
        F.round(F.max_by(value, at), 6).alias("final"),
    )


def ordered_score(reference: Column, observed: Column) -> Column:
    """Share of reference items observed, less the share of neighbours (in reference order) whose order is reversed."""
    at = F.transform(F.filter(reference, lambda x: F.array_contains(observed, x)), lambda x: F.array_position(observed, x))
    n = F.size(at)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: (F.element_at(at, i) > F.element_at(at, i + 1)).cast("int")))
    turned = F.coalesce(F.aggregate(pairs, F.lit(0), lambda s, x: s + x), F.lit(0))
    score = (n / F.size(reference)) * (1 - turned / F.greatest(n - 1, F.lit(1)))
    return F.when(F.size(reference) == 0, 1.0).otherwise(score).cast("double")
