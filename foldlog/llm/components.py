"""Connected components of an edge table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each end of the edges (a, b): c is the smallest v reachable.

    Each round a vertex takes the smallest label among itself and its neighbours, then that label's own label
    (pointer jumping), until a round changes nothing. Loops, repeated and null-ended edges do no harm; no
    edges give no rows. Labels are written to the shared checkpoint folder each round.
    """
    both = cut(edges.where("a is not null and b is not null").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("v")).distinct().select("v", F.col("v").alias("c"))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = step.select(F.col("v").alias("w"), F.col("c").alias("further"))
        step = cut(step.join(jump, F.col("c") == F.col("w"), "left").select("v", "old", F.least("c", F.coalesce("further", "c")).alias("c")))
        labels = step.select("v", "c")
        if step.where("old <> c").isEmpty():
            return labels
