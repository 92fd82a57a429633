"""References: deduplication, selection within a token budget, validity of their addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from foldlog.session import cut

# The schemes that a reference may have.
SCHEMES = ["ctx", "mem", "replay", "artifact", "tool", "file", "run"]


def budget_select(refs: DataFrame, by: str, budget: int) -> DataFrame:
    """Adds `taken` and `used` to (by, id, relevance, tokens): in order of relevance, tokens, id, what still fits is taken.

    A choice depends on all before it, so the rows of a group pass in order through one task as a stream that
    keeps a single sum; Spark partitions and sorts them, and no group is gathered. Rows pass as Arrow batches, so
    that ids beside nulls stay exact. Null groups are one group; a reference of unknown (null) tokens never fits.
    """
    ordered = refs.repartition(by).sortWithinPartitions(by, F.desc("relevance"), "tokens", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = object(), 0
        for rows in batches:
            taken, sums = [], []
            for g, n in zip(rows.column(by).to_pylist(), rows.column("tokens").to_pylist()):
                if g != group:
                    group, used = g, 0
                fits = n is not None and used + n <= budget
                used += n if fits else 0
                taken.append(fits)
                sums.append(used)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(taken, pa.bool_()), pa.array(sums, pa.int64())], [*rows.schema.names, "taken", "used"])

    return ordered.mapInArrow(run, StructType([*refs.schema, StructField("taken", BooleanType()), StructField("used", LongType())]))


def manifest(selected: DataFrame, by: str) -> DataFrame:
    """Per group: how many references were taken and left, their tokens, and raw tokens avoided."""
    t = F.col("taken")
    avoided = F.greatest(F.lit(0), F.coalesce(F.col("raw_tokens"), F.col("tokens")) - F.col("tokens"))
    return selected.groupBy(by).agg(
        F.sum(t.cast("long")).alias("n_selected"), F.sum((~t).cast("long")).alias("n_omitted"),
        F.sum(F.when(t, F.col("tokens")).otherwise(0)).cast("long").alias("total_tokens"), F.sum(F.when(t, avoided).otherwise(0)).cast("long").alias("raw_tokens_avoided"),
    )


def first_by_keys(refs: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """The rows that a pass in `order` keeps: those of which no key stands in a row kept before.

    Done in rounds over all rows at once: a row that is the first of each of its keys is kept, rows that share a
    key with it are dropped, and the rest is decided in the next round. Copies end in the first round; only
    chains of rows that share different keys take more. `order` is unique; null keys are keys like others.
    """
    open_rows, kept = cut(refs), None
    while not open_rows.isEmpty():
        at = open_rows
        for k in keys:
            first = open_rows.groupBy(F.col(k).alias("_k")).agg(F.min(order).alias("_first"))
            at = at.join(first, F.col(k).eqNullSafe(F.col("_k"))).where(F.col(order) == F.col("_first")).drop("_k", "_first")
        now = cut(at)
        for k in keys:
            names = now.select(F.col(k).alias("_k"), F.lit(1).alias("_in")).distinct()
            open_rows = open_rows.join(names, F.col(k).eqNullSafe(F.col("_k")), "left_anti")
        open_rows = cut(open_rows)
        kept = now if kept is None else kept.unionByName(now)
    return refs.limit(0) if kept is None else kept


def reference_index(entries: DataFrame, order: str) -> DataFrame:
    """entries (id, uri, hash, created_at, ..) of all indexes without those whose id, uri or hash an earlier one has; `place` is their order.

    Entries pass in `order` (unique); the kept ones are sorted by created_at, id, uri, hash. Places are counted within ranges of
    the sort keys, so no task numbers all entries.
    """
    kept = cut(first_by_keys(entries, order, ["id", "uri", "hash"]))
    keys = ["created_at", "id", "uri", "hash"]
    ranged = cut(kept.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def registered(refs: DataFrame, order: str, by: str) -> DataFrame:
    """The references of each group that a registry keeps: the first of each uri or hash, then the first of each id."""
    named = refs.withColumns({"_uri": F.concat_ws("\x00", F.col(by).cast("string"), "uri"), "_hash": F.concat_ws("\x00", F.col(by).cast("string"), "hash")})
    kept = first_by_keys(named, order, ["_uri", "_hash"])
    first = kept.groupBy(by, "id").agg(F.min(order).alias(order))
    return kept.join(first.select(order), order, "left_semi").drop("_uri", "_hash")


def uri_problem(uri: Column) -> Column:
    """What is wrong with a reference's address, or null."""
    scheme, path = F.regexp_extract(uri, r"^([A-Za-z]+)://(.*)$", 1), F.regexp_extract(uri, r"^([A-Za-z]+)://(.*)$", 2)
    traversal = path.rlike(r"(?i)\.\.|\\|%2e%2e|%5c|%2e\.|\.%2e")
    out = F.when(~uri.rlike(r"^[A-Za-z]+://") | uri.isNull(), "format").when(~scheme.isin(SCHEMES), "scheme")
    in_file = F.when(F.trim(path) == "", "empty").when(path.startswith("/"), "absolute").when(path.rlike(r"^[A-Za-z]:[/\\]"), "windows").when(path.startswith("\\\\"), "share").when(path.rlike(r"^(localhost|127\.0\.0\.1)/"), "local").when(traversal, "traversal")
    return out.when(scheme == "file", in_file)


def scheme_of(uri: Column) -> Column:
    s = F.split_part(uri, F.lit("://"), F.lit(1))
    return F.when(uri.contains("://") & s.isin(SCHEMES), s)
