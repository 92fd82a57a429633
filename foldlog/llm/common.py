"""What the text operators share: small Arrow batches and the split of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts can be a megabyte long, so batches are kept far below Spark's 10,000 rows.
ARROW_ROWS = 256


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS, unless they are smaller: Spark reads the setting when a result runs, so it stays."""
    if not 0 < int(spark.conf.get(BATCH)) <= ARROW_ROWS:
        spark.conf.set(BATCH, str(ARROW_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Small Arrow batches for what is planned inside; the caller's setting is put back."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key() -> Column:
    """A number for a row's id and text together: rows of null or repeated ids are told apart by their texts."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls in the held-out fold; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `limit` labelled rows (y, text) outside the held-out fold, chosen by a hash of the id.

    The choice is the same on every run and does not depend on partitioning.
    """
    seen = labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_col), folds, fold)).groupBy(id_col).agg(F.max(label).alias("y"))
    picked = seen.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
