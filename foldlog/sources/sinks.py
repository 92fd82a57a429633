"""Sinks: writes that never change what was written, JSON lines with sorted keys, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def content_digest(df: DataFrame) -> str:
    """A digest of the rows regardless of their order: the sum of row hashes, and how many there are."""
    columns = sorted(df.columns)
    r = df.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).first()
    return f"{r.n}:{r.s or 0}"


def write_once(df: DataFrame, path: str) -> str:
    """Writes Parquet, or, where the path holds data, checks that it is the same; returns the digest of the content."""
    new = content_digest(df)
    try:
        old = content_digest(df.sparkSession.read.parquet(path))
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return new
    if old != new:
        raise ValueError(f"{path} holds other content: {old}, not {new}")
    return new


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, keys in name order, nulls written."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
