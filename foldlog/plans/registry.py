"""All queries over the given tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldlog.plans import artifact_queries, log_queries, paper_queries, record_queries, run_queries, state_queries, stream_queries, text_queries, trace_queries

PARTS = [log_queries, text_queries, run_queries, stream_queries, state_queries, record_queries, trace_queries, paper_queries, artifact_queries]
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in PARTS for k, v in p.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_queries.topk_families(spark, sf_dir)
