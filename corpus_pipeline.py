"""The corpus pipeline: five stages in order, each on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. Rows of null or repeated ids are judged each by their own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm.common import row_key
from foldlog.llm.decontaminate import decontaminate
from foldlog.llm.ngram_join import jaccard_components, without_ids
from foldlog.llm.secrets import redact_secrets
from foldlog.llm.tokenize import sentencepiece_encode
from foldlog.llm.toxicity import score_toxicity
from foldlog.session import cut, keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the pattern grammar scores below 0.7."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.7, folds=3, fold=1)
    return scored.where("toxicity.predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 5-word shingles of at least 0.8, keeps the smallest id's document.

    Null ids come behind all others. Documents without words are groups of their own. Rows that repeat an id and
    its text are one document: one row stays; but rows without id and words all stay.
    """
    rows = docs.withColumn("_row", row_key())
    groups = cut(jaccard_components(rows, width=5, percent=80, id_col="_row"))
    linked = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    ids = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row").alias("order")).distinct()
    members = cut(groups.where("n_shingles > 0").select("_row", "component_id").distinct().join(linked, "component_id").join(ids, "_row"))
    stays = members.groupBy("component_id").agg(F.min("order").alias("first")).select("component_id", F.col("first._row").alias("first"))
    gone = members.join(stays, "component_id").where("_row <> first").select("_row")
    kept = without_ids(rows, gone, "_row")
    repeated = groups.groupBy("_row").count().where("count > 1").select("_row")
    if not repeated.isEmpty():
        alone = F.col("doc_id").isNull() & (F.trim(F.coalesce(F.translate("text", "\t\n\v\f\r", "     "), F.lit(""))) == "")
        kept = kept.where(~alone).dropDuplicates(["_row"]).unionByName(kept.where(alone))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no window similar to a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces found secrets by a mask; every document stays."""
    return redact_secrets(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids by the 32k merge vocabulary."""
    coded = sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "pieces.n_tokens", "pieces.ids", "pieces.ids_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("tokens", encode),
]

#: No SQL says the learned stages; tests/llm tests each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs)
    return docs
