"""Sources of log lines and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.functions.text import LINE_BREAK

# How event types appear in a line.
SEVERITY = {"error": "ERROR", "purchase": "WARN", "signup": "CRITICAL", "click": "INFO", "view": "DEBUG"}
CODE = {"error": "P0301", "signup": "U0100", "purchase": "C0035", "click": "B1000", "view": "P0128"}


def lookup(names: dict[str, str], key: Column, default: str) -> Column:
    """A small relation as one expression; the key is computed once, the map is a constant."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def event_lines(events: DataFrame, every_untimed: int = 0) -> DataFrame:
    """(log_id, line_no, raw, ...) of the events table, a line each; each `every_untimed`-th line has no time.

    The line number follows the event id, so no global ordering is needed.
    """
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "))
    if every_untimed:
        time = F.when(F.col("event_id") % every_untimed == 0, "").otherwise(time)
    raw = F.concat(
        time, lookup(SEVERITY, F.col("event_type"), "INFO"), F.lit(" source=U"), F.col("user_id"), F.lit(" "), lookup(CODE, F.col("event_type"), "B0000"),
        F.lit(" event_id=E-"), F.col("event_id"), F.lit(" "), F.col("event_type"), F.lit(" event value="), F.format_string("%.2f", "value"), F.lit(" k="), F.get_json_object("props", "$.k"),
    )
    return events.select(F.lit("events").alias("log_id"), (F.col("event_id") + 1).alias("line_no"), raw.alias("raw"), "event_id", "user_id", "event_type", "ts", "value")


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(log_id, line_no, raw) of texts that hold whole logs: split at line breaks, no white space at the right."""
    body = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"({LINE_BREAK})$", "")
    lines = df.select(F.col(id_col).alias("log_id"), F.posexplode(F.split(body, LINE_BREAK, -1)).alias("pos", "raw"))
    return lines.select("log_id", (F.col("pos") + 1).alias("line_no"), F.rtrim("raw").alias("raw"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw) of plain log files; the folder may be in any store."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.rtrim("value").alias("raw"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the file each came from; what does not parse is kept in `_corrupt_record`."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_name"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, text) of texts with lines "SECTION: name" or "TITLE: name", each with the lines below it.

    The lines of a document stay together in its own array: nothing is ordered across documents.
    """
    heads = r"^\s*(SECTION|TITLE):\s*(.*)$"
    block = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n(?=\s*(?:SECTION|TITLE):)"), lambda b: F.trim(b))
    each = df.select(F.col(id_col).alias("id"), F.explode(block).alias("block"))
    head = F.split("block", r"\r?\n")[0]
    return each.where(head.rlike(heads)).select("id", F.lower(F.trim(F.regexp_extract(head, heads, 2))).alias("section"), F.trim(F.regexp_replace("block", r"^[^\n]*\n?", "")).alias("text"))
