"""Structured-log parsing: time, severity, module, codes, fields and family key of a line, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.operators.signatures import CODE, CONTEXT_KEYS, event_signatures
from foldlog.sources.lines import lookup

# Patterns and vocabularies that results depend on.
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
SEVERITY = r"(?i)\b(FATAL|CRITICAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE)\b"
MODULE = r"(?i)\b(ECU|ACM|CPC|MCM|TCM|ABS|EBS|SCR|ICU|XENTRY|PTCAN|CGW|SAM|MR|FR)\b"
MODULE_FIELD = r"(?i)\b(?:module|source|ecu)\s*(?:=|:)\s*([A-Za-z0-9_-]+)"
FIELD = r"\b([A-Za-z][A-Za-z0-9_./-]{1,32})\s*(?:=|:)\s*([^\s,;|]+)"
SEVERITY_ALIASES = {"FATAL": "FATAL", "CRITICAL": "CRIT", "ERROR": "ERR", "WARNING": "WARN", "WARN": "WARN", "INFO": "INFO", "DEBUG": "DBG", "TRACE": "TRC"}
#: Fields that a family key shows.
FIELDS = 5
SEVERITY_SHORT = {"FATAL": "F", "CRIT": "C", "ERR": "E", "WARN": "W", "INFO": "I", "DBG": "D", "TRC": "T"}


def timestamp(line: Column) -> Column:
    """The first time in the line, in UTC; null where there is none or it is no valid time."""
    found = F.regexp_replace(F.regexp_extract(line, TIMESTAMP, 0), " ", "T")
    return F.try_to_timestamp(F.when(found != "", found))


def severity(line: Column) -> Column:
    return lookup(SEVERITY_ALIASES, F.upper(F.regexp_extract(line, SEVERITY, 1)), "INFO")


def severity_short(name: Column) -> Column:
    """A letter for a severity; S for an empty one."""
    known = lookup(SEVERITY_SHORT, name, "")
    return F.when(known != "", known).when(name != "", F.left(name, F.lit(1))).otherwise("S")


def module(line: Column) -> Column:
    """The value of a module, source or ecu field, else a known module's name, else GEN."""
    named, known = F.regexp_extract(line, MODULE_FIELD, 1), F.regexp_extract(line, MODULE, 1)
    return F.when(named != "", F.left(F.upper(named), F.lit(12))).when(known != "", F.upper(known)).otherwise("GEN")


def codes(line: Column) -> Column:
    """Distinct diagnostic codes in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(CODE), F.lit(1)), lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))))


def fields(line: Column) -> Column:
    """The key=value and key:value pairs as a map; of repeated keys the last counts."""
    group = lambda k: F.regexp_extract_all(line, F.lit(FIELD), F.lit(k))
    keys, values = F.transform(group(1), F.lower), group(2)
    last = lambda p: F.map_from_arrays(F.array_distinct(p["keys"]), F.transform(F.array_distinct(p["keys"]), lambda k: F.element_at(p["values"], (F.size(p["keys"]) + 1 - F.array_position(F.reverse(p["keys"]), k)).cast("int"))))
    made = lambda p: F.when(F.size(F.array_distinct(p["keys"])) == F.size(p["keys"]), F.map_from_arrays(p["keys"], p["values"])).otherwise(last(p))
    return F.element_at(F.transform(F.array(F.struct(keys.alias("keys"), values.alias("values"))), made), 1)


def without_prefixes(line: Column) -> Column:
    """The line without its times, severities and module fields, and without marks at its ends."""
    out = F.regexp_replace(F.regexp_replace(line, TIMESTAMP, ""), SEVERITY, "")
    return F.btrim(F.regexp_replace(out, r"(?i)\b(?:ECU|module|source)\s*(?:=|:)\s*[A-Za-z0-9_-]+", ""), F.lit(" -|[]"))


def parse_lines(lines: DataFrame, signatures: bool = True) -> DataFrame:
    """Adds to (log_id, line_no, raw) the parsed parts; blank lines are dropped. Row by row, without a shuffle.

    With `signatures` also the consonant signature, the fingerprint and the family key.
    """
    raw = F.col("raw")
    out = lines.where(F.trim(raw) != "").withColumns({"timestamp": timestamp(raw), "severity": severity(raw), "ecu": module(raw), "codes": codes(raw), "fields": fields(raw)})
    if not signatures:
        return out
    keys = F.slice(F.filter(F.sort_array(F.map_keys("fields")), lambda k: ~k.isin(CONTEXT_KEYS)), 1, FIELDS)
    values = F.transform(keys, lambda k: F.col("fields")[k])
    made = event_signatures(without_prefixes(raw), keys, values, F.concat_ws("|", "severity", "ecu", F.array_join("codes", ",")))
    first_code = F.when(F.size("codes") > 0, F.col("codes")[0]).otherwise("NO_CODE")
    shown = F.when(F.size("fields") == 0, "-").otherwise(F.col("_made.fields"))
    out = out.withColumn("_made", made).withColumns({"signature": F.col("_made.signature"), "fingerprint": F.col("_made.fingerprint"), "family": F.concat_ws(":", "ecu", "severity", first_code, F.left("_made.signature", F.lit(32)), shown)})
    return out.drop("_made")
