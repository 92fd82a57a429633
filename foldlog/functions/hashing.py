"""Digests and canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of the 32-bit FNV-1a hash, and the keys whose values change from run to run.
FNV_OFFSET, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295
VOLATILE = {
    "traceId": "[RUNTIME_ID_STRIPPED]", "requestId": "[RUNTIME_ID_STRIPPED]", "runRequestId": "[RUNTIME_ID_STRIPPED]", "processId": "[RUNTIME_ID_STRIPPED]", "pid": "[RUNTIME_ID_STRIPPED]",
    "sessionId": "[RUNTIME_ID_STRIPPED]", "spanId": "[RUNTIME_ID_STRIPPED]", "serverUptime": "[UPTIME_STRIPPED]", "uptime": "[UPTIME_STRIPPED]",
    "timestamp": "[TIMESTAMP_STRIPPED]", "timestamps": "[TIMESTAMP_STRIPPED]", "createdAt": "[TIMESTAMP_STRIPPED]", "updatedAt": "[TIMESTAMP_STRIPPED]", "startedAt": "[TIMESTAMP_STRIPPED]",
    "finishedAt": "[TIMESTAMP_STRIPPED]", "durationMs": "[DURATION_STRIPPED]", "latencyMs": "[DURATION_STRIPPED]", "elapsedMs": "[DURATION_STRIPPED]",
}
VOLATILE_KEYS = list(VOLATILE)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the code units, eight hexadecimal digits; for text of the basic plane."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.lpad(F.lower(F.hex(F.aggregate(chars, F.lit(FNV_OFFSET).cast("long"), step))), 8, "0")


def canonical(entries: Column, volatile: list[str] | None = None) -> Column:
    """A MAP<STRING, STRING> as text with sorted keys; values of volatile keys become one placeholder.

    json_text.canonical_json() takes JSON of any nesting and names the kind of what it replaces.
    """
    volatile = VOLATILE_KEYS if volatile is None else volatile
    shown = F.transform_values(entries, lambda k, v: F.when(k.isin(volatile), F.lit("[volatile]")).otherwise(F.coalesce(v, F.lit("null"))))
    sorted_entries = F.array_sort(F.map_entries(shown))
    return F.concat(F.lit("{"), F.array_join(F.transform(sorted_entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","), F.lit("}"))
