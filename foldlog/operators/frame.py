"""The compact frame of a log: one payload text a log, from its header, families and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlog.functions.text import token_count
from foldlog.operators.families import bursts, header, top_codes, top_families
from foldlog.operators.parse import severity_short
from foldlog.session import cut


def frames(events: DataFrame, seconds: int = 60, max_families: int = 12, max_bursts: int = 8, by: str = "log_id", hashes: DataFrame | None = None) -> DataFrame:
    """(by, event_count, payload, micro): the frame of each log from parsed lines.

    A log of one to three events whose families are all different gets a short synopsis, any other a JSON text
    with a dictionary of its families, under which counts and bursts are written. What is gathered for a log is
    bounded: families and bursts by their limits, codes by ten, lines of a synopsis by three. hashes: (by, fp), the
    source hashes of the logs' lines, which both payloads name; without them neither does.
    """
    events = cut(events.select(by, "line_no", "timestamp", "severity", "ecu", "codes", "signature", "family"))  # read five times
    head = header(events, by)
    families = top_families(events, max_families, by).withColumn("name", F.concat(F.lit("F"), F.col("rank")))
    middle = families.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "family", "n", "name"))).alias("fs"), F.max("n").alias("most"))
    codes = top_codes(events, 10, by).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "code", "n"))).alias("cs"))
    burst = bursts(events, seconds, max_bursts, by=by).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "bucket", "families"))).alias("bs"))
    first = events.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("line_no"))).where("k <= 3")
    line = F.concat_ws(".", "ecu", severity_short(F.col("severity")), F.when(F.size("codes") > 0, F.col("codes")[0]).otherwise("-"), "signature")
    synopsis = first.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("k", line.alias("t")))).alias("ls"))
    rows = head.join(middle, by).join(codes, by, "left").join(burst, by).join(synopsis, by)
    rows, fp = (rows, []) if hashes is None else (rows.join(hashes.select(by, "fp"), by), ["fp"])
    rows = rows.withColumn("cs", F.coalesce("cs", F.expr("cast(array() as array<struct<rank: bigint, code: string, n: bigint>>)")))
    longest_first = F.array_sort("fs", lambda a, b: F.when(F.char_length(b["family"]) != F.char_length(a["family"]), F.char_length(b["family"]) - F.char_length(a["family"])).otherwise((a["rank"] - b["rank"]).cast("int")))
    encoded = lambda text: F.aggregate(longest_first, text, lambda t, f: F.replace(t, f["family"], f["name"]))
    shown_bursts = F.array_join(F.transform("bs", lambda b: encoded(F.concat(F.lit("W"), b["bucket"], F.lit(":"), b["families"]))), ";")
    counts = F.array_join(F.transform("fs", lambda f: F.concat(f["name"], F.lit("="), f["n"])), ";")
    code_counts = F.array_join(F.transform("cs", lambda c: F.concat(c["code"], F.lit(":"), c["n"])), ",")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    full = F.to_json(F.struct(
        F.map_from_arrays(F.transform("fs", lambda f: f["name"]), F.transform("fs", lambda f: f["family"])).alias("d"),
        F.struct(code_counts.alias("codes"), *fp, F.col("event_count").alias("n"), F.col("severity_counts").alias("sev"), iso("first_timestamp").alias("t0"), iso("last_timestamp").alias("t1")).alias("h"),
        counts.alias("m"), F.lit("F1").alias("v"), F.struct(shown_bursts.alias("b"), F.lit(seconds).alias("s")).alias("w"),
    ), {"ignoreNullFields": "false"})
    short_names = F.array_join(F.transform(F.split("severity_counts", ","), lambda s: F.concat(severity_short(F.split(s, ":")[0]), F.split(s, ":")[1])), "")
    code_names = F.array_join(F.transform("cs", lambda c: c["code"]), ",")
    short = F.concat_ws("|", F.lit("M"), F.col("event_count"), *fp, short_names, F.when(code_names == "", "-").otherwise(code_names), F.array_join(F.transform("ls", lambda x: x["t"]), ","))
    micro = (F.col("event_count") <= 3) & (F.col("most") == 1)
    return rows.select(by, "event_count", F.when(micro, short).otherwise(full).alias("payload"), micro.alias("micro"))


def compression_summary(lines: DataFrame, framed: DataFrame, by: str = "log_id") -> DataFrame:
    """(by, original_tokens, compressed_tokens, compressed_fraction, reduction_percent) of raw lines and their frames."""
    raw = lines.groupBy(by).agg(F.sum(token_count(F.col("raw"))).alias("original_tokens"))
    both = raw.join(framed.select(by, token_count(F.col("payload")).alias("compressed_tokens")), by)
    fraction = F.when(F.col("original_tokens") == 0, 1.0).otherwise(F.col("compressed_tokens") / F.col("original_tokens"))
    return both.withColumns({"compressed_fraction": F.round(fraction, 6), "reduction_percent": F.round((1 - fraction) * 100, 4)})
