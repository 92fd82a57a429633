"""Queries over the events table as a log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.functions.hashing import canonical, sha256
from foldlog.operators import families as fam
from foldlog.operators.audit import drift_findings, replay_stability, retention
from foldlog.operators.frame import compression_summary, frames
from foldlog.operators.parse import parse_lines
from foldlog.operators.records import source_hashes
from foldlog.operators.signatures import DOMAIN_TERMS, STOP_WORDS
from foldlog.operators.reporting import drift_pivot, export_rows, incidents, service_health
from foldlog.session import cut, spread, table
from foldlog.sources.lines import event_lines


def lines(spark: SparkSession, sf_dir: str, every_untimed: int = 0) -> DataFrame:
    return event_lines(spread(table(spark, sf_dir, "events")), every_untimed)


def parsed(spark: SparkSession, sf_dir: str, every_untimed: int = 0) -> DataFrame:
    """Parsed lines with the family of module, severity and first code, which SQL can say too."""
    out = parse_lines(lines(spark, sf_dir, every_untimed), signatures=False)
    return out.withColumn("family", fam.plain_family(F.col("ecu"), F.col("severity"), F.col("codes")))


def iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


def parse_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("line_no", iso("timestamp").alias("at"), "severity", "ecu", F.array_join("codes", ",").alias("codes"), F.size("fields").cast("long").alias("n_fields"))


def fields_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("line_no", canonical(F.col("fields"), []).alias("fields"))


def header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.header(parsed(spark, sf_dir)).select("log_id", "event_count", iso("first_timestamp").alias("t0"), iso("last_timestamp").alias("t1"), "severity_counts")


def header_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.header(parsed(spark, sf_dir), "user_id").select("user_id", "event_count", iso("first_timestamp").alias("t0"), iso("last_timestamp").alias("t1"), "severity_counts")


def top_codes_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.top_codes(parsed(spark, sf_dir), 3, "user_id")


def topk_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the twelve most frequent families of the log."""
    return fam.top_families(parsed(spark, sf_dir), 12).select("log_id", "family", "n", "first_line", "rank", F.round("share", 6).alias("share"))


def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.family_coverage(parsed(spark, sf_dir), 2, "user_id").select("user_id", "families", F.round("coverage", 6).alias("coverage"))


def tumbling_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.bursts(parsed(spark, sf_dir), 3600, 8, by="log_id")


def untimed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.buckets(cut(parsed(spark, sf_dir, 10).select("user_id", "line_no", "timestamp")), 3600, "user_id").groupBy("user_id", "bucket").agg(F.count("*").alias("n"))


def consonant_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse_lines(lines(spark, sf_dir))
    return out.groupBy("signature", "family").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def frame_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lines(spark, sf_dir)
    return frames(parse_lines(raw), 600, 8, 16, by="user_id", hashes=source_hashes(raw, "user_id"))


def compression_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lines(spark, sf_dir)
    return compression_summary(raw, frames(parse_lines(raw), 600, 8, 16, by="user_id", hashes=source_hashes(raw, "user_id")), "user_id")


def corrupted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records as the table says, and events re-parsed from lines of which every 97th is lost, every 53rd changed."""
    records = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("U"), F.col("user_id")).alias("ecu"), "event_type")
    found = parsed(spark, sf_dir).where("event_id % 97 <> 0")
    found = found.select("event_id", F.when(F.col("event_id") % 53 == 0, "GEN").otherwise(F.col("ecu")).alias("ecu"), "event_type")
    return records, found


def positional_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, found = corrupted(spark, sf_dir)
    findings = drift_findings(records, found, ["event_id"], {"ecu": "HIGH", "event_type": "MEDIUM"})
    return retention(records, findings, "user_id", ["event_id"])


def drift_findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, found = corrupted(spark, sf_dir)
    return drift_findings(records, found, ["event_id"], {"ecu": "HIGH", "event_type": "MEDIUM"})


def user_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, found = corrupted(spark, sf_dir)
    return drift_findings(records, found, ["event_id"], {"ecu": "HIGH"}).join(records.select("event_id", "user_id"), "event_id")


def drift_pivot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_pivot(user_findings(spark, sf_dir), "user_id")


def replay_stability_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over each user's log, each in another order: their digests agree, as counts know no order."""
    base = parsed(spark, sf_dir)
    passes = None
    for k in range(3):
        one = base.repartition(4 + k, "line_no").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("line_no").alias("s"), F.min("raw").alias("first")).withColumn("pass", F.lit(k))
        passes = one if passes is None else passes.unionByName(one)
    return replay_stability(passes, "user_id", ["n", "s", "first"])


def line_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("line_no", sha256(F.col("raw")).alias("digest"))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("service")).agg(F.max("value").alias("peak"), F.sum((F.col("value") > 485).cast("long")).alias("failures"))
    return service_health(stats, 400.0)


def incidents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(health(spark, sf_dir), user_findings(spark, sf_dir), "user_id")


def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.groupBy("event_type").agg(F.count("*").alias("n"))
    b = e.groupBy("user_id").agg(F.max("event_id").alias("last_event"))
    return export_rows(a, b)


# SQL: the same lines, and what is parsed from them.
LINES = """lines AS (
  SELECT event_id, event_id + 1 AS line_no, user_id, event_type, ts, value,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'CRITICAL' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END
      || ' source=U' || user_id || ' ' || CASE event_type WHEN 'error' THEN 'P0301' WHEN 'signup' THEN 'U0100' WHEN 'purchase' THEN 'C0035' WHEN 'click' THEN 'B1000' WHEN 'view' THEN 'P0128' ELSE 'B0000' END
      || ' event_id=E-' || event_id || ' ' || event_type || ' event value=' || printf('%.2f', value) || ' k=' || json_extract_string(props, '$.k') AS raw
  FROM events)"""
PARSED = (
    LINES
    + r""", parsed AS (
  SELECT *, CASE upper(regexp_extract(raw, '(?i)\b(FATAL|CRITICAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE)\b', 1)) WHEN 'FATAL' THEN 'FATAL' WHEN 'CRITICAL' THEN 'CRIT' WHEN 'ERROR' THEN 'ERR' WHEN 'WARNING' THEN 'WARN' WHEN 'WARN' THEN 'WARN' WHEN 'DEBUG' THEN 'DBG' WHEN 'TRACE' THEN 'TRC' ELSE 'INFO' END AS severity,
    left(upper(regexp_extract(raw, '(?i)\b(?:module|source|ecu)\s*(?:=|:)\s*([A-Za-z0-9_-]+)', 1)), 12) AS ecu,
    list_distinct(list_transform(regexp_extract_all(raw, '(?i)\b([PCBU][0-9A-F]{4}|SPN\s*\d+|FMI\s*\d+|DTC[:= -]?[A-Z0-9-]+)\b', 1), lambda c: upper(c))) AS codes,
    strptime(regexp_extract(raw, '(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})', 1), '%Y-%m-%dT%H:%M:%S') AS t
  FROM lines), fam AS (SELECT *, ecu || ':' || severity || ':' || codes[1] AS family FROM parsed)"""
)
ISO = "'%Y-%m-%dT%H:%M:%S'"
DRIFT = """found AS (SELECT event_id, CASE WHEN event_id % 53 = 0 THEN 'GEN' ELSE ecu END AS ecu FROM fam WHERE event_id % 97 <> 0),
findings AS (SELECT e.event_id, e.user_id, CASE WHEN f.event_id IS NULL THEN 'event' ELSE 'ecu' END AS field, CASE WHEN f.event_id IS NULL THEN 'CRITICAL' ELSE 'HIGH' END AS level
  FROM events e LEFT JOIN found f USING (event_id) WHERE f.event_id IS NULL OR f.ecu <> 'U' || e.user_id)"""
HEALTH = "health AS (SELECT event_type AS service, max(value) AS peak, CAST(count(*) FILTER (WHERE value > 485) AS BIGINT) AS failures FROM events GROUP BY 1), judged AS (SELECT *, CASE WHEN failures > 0 THEN 'failing' WHEN peak > 400 THEN 'degraded' ELSE 'nominal' END AS status FROM health)"


# SQL: signatures. Tokens of the lines hold one pair at most inside another; deeper ones are tested in tests/test_signatures.py.
def _bare(x: str) -> str:
    return f"upper(regexp_replace({x}, '[AEIOUÄÖÜaeiouäöü]', '', 'g'))"


def _measured(x: str) -> str:
    return rf"(regexp_full_match({x}, '[-+]?\d+(?:[.,]\d+)?(?:%|[A-Za-z]{{1,5}})?') OR regexp_full_match({x}, '0x[0-9A-Fa-f]+'))"


def _measure(x: str) -> str:
    return f"CASE WHEN {x} LIKE '0x%' THEN '0x#' ELSE '#' || coalesce(nullif(upper(regexp_extract({x}, '([A-Za-z]+|%)$', 1)), ''), 'N') END"


def _word(x: str, pair: str = "NULL") -> str:
    """The part of a token; pair: the expression for a key=value token."""
    low = f"trim(lower({x}), '.,;|()[]{{}}')"
    terms = ", ".join(f"'{k}': '{v}'" for k, v in DOMAIN_TERMS.items())
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    squeezed = f"regexp_replace(array_to_string(list_filter(string_split({_bare(x)}, ''), lambda c, i: i = 1 OR c BETWEEN '0' AND '9' OR c <> string_split({_bare(x)}, '')[i - 1]), ''), '[^A-Z0-9_.:/+-]', '', 'g')"
    code = r"(?i)([PCBU][0-9A-F]{4}|SPN\s*\d+|FMI\s*\d+|DTC[:= -]?[A-Z0-9-]*[A-Z0-9])"
    return f"""CASE WHEN {low} IN ('', {stop}) THEN '' WHEN regexp_full_match({x}, '{code}') THEN upper({x}) WHEN {_measured(x)} THEN {_measure(x)}
      WHEN (MAP {{{terms}}})[{low}] IS NOT NULL THEN (MAP {{{terms}}})[{low}] WHEN regexp_matches({x}, '[=:]') THEN {pair} ELSE left({squeezed}, 8) END"""


def _said(x: str) -> str:
    return f"coalesce(nullif({_word(x)}, ''), 'EMPTY')"


def _pair(k: str, v: str) -> str:
    shown = f"CASE WHEN {_measured(v)} THEN {_measure(v)} WHEN lower({k}) IN ('axle', 'cylinder', 'cyl', 'fmi') THEN left({_bare(v)}, 8) ELSE left({_said(v)}, 6) END"
    return f"CASE WHEN lower({k}) IN ('ecu', 'module', 'source') THEN '' ELSE left({_bare(k)}, 6) || '=' || {shown} END"


FIELD_SQL = r"\b([A-Za-z][A-Za-z0-9_./-]{1,32})\s*(?:=|:)\s*([^\s,;|]+)"
TIMES_SQL = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
SIGNED = PARSED + rf""", cleaned AS (SELECT line_no, trim(regexp_replace(regexp_replace(regexp_replace(raw, '{TIMES_SQL}', '', 'g'), '(?i)\b(FATAL|CRITICAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE)\b', '', 'g'), '(?i)\b(?:ECU|module|source)\s*(?:=|:)\s*[A-Za-z0-9_-]+', '', 'g'), ' -|[]') AS text,
    regexp_extract_all(raw, '{FIELD_SQL}', 1) AS ks, regexp_extract_all(raw, '{FIELD_SQL}', 2) AS vs FROM parsed),
  tokens AS (SELECT line_no, i, ts[i] AS t, regexp_extract(ts[i], '^([^=:]*)[=:](.*)$', 1) AS k, regexp_extract(ts[i], '^([^=:]*)[=:](.*)$', 2) AS v FROM (SELECT line_no, regexp_extract_all(text, '[A-Za-z0-9_.:/+=-]+') AS ts FROM cleaned), LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS i)),
  parts AS (SELECT line_no, i, {_word('t', _pair('k', 'v'))} AS p FROM tokens),
  signed AS (SELECT line_no, array_to_string((list(p ORDER BY i) FILTER (p <> ''))[1:12], '.') AS s FROM parts GROUP BY line_no),
  kv AS (SELECT line_no, lower(ks[i]) AS k, vs[i] AS v FROM cleaned, LATERAL (SELECT unnest(range(1, len(ks) + 1)) AS i) QUALIFY row_number() OVER (PARTITION BY line_no, lower(ks[i]) ORDER BY i DESC) = 1),
  shown AS (SELECT line_no, left({_said('k')}, 6) || '=' || CASE WHEN {_measured('v')} THEN {_measure('v')} ELSE left({_said('v')}, 8) END AS f, row_number() OVER (PARTITION BY line_no ORDER BY k) AS j FROM kv WHERE k NOT IN ('ecu', 'module', 'source')),
  bits AS (SELECT line_no, string_agg(f, ',' ORDER BY j) FILTER (j <= 5) AS f FROM shown GROUP BY line_no),
  events_signed AS (SELECT p.*, coalesce(s.s, 'EMPTY') AS signature, ecu || ':' || severity || ':' || coalesce(codes[1], 'NO_CODE') || ':' || left(coalesce(s.s, 'EMPTY'), 32) || ':' || coalesce(b.f, CASE WHEN len(c.ks) = 0 THEN '-' ELSE '' END) AS family
    FROM parsed p JOIN cleaned c USING (line_no) LEFT JOIN signed s USING (line_no) LEFT JOIN bits b USING (line_no))"""
FRAMED = SIGNED + r""", e AS (SELECT * FROM events_signed),
  sev AS (SELECT user_id, severity, count(*) AS n FROM e GROUP BY ALL),
  head AS (SELECT user_id, count(*) AS event_count, min(t) AS t0, max(t) AS t1, upper(left(sha256(string_agg(raw, chr(10) ORDER BY line_no)), 16)) AS fp FROM e GROUP BY user_id),
  sevs AS (SELECT user_id, string_agg(severity || ':' || n, ',' ORDER BY severity) AS sev, string_agg(CASE severity WHEN 'FATAL' THEN 'F' WHEN 'CRIT' THEN 'C' WHEN 'ERR' THEN 'E' WHEN 'WARN' THEN 'W' WHEN 'INFO' THEN 'I' WHEN 'DBG' THEN 'D' WHEN 'TRC' THEN 'T' END || n, '' ORDER BY severity) AS short FROM sev GROUP BY user_id),
  fams AS (SELECT user_id, family, count(*) AS n, min(line_no) AS first_line, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(line_no), family) AS k FROM e GROUP BY user_id, family QUALIFY k <= 8),
  middle AS (SELECT user_id, max(n) AS most, string_agg('"F' || k || '":"' || family || '"', ',' ORDER BY 'F' || k) AS plain_d, string_agg('"F' || k || '":"' || family || '"', ',' ORDER BY k) AS d, string_agg('F' || k || '=' || n, ';' ORDER BY k) AS m, list(family || chr(1) || 'F' || k ORDER BY length(family) DESC, k) AS names FROM fams GROUP BY user_id),
  seen AS (SELECT user_id, codes[1] AS code, count(*) AS n, min(line_no) AS f FROM e WHERE len(codes) > 0 GROUP BY ALL),
  top_codes AS (SELECT user_id, string_agg(code || ':' || n, ',' ORDER BY k) AS codes, string_agg(code, ',' ORDER BY k) AS names FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM seen) WHERE k <= 10 GROUP BY user_id),
  dealt AS (SELECT e.user_id, family, line_no, CAST(floor((epoch(t) - epoch(t0)) / 600) AS BIGINT) AS bucket FROM e JOIN head USING (user_id)),
  within AS (SELECT user_id, bucket, family, count(*) AS n, row_number() OVER (PARTITION BY user_id, bucket ORDER BY count(*) DESC, min(line_no), family) AS k, CAST(sum(count(*)) OVER (PARTITION BY user_id, bucket) AS BIGINT) AS total FROM dealt GROUP BY user_id, bucket, family),
  full_buckets AS (SELECT user_id, bucket, any_value(total) AS total, string_agg(family || 'x' || n, ',' ORDER BY k) FILTER (k <= 4) AS families FROM within GROUP BY user_id, bucket QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY any_value(total) DESC, bucket) <= 16),
  bursts AS (SELECT b.user_id, string_agg(list_reduce(list_prepend('W' || bucket || ':' || families, names), lambda x, y: replace(x, split_part(y, chr(1), 1), split_part(y, chr(1), 2))), ';' ORDER BY total DESC, bucket) AS b FROM full_buckets b JOIN middle USING (user_id) GROUP BY b.user_id),
  firsts AS (SELECT user_id, string_agg(ecu || '.' || CASE severity WHEN 'FATAL' THEN 'F' WHEN 'CRIT' THEN 'C' WHEN 'ERR' THEN 'E' WHEN 'WARN' THEN 'W' WHEN 'INFO' THEN 'I' WHEN 'DBG' THEN 'D' WHEN 'TRC' THEN 'T' END || '.' || coalesce(codes[1], '-') || '.' || signature, ',' ORDER BY line_no) AS ls FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line_no) AS k FROM e) WHERE k <= 3 GROUP BY user_id),
  framed AS (SELECT h.user_id, h.event_count, h.event_count <= 3 AND most = 1 AS micro, CASE WHEN h.event_count <= 3 AND most = 1 THEN 'M|' || h.event_count || '|' || fp || '|' || short || '|' || coalesce(c.names, '-') || '|' || ls
    ELSE '{"d":{' || d || '},"h":{"codes":"' || coalesce(codes, '') || '","fp":"' || fp || '","n":' || h.event_count || ',"sev":"' || sev || '","t0":"' || strftime(t0, '%Y-%m-%dT%H:%M:%S') || '+00:00","t1":"' || strftime(t1, '%Y-%m-%dT%H:%M:%S') || '+00:00"},"m":"' || m || '","v":"F1","w":{"b":"' || b || '","s":600}}' END AS payload
    FROM head h JOIN sevs USING (user_id) JOIN middle USING (user_id) LEFT JOIN top_codes c USING (user_id) JOIN bursts USING (user_id) JOIN firsts USING (user_id))"""


def _header(by: str) -> str:
    return f"""WITH {PARSED}, s AS (SELECT {by} AS b, severity, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM fam GROUP BY ALL)
SELECT b AS {by.split(" ")[-1] if " " in by else by}, CAST(sum(n) AS BIGINT) AS event_count, strftime(min(t0), {ISO}) AS t0, strftime(max(t1), {ISO}) AS t1, string_agg(severity || ':' || n, ',' ORDER BY severity) AS severity_counts FROM s GROUP BY b"""


QUERIES = {
    "parse_lines": parse_lines_query, "fields_map": fields_map, "header_counts": header_counts, "header_by_user": header_by_user, "top_codes_by_user": top_codes_by_user, "topk_families": topk_families,
    "family_coverage": family_coverage, "tumbling_bursts": tumbling_bursts, "untimed_buckets": untimed_buckets, "consonant_signature": consonant_signature, "frame_payload": frame_payload,
    "compression_by_user": compression_by_user, "positional_audit": positional_audit, "drift_findings": drift_findings_query, "drift_pivot": drift_pivot_query, "replay_stability": replay_stability_query,
    "line_digests": line_digests, "service_health": health, "incidents": incidents_query, "csv_union": csv_union,
}

ORACLE_SQL = {
    "parse_lines": rf"WITH {PARSED} SELECT line_no, strftime(t, {ISO}) AS at, severity, ecu, array_to_string(codes, ',') AS codes, CAST(len(list_distinct(list_transform(regexp_extract_all(raw, '\b([A-Za-z][A-Za-z0-9_./-]{{1,32}})\s*(?:=|:)\s*([^\s,;|]+)', 1), lambda k: lower(k)))) AS BIGINT) AS n_fields FROM fam",
    "fields_map": rf"""WITH {LINES}, kv AS (SELECT line_no, unnest(regexp_extract_all(raw, '\b[A-Za-z][A-Za-z0-9_./-]{{1,32}}\s*(?:=|:)\s*[^\s,;|]+')) AS m FROM lines)
SELECT line_no, '{{' || string_agg(lower(regexp_extract(m, '^([^=:\s]+)\s*[=:]', 1)) || ':' || regexp_extract(m, '[=:]\s*(\S+)$', 1), ',' ORDER BY lower(regexp_extract(m, '^([^=:\s]+)\s*[=:]', 1))) || '}}' AS fields FROM kv GROUP BY line_no""",
    "header_counts": _header("'events'").replace("b AS 'events'", "b AS log_id"),
    "header_by_user": _header("user_id"),
    "top_codes_by_user": f"WITH {PARSED}, c AS (SELECT user_id, codes[1] AS code, count(*) AS n, min(line_no) AS f FROM fam GROUP BY ALL) SELECT user_id, code, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rank FROM c QUALIFY rank <= 3",
    "topk_families": f"WITH {PARSED}, c AS (SELECT family, count(*) AS n, min(line_no) AS first_line FROM fam GROUP BY 1) SELECT 'events' AS log_id, family, n, first_line, row_number() OVER (ORDER BY n DESC, first_line) AS rank, round(n / sum(n) OVER (), 6) AS share FROM c QUALIFY rank <= 12",
    "family_coverage": f"WITH {PARSED}, c AS (SELECT user_id, family, count(*) AS n, min(line_no) AS f FROM fam GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) SELECT user_id, count(*) AS families, round(CAST(sum(n) FILTER (WHERE k <= 2) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS coverage FROM r GROUP BY 1",
    "tumbling_bursts": f"""WITH {PARSED}, b AS (SELECT family, line_no, CAST(floor((epoch(t) - (SELECT min(epoch(t)) FROM fam)) / 3600) AS BIGINT) AS bucket FROM fam), c AS (SELECT bucket, family, count(*) AS n, min(line_no) AS f FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, f) AS k, CAST(sum(n) OVER (PARTITION BY bucket) AS BIGINT) AS total FROM c), g AS (SELECT bucket, any_value(total) AS n, string_agg(family || 'x' || n, ',' ORDER BY k) FILTER (WHERE k <= 4) AS families FROM r GROUP BY bucket)
SELECT 'events' AS log_id, row_number() OVER (ORDER BY n DESC, bucket) AS rank, bucket, n, families FROM g QUALIFY rank <= 8""",
    "untimed_buckets": f"""WITH {PARSED}, timed AS (SELECT user_id, t FROM fam WHERE event_id % 10 <> 0), z AS (SELECT user_id, min(t) AS t0 FROM timed GROUP BY 1),
b AS (SELECT user_id, CAST(floor((epoch(t) - epoch(t0)) / 3600) AS BIGINT) AS bucket FROM timed JOIN z USING (user_id) UNION ALL SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY line_no) - 1 FROM fam WHERE event_id % 10 = 0)
SELECT user_id, bucket, count(*) AS n FROM b GROUP BY ALL""",
    "consonant_signature": f"WITH {SIGNED} SELECT signature, family, count(*) AS n, min(line_no) AS first_line FROM events_signed GROUP BY ALL",
    "frame_payload": f"WITH {FRAMED} SELECT user_id, event_count, payload, micro FROM framed",
    "compression_by_user": f"""WITH {FRAMED}, o AS (SELECT user_id, CAST(sum(len(regexp_extract_all(raw, '[A-Za-z0-9_.:/+=-]+'))) AS BIGINT) AS original_tokens FROM e GROUP BY 1)
SELECT user_id, original_tokens, len(regexp_extract_all(payload, '[A-Za-z0-9_.:/+=-]+')) AS compressed_tokens, round(len(regexp_extract_all(payload, '[A-Za-z0-9_.:/+=-]+')) / original_tokens, 6) AS compressed_fraction, round((1 - len(regexp_extract_all(payload, '[A-Za-z0-9_.:/+=-]+')) / original_tokens) * 100, 4) AS reduction_percent FROM framed JOIN o USING (user_id)""",
    "positional_audit": f"WITH {PARSED}, {DRIFT}, w AS (SELECT event_id, count(*) FILTER (WHERE level = 'CRITICAL') AS c, count(*) FILTER (WHERE level = 'HIGH') AS h FROM findings GROUP BY 1) SELECT user_id, count(*) AS records, CAST(count(*) FILTER (WHERE c IS NULL) AS BIGINT) AS kept, CAST(coalesce(sum(c), 0) AS BIGINT) AS critical, CAST(coalesce(sum(h), 0) AS BIGINT) AS high, round(CAST(count(*) FILTER (WHERE c IS NULL) AS DOUBLE) / count(*), 6) AS retention, coalesce(sum(c), 0) = 0 AND coalesce(sum(h), 0) = 0 AS passed FROM events LEFT JOIN w USING (event_id) GROUP BY 1",
    "drift_findings": f"WITH {PARSED}, {DRIFT} SELECT event_id, field, level FROM findings",
    "drift_pivot": f"WITH {PARSED}, {DRIFT} SELECT user_id, count(*) FILTER (WHERE level = 'CRITICAL') AS critical, count(*) FILTER (WHERE level = 'HIGH') AS high, CAST(0 AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low FROM findings GROUP BY 1",
    "replay_stability": f"WITH {LINES} SELECT user_id, CAST(3 AS BIGINT) AS passes, CAST(1 AS BIGINT) AS digests, sha256(count(*) || '|' || CAST(sum(line_no) AS BIGINT) || '|' || min(raw)) AS digest, true AS stable FROM lines GROUP BY 1",
    "line_digests": f"WITH {LINES} SELECT line_no, sha256(raw) AS digest FROM lines",
    "service_health": f"WITH {HEALTH} SELECT service, peak, failures, status FROM judged",
    "incidents": f"WITH {PARSED}, {DRIFT}, {HEALTH}, u AS (SELECT service AS about, status AS reason FROM judged WHERE status <> 'nominal' UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'drift' FROM findings WHERE level = 'HIGH') SELECT reason || '-' || lpad(CAST(row_number() OVER (PARTITION BY reason ORDER BY about) AS VARCHAR), 4, '0') AS incident, about, reason FROM u",
    "csv_union": "SELECT event_type, count(*) AS n, NULL::BIGINT AS user_id, NULL::BIGINT AS last_event FROM events GROUP BY 1 UNION ALL SELECT NULL, NULL, user_id, max(event_id) FROM events GROUP BY user_id",
}
