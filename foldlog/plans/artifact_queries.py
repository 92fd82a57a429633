"""Queries of replay artifacts made of users' events, whole and spoilt, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.operators import artifacts as A
from foldlog.session import cut, table


def made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """Heads, parts, steps and their mappings: two in three steps are mapped; some wrongly."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", "ts")
    n = F.col("event_id")
    heads = e.groupBy("user_id").agg(F.count("*").alias("eventCount"), F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt")).withColumn("artifactId", F.concat(F.lit("artifact-"), "user_id"))
    prints = e.select("user_id", F.concat_ws("|", "event_id", "event_type", F.sha2("props", 256)).alias("text"))
    references = e.where(n % 10 == 0).select("user_id", F.concat(F.lit("ctx://events/"), n).alias("text"))
    mapped = e.where((n % 3 != 0) & (n % 97 != 0)).unionByName(e.where(n % 89 == 0)).unionByName(e.where((n % 83 == 0) & (n % 3 != 0))).unionByName(e.where(n % 101 == 0).withColumn("event_id", -n - 1)).select("user_id", "event_id")
    unmapped = e.where((n % 3 == 0) & (n % 97 != 0)).unionByName(e.where(n % 103 == 0).withColumn("event_id", -n - 100_000_000)).select("user_id", "event_id")
    mappings = mapped.select("user_id", F.concat(F.lit("m"), "event_id").alias("text")).unionByName(unmapped.select("user_id", F.concat(F.lit("u"), "event_id").alias("text")))
    return heads, {"fingerprints": prints, "references": references, "mappings": mappings}, e.select("user_id", "event_id"), mapped, unmapped


def replay_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, parts, _, _, _ = made(spark, sf_dir)
    return A.assembled(heads, parts, "user_id")


def artifact_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of which most are spoilt after they were made: a version, a time, a count, raw contents, a whole part, a single row."""
    heads, parts, steps, mapped, unmapped = made(spark, sf_dir)
    whole = cut(A.assembled(heads, parts, "user_id"))
    k, text = F.col("user_id") % 8, F.col("artifact")
    swap = lambda a, b: F.regexp_replace(text, a, b)
    spoilt = F.when(k == 1, swap("v1-alpha.1", "v2")).when(k == 2, swap('"createdAt":"[^"]*",', "")).when(k == 3, swap('"eventCount":', '"eventCount":1')).when(k == 4, swap(r"\}$", ',"metadata":{"content":"x"}}')).when(k == 5, F.lit("{no json")).otherwise(text)
    left = {**parts, "references": parts["references"].where("user_id % 8 <> 6"), "fingerprints": parts["fingerprints"].where("NOT (user_id % 8 = 7 AND text LIKE '%|error|%')")}
    return A.artifact_problems(whole.withColumn("artifact", spoilt), left, steps, mapped, unmapped, "user_id", "event_id")


_FNV = "lpad(printf('%x', list_reduce(list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))), 8, '0')"
_LANE = "CAST(sum(CAST('0x' || substr(sha256(text), {}, 15) AS HUGEINT)) AS VARCHAR)"
_digest = lambda rows: f"SELECT user_id, count(*) || ':' || {_LANE.format(1)} || ':' || {_LANE.format(16)} AS d FROM {rows} GROUP BY user_id"
MADE = f"""e AS (SELECT event_id, user_id, event_type, props, ts FROM events), fp AS (SELECT user_id, event_id || '|' || event_type || '|' || sha256(props) AS text, event_type FROM e),
rf AS (SELECT user_id, 'ctx://events/' || event_id AS text FROM e WHERE event_id % 10 = 0),
m AS (SELECT user_id, event_id FROM e WHERE event_id % 3 <> 0 AND event_id % 97 <> 0 UNION ALL SELECT user_id, event_id FROM e WHERE event_id % 89 = 0 UNION ALL SELECT user_id, event_id FROM e WHERE event_id % 83 = 0 AND event_id % 3 <> 0 UNION ALL SELECT user_id, -event_id - 1 FROM e WHERE event_id % 101 = 0),
u AS (SELECT user_id, event_id FROM e WHERE event_id % 3 = 0 AND event_id % 97 <> 0 UNION ALL SELECT user_id, -event_id - 100000000 FROM e WHERE event_id % 103 = 0), mp AS (SELECT user_id, 'm' || event_id AS text FROM m UNION ALL SELECT user_id, 'u' || event_id FROM u),
d1 AS ({_digest('fp')}), d2 AS ({_digest('mp')}), d3 AS ({_digest('rf')}), h AS (SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS t FROM e GROUP BY user_id),
j AS (SELECT h.user_id, '{{"artifactId":"artifact-' || h.user_id || '","createdAt":"' || t || '","eventCount":' || n || ',"executionId":"' || h.user_id || '","integrity":{{' AS a, '"artifactHashAlgorithm":"fnv1a-32","deterministicSerializationVersion":1,"normalizationVersion":1}},"parts":{{"fingerprints":"' || coalesce(d1.d, '0') || '","mappings":"' || coalesce(d2.d, '0') || '","references":"' || coalesce(d3.d, '0') || '"}},"schemaVersion":"v1-alpha.1"}}' AS b, d3.d AS refs
  FROM h LEFT JOIN d1 USING (user_id) LEFT JOIN d2 USING (user_id) LEFT JOIN d3 USING (user_id)),
x AS (SELECT *, 'fnv1a:' || {_FNV.format('a || b')} AS hash FROM j)"""

QUERIES = {"replay_artifacts": replay_artifacts, "artifact_problems": artifact_problems}

_each = lambda name, when: f"SELECT user_id, '{name}' AS problem, NULL::VARCHAR AS detail FROM h WHERE {when}"
ORACLE_SQL = {
    "replay_artifacts": f"""WITH {MADE} SELECT user_id, a || '"artifactHash":"' || hash || '",' || b AS artifact, hash AS artifact_hash FROM x""",
    "artifact_problems": f"""WITH {MADE}, s AS (SELECT user_id, CAST(event_id AS VARCHAR) AS detail, 's' AS k FROM e UNION ALL SELECT user_id, CAST(event_id AS VARCHAR), 'm' FROM m UNION ALL SELECT user_id, CAST(event_id AS VARCHAR), 'u' FROM u),
c AS (SELECT user_id, detail, count(*) FILTER (k = 's') AS s, count(*) FILTER (k = 'm') AS m, count(*) FILTER (k = 'u') AS u FROM s GROUP BY ALL)
{" UNION ALL ".join([
    _each("schemaVersion", "user_id % 8 IN (1, 5)"), _each("artifactHash mismatch", "user_id % 8 IN (1, 2, 3)"), _each("missing createdAt", "user_id % 8 IN (2, 5)"), _each("raw contents", "user_id % 8 = 4"),
    *(_each(p, "user_id % 8 = 5") for p in ("normalizationVersion", "deterministicSerializationVersion", "artifactHashAlgorithm", "missing artifactId", "missing executionId", "missing artifactHash", "missing parts")),
    "SELECT user_id, 'part is empty', 'references' FROM x WHERE user_id % 8 = 6 AND refs IS NOT NULL", "SELECT user_id, CASE WHEN bool_and(event_type = 'error') THEN 'part is empty' ELSE 'part differs' END, 'fingerprints' FROM fp WHERE user_id % 8 = 7 GROUP BY user_id HAVING bool_or(event_type = 'error')",
    "SELECT user_id, 'duplicate mapped step', detail FROM c WHERE m > 1", "SELECT user_id, 'duplicate unmapped step', detail FROM c WHERE u > 1", "SELECT user_id, 'step is neither mapped nor unmapped', detail FROM c WHERE s > 0 AND m + u = 0",
    "SELECT user_id, 'step is mapped and unmapped', detail FROM c WHERE m > 0 AND u > 0", "SELECT user_id, 'unknown mapped step', detail FROM c WHERE s = 0 AND m > 0", "SELECT user_id, 'unknown unmapped step', detail FROM c WHERE s = 0 AND u > 0",
])}""",
}
