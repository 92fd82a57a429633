"""Queries of checks, records and JSON payloads over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.functions.hashing import VOLATILE, sha256
from foldlog.functions.json_text import canonical_json, first_unsafe_path, stable_hash, string_array
from foldlog.operators import records as R
from foldlog.operators.signals import signal_windows
from foldlog.plans.log_queries import LINES, PARSED, drift_findings_query, lines, parsed
from foldlog.plans.run_queries import EV, SIG, conversation_events, labelled, user_signals
from foldlog.session import spread, table

#: Payloads hold every volatile key at the top and within an object in a list.
KEYS = sorted(VOLATILE)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested payload of each event, keys in no order."""
    volatile = [F.col("event_id").cast("string").alias(k) for k in reversed(KEYS)]
    inner = F.struct(*volatile, F.col("event_type").alias("kind"))
    body = F.struct(F.array(inner).alias("steps"), *volatile, F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("b")).alias("about"), F.array("event_type", F.lit("x")).alias("refs"), F.lit(True).alias("Ok"))
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")
    return events.select("event_id", "user_id", "event_type", F.to_json(body).alias("payload"))


def payload_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    steady = payloads(spark, sf_dir).select("event_id", canonical_json(F.col("payload"), volatile=True).alias("payload"))
    return steady.withColumns({"digest": sha256(F.col("payload")), "n_chars": F.char_length("payload").cast("long")})


def payload_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON as it is, and with numbers rounded to three places."""
    e = table(spark, sf_dir, "events")
    raw = F.to_json(F.struct(F.col("value").alias("z"), F.struct(F.col("user_id").alias("m"), F.col("event_type").alias("a")).alias("b")))
    return e.select("event_id", canonical_json(raw, digits=3).alias("payload"), F.substring(stable_hash(canonical_json(F.to_json(F.struct("event_type")))), 1, 6).alias("scheme"))


def payload_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads(spark, sf_dir)
    return p.select("event_id", F.array_join(string_array(F.col("payload"), "refs"), ",").alias("refs"), F.size(string_array(F.col("payload"), "steps")).cast("long").alias("steps"))


def unsafe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts made of events: raw contents under some, bodies within metadata under others."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 7 == 0, F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("fileData"))).alias("parts"))))
    text = text.when(F.col("event_id") % 7 == 1, F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("body")).alias("x")).alias("metadata"))))
    text = text.otherwise(F.to_json(F.struct(F.struct(F.col("event_type").alias("body")).alias("page"))))
    return e.select("event_id", first_unsafe_path(text).alias("path"))


def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_hashes(lines(spark, sf_dir), "user_id")


def user_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check for each day of a user: no more than a third of its events are errors."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.avg((F.col("event_type") == "error").cast("double")) <= 1 / 3).alias("ok"))
    return R.gates(days, "user_id", "ok")


def nation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as artifacts of their nation: required in the first segment, present where they ordered."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    has = o.select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("present")).distinct()
    rows = c.select("c_custkey", "c_nationkey", (F.col("c_mktsegment") == "BUILDING").alias("required")).join(has, "c_custkey", "left")
    return R.overall_status(rows, "c_nationkey", "required", "present")


def label_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure labels as 0 and 1, and why a user counts as collapsed."""
    m = labelled(spark, sf_dir)
    reason = R.collapse_reason(F.col("labels"), ["BLOCKER_DETACHMENT"], F.col("replay"), 0.55, F.col("has"), F.col("rate"), 0.2, 1 - F.col("constraint"), 0.15)
    return m.select("user_id", *(v.alias(k) for k, v in R.label_counts(F.col("labels")).items()), reason.alias("reason"), R.rate_text(F.when(F.col("has"), F.col("rate"))).alias("rate"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift_findings_query(spark, sf_dir).withColumn("dataset", F.concat(F.lit("log.part."), F.col("event_id") % 5))
    return R.enriched_findings(found, "dataset", "event_id", "level", "field")


def retention_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_id") % 97 != 0).cast("long")).alias("kept"), F.count_distinct("event_type").alias("codes"))
    return e.select("user_id", F.round(R.retention_blend(F.col("n"), F.col("kept"), F.col("codes"), F.col("codes")), 6).alias("blend"))


def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark-like evidence: the codes a user's events name, in order of appearance, that its errors never name."""
    e = table(spark, sf_dir, "events").withColumn("evidence_id", F.get_json_object("props", "$.k"))
    named = e.groupBy("user_id", "evidence_id").agg(F.min("event_id").alias("position"))
    return R.missing_evidence(named, e.where("event_type = 'error'"), "user_id")


def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", R.request_id(F.col("c_name")).alias("safe"), R.request_id(F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" x")).otherwise(F.lit("")))).alias("maybe"))


def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    relevance = F.when(F.col("page_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("page_id") / 100)
    tokens = F.when(F.col("page_id") % 13 == 0, F.lit(-1.0)).when(F.col("page_id") % 13 == 1, F.lit(0.5)).otherwise(F.lit(7.0))
    return p.select("page_id", R.reference_id(F.lit("url"), sha256(F.col("url"))).alias("id"), R.reference_problem(relevance, tokens).alias("problem"), F.round(R.clamped_relevance(relevance), 6).alias("relevance"))


def token_signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a user and day against the user's mean: values as tokens, the share without errors as consistency; errors alone have no tokens."""
    e = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long") + 1)
    d = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.sum((F.col("event_type") != "error").cast("long")).alias("fine"))
    base = d.groupBy("user_id").agg(F.sum("n").alias("tn"), F.sum("fine").alias("tf"), F.count("*").alias("days"))
    j = d.join(base, "user_id").select("user_id", "day", F.when(F.col("fine") > 0, F.col("n").cast("double")).alias("token_estimate"), (F.col("tn") / F.col("days")).alias("base_tokens"), (F.col("fine") / F.col("n")).alias("consistency"), (F.col("tf") / F.col("tn")).alias("base_consistency"))
    return R.token_signals(j).select("user_id", "day", "token_cost_spike", "replay_consistency_drop")


def quality_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("score", F.col("p_size").cast("long"))
    return p.select("p_partkey", R.quality_explanation(F.col("score"), F.col("p_size") % 3, F.col("p_size") % 2, F.col("score") * 20, F.lit(500)).alias("text"))


def evidence_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A locator of each event: of itself, of its line, or of what is not there."""
    e = lines(spark, sf_dir)
    k = F.col("event_id") % 3
    locator = F.when(k == 0, F.concat(F.lit("event:"), "event_id")).when(k == 1, F.concat(F.lit(" Line : "), "line_no")).otherwise(F.concat(F.lit("section:"), "event_type"))
    sources = {"event": e.select("user_id", F.col("event_id").alias("key"), F.col("event_type").alias("value")), "line": e.select("user_id", F.col("line_no").alias("key"), sha256(F.col("raw")).alias("value"))}
    return R.resolved(e.select("user_id", "event_id", locator.alias("locator")), "user_id", sources).select("event_id", "locator", "value")


def last_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_quality(conversation_events(spark, sf_dir), "execution_id", "seq", "quality")


def timeline_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_references(conversation_events(spark, sf_dir), "execution_id", "seq", "ref")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("("), F.upper(F.regexp_extract("p_name", "^[a-z]+", 0)), F.lit(");"))
    return p.select("p_partkey", R.entity(name).alias("entity"), R.holds_entity(name, F.col("p_name")).alias("named"), R.holds_entity(F.lit(" ;. "), F.col("p_name")).alias("empty"))


def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of a user's errors, of which some users have none."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(R.mean_or_one(F.when((F.col("event_type") == "error") & (F.col("value") > 50), F.col("value"))), 4).alias("mean"))


def reconstruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    return p.select("line_no", R.reconstruction_line(F.col("ecu"), F.col("severity"), F.col("codes"), {"line_no": F.col("line_no")}).alias("line"))


def artifact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal windows of a user summed up; days of one event have no tokens."""
    w = signal_windows(user_signals(spark, sf_dir))
    reasons = R.signal_reasons(["compression_ratio_drop", "sparse_frame_spike", "unseen_signature"], F.col("band"), F.col("entering"))
    w = w.select(F.col("execution_id").alias("user_id"), "band", F.col("error").alias("ratio"), F.when(F.col("compression_ratio") > 1, F.col("compression_ratio").cast("long")).alias("tokens"), reasons.alias("reasons"))
    return R.artifact_summary(w, "user_id", F.col("band").isin("deliberation", "rollback_required"), "ratio", "tokens", "reasons")


def token_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.token_digest(F.col("text")).alias("digest"))


def _payload_sql() -> str:
    pair = {k: f'"{k}":"{v}"' for k, v in VOLATILE.items()}
    inner = ",".join(v for _, v in sorted({**pair, "kind": '"kind":"\' || event_type || \'"'}.items()))
    parts = {**pair, "Ok": '"Ok":true', "about": '"about":{"b":"\' || event_type || \'","u":\' || user_id || \'}', "refs": '"refs":["\' || event_type || \'","x"]', "steps": f'"steps":[{{{inner}}}]'}
    return "'{" + ",".join(v for _, v in sorted(parts.items())) + "}'"


FOUND = "found AS (SELECT event_id, event_id % 97 = 0 AS gone, event_id % 53 = 0 AS changed FROM events), findings AS (SELECT event_id, CASE WHEN gone THEN 'event' ELSE 'ecu' END AS field, CASE WHEN gone THEN 'CRITICAL' ELSE 'HIGH' END AS level FROM found WHERE gone OR changed)"
#: Half up to three places, clamped.
PLACES = "floor((least(1, greatest(0, {0})) + 2.220446049250313e-16) * 1000 + 0.5) / 1000"

QUERIES = {
    "payload_canonical": payload_canonical, "payload_sorted": payload_sorted, "payload_refs": payload_refs, "unsafe_keys": unsafe_keys, "source_hash": source_hash, "gates": user_gates, "overall_status": nation_status,
    "label_flags": label_flags, "enriched_findings": enriched, "retention_blend": retention_blend, "missing_evidence": missing_evidence, "request_ids": request_ids, "reference_ids": reference_ids, "token_signals": token_signal_rows,
    "quality_texts": quality_texts, "evidence_locators": evidence_locators, "last_quality": last_qualities, "timeline_references": timeline_references, "entities": entities, "mean_scores": mean_scores,
    "reconstruction_lines": reconstruction_lines, "artifact_summary": artifact_summary, "token_digests": token_digests,
}

ORACLE_SQL = {
    "payload_canonical": f"WITH p AS (SELECT event_id, {_payload_sql()} AS payload FROM events) SELECT event_id, payload, sha256(payload) AS digest, length(payload) AS n_chars FROM p",
    "payload_sorted": """SELECT event_id, '{"b":{"a":"' || event_type || '","m":' || user_id || '},"z":' || CAST(round(value, 3) AS VARCHAR) || '}' AS payload, 'fnv1a:' AS scheme FROM events""",
    "payload_refs": "SELECT event_id, event_type || ',x' AS refs, CAST(0 AS BIGINT) AS steps FROM events",
    "unsafe_keys": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'parts[0].fileData' WHEN 1 THEN 'metadata.x.body' END AS path FROM events",
    "source_hash": f"WITH {LINES} SELECT user_id, upper(left(sha256(string_agg(raw, chr(10) ORDER BY line_no)), 16)) AS fp FROM lines GROUP BY 1",
    "gates": "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0 END) <= 1.0::DOUBLE / 3 AS ok FROM events GROUP BY ALL) SELECT user_id, count(*) AS n, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_passed, round(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*), 6) AS pass_rate, bool_and(ok) AS all_passed, bool_or(ok) AS any_passed FROM d GROUP BY 1",
    "overall_status": "WITH r AS (SELECT c_nationkey, c_mktsegment = 'BUILDING' AS need, c_custkey NOT IN (SELECT o_custkey FROM orders) AS gone FROM customer) SELECT c_nationkey, CASE WHEN bool_or(need AND gone) THEN 'red' WHEN bool_or(gone AND NOT need) THEN 'yellow' ELSE 'green' END AS status FROM r GROUP BY 1",
    "label_flags": """WITH m AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS t, count(*) FILTER (WHERE event_type = 'error' AND value < 150) AS s, round(CAST(count(*) FILTER (WHERE value < 300) AS DOUBLE) / count(*), 6) AS replay,
  round(CAST(count(*) FILTER (WHERE value < 400) AS DOUBLE) / count(*), 6) AS c, round(CAST(count(*) FILTER (WHERE value < 450) AS DOUBLE) / count(*), 6) AS b FROM events GROUP BY 1), r AS (SELECT *, round(CASE WHEN t > 0 THEN CAST(s AS DOUBLE) / t ELSE 0.0 END, 6) AS rate FROM m)
SELECT user_id, CAST(t > 0 AND (s < t OR rate < 1) AS INT) AS evidence_loss, CAST(0 AS INT) AS high_critical_evidence_loss, CAST(c < 1 AS INT) AS constraint_drift, CAST(b < 1 AS INT) AS blocker_detachment,
  CASE WHEN b < 1 THEN 'fatal_failure_mode:BLOCKER_DETACHMENT' WHEN replay < 0.55 THEN 'min_replay_consistency' WHEN t > 0 AND rate < 0.2 THEN 'min_high_critical_evidence_survival_rate' WHEN 1 - c > 0.15 THEN 'max_operational_drift_rate' END AS reason, CASE WHEN t > 0 THEN printf('%.6f', rate) ELSE 'N/A' END AS rate FROM r""",
    "enriched_findings": f"WITH {FOUND}, k AS (SELECT *, 'log.part.' || (event_id % 5) AS dataset, row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) AS k FROM findings) SELECT 'FND-LOG-PART-' || (event_id % 5) || '-' || printf('%03d', k) AS id, dataset, level AS severity, CASE field WHEN 'event' THEN 'Event' ELSE 'Ecu' END AS title, 'Safety Assurance' AS owner FROM k",
    "retention_blend": "WITH m AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_id % 97 <> 0) AS kept, count(DISTINCT event_type) AS codes FROM events GROUP BY 1) SELECT user_id, round(least(0.99::DOUBLE, 0.7::DOUBLE * kept / n + 0.2::DOUBLE + 0.09::DOUBLE * least(1.0::DOUBLE, codes / 4.0::DOUBLE)), 6) AS blend FROM m",
    "missing_evidence": "WITH e AS (SELECT user_id, event_id, event_type, json_extract_string(props, '$.k') AS k FROM events), x AS (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'error') SELECT e.user_id, min(event_id) AS position, e.k AS evidence_id FROM e LEFT JOIN x ON x.user_id = e.user_id AND x.k = e.k WHERE x.k IS NULL GROUP BY e.user_id, e.k",
    "request_ids": "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^[A-Za-z0-9._:#-]{1,128}$') AND c_name NOT LIKE '%#%' THEN c_name END AS safe, CASE WHEN c_custkey % 2 = 1 AND regexp_matches(c_name, '^[A-Za-z0-9._:-]{1,128}$') THEN c_name END AS maybe FROM customer",
    "reference_ids": "SELECT page_id, 'url-' || right(sha256(url), 12) AS id, CASE WHEN page_id % 11 = 0 THEN 'relevance' WHEN page_id % 13 < 2 THEN 'tokens' END AS problem, round(CASE WHEN page_id % 11 = 0 THEN 0.0 ELSE least(1.0, page_id / 100.0::DOUBLE) END, 6) AS relevance FROM pages",
    "token_signals": f"""WITH e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS day, event_type FROM events), d AS (SELECT user_id, day, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS fine FROM e GROUP BY ALL),
b AS (SELECT user_id, CAST(sum(n) AS DOUBLE) AS tn, CAST(sum(fine) AS DOUBLE) AS tf, count(*) AS days FROM d GROUP BY 1)
SELECT d.user_id, d.day, CASE WHEN fine > 0 THEN {PLACES.format("(n - tn / days) / (tn / days)")} END AS token_cost_spike, CASE WHEN tf > 0 THEN {PLACES.format("(tf / tn - CAST(fine AS DOUBLE) / n) / (tf / tn)")} ELSE 0.0 END AS replay_consistency_drop FROM d JOIN b USING (user_id)""",
    "quality_texts": "SELECT p_partkey, 'Deterministic quality score ' || p_size || ': ' || CASE WHEN p_size % 3 > 0 THEN 'linked replay/reference evidence present' ELSE 'no replay/reference evidence linked' END || '; ' || CASE WHEN p_size % 2 > 0 THEN 'rollback evidence includes snapshots or artifacts' ELSE 'rollback evidence missing' END || '; ' || (CAST(p_size AS BIGINT) * 20) || '/500 ' || CASE WHEN p_size * 20 <= 500 THEN 'tokens used within budget' ELSE 'tokens exceeded budget' END || '.' AS text FROM part",
    "evidence_locators": f"WITH {LINES} SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'event:' || event_id WHEN 1 THEN ' Line : ' || line_no ELSE 'section:' || event_type END AS locator, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN sha256(raw) END AS value FROM lines",
    "last_quality": f"WITH {EV} SELECT execution_id, arg_max(quality, seq) FILTER (WHERE quality IS NOT NULL) AS quality FROM e GROUP BY 1",
    "timeline_references": f"WITH {EV}, f AS (SELECT execution_id, ref, min(seq) AS first FROM e WHERE ref IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY first, ref) AS k FROM f",
    "entities": "WITH x AS (SELECT p_partkey, upper(regexp_extract(p_name, '^[a-z]+')) AS entity, p_name FROM part) SELECT p_partkey, entity, entity <> '' AND contains(lower(p_name), lower(entity)) AS named, false AS empty FROM x",
    "mean_scores": "SELECT user_id, round(coalesce(avg(value) FILTER (WHERE event_type = 'error' AND value > 50), 1.0), 4) AS mean FROM events GROUP BY 1",
    "reconstruction_lines": f"""WITH {PARSED} SELECT line_no, '{{"codes":["' || array_to_string(codes, '","') || '"],"ecu":"' || ecu || '","line_no":' || line_no || ',"severity":"' || severity || '"}}' AS line FROM fam""",
    "artifact_summary": f"""WITH {SIG}, v AS (SELECT y.*, d.n, CASE WHEN error >= 0.85 THEN 'rollback_required' WHEN error < 0.3 THEN 'habit' WHEN error <= 0.55 THEN 'monitor' WHEN error >= 0.62 THEN 'deliberation' ELSE 'monitor' END AS band FROM y JOIN d USING (user_id, day)),
r AS (SELECT user_id, unnest([CASE WHEN c > 0 THEN 'compression_ratio_drop' END, CASE WHEN s > 0 THEN 'sparse_frame_spike' END, CASE WHEN u > 0 THEN 'unseen_signature' END, CASE WHEN band <> 'habit' THEN 'band:' || band END, CASE WHEN entering THEN 'entered_deliberation' END]) AS r FROM v),
g AS (SELECT user_id, string_agg(DISTINCT r, ',' ORDER BY r) AS reasons FROM r WHERE r IS NOT NULL GROUP BY 1)
SELECT user_id, count(*) AS windows, count(*) FILTER (WHERE band IN ('deliberation', 'rollback_required')) AS triggered, round(avg(error), 6) AS mean_ratio, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS tokens, coalesce(any_value(reasons), '') AS reasons FROM v LEFT JOIN g USING (user_id) GROUP BY user_id""",
    "token_digests": "SELECT doc_id, sha256('[' || coalesce(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.:/+=-]+'), lambda x: '\"' || x || '\"'), ','), '') || ']') AS digest FROM documents",
}
