"""Queries over documents, benchmark, labels, pages and parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.functions import text as T
from foldlog.functions.hashing import canonical, fnv1a, sha256
from foldlog.operators.audit import evidence_survival
from foldlog.operators.references import budget_select, first_by_keys, manifest, reference_index, registered, scheme_of, uri_problem
from foldlog.operators.reporting import search
from foldlog.session import table
from foldlog.sources.lines import text_lines

# Words that are no keywords.
STOP = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "was", "with", "as", "on", "be", "by", "this", "are", "from", "or"]


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.token_count(F.col("text")).alias("tokens"))


def sha_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("digest"))


def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fnv1a(F.col("c_name")).alias("hash"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.groupBy(F.col("log_id").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum((F.trim("raw") == "").cast("long")).alias("blank"))


def keyword_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every language and of none."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.limited(T.keywords(F.col("text"), STOP), 10), ",").alias("keywords"))


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation: how many keywords of its first turn come back in its last."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    k = lambda c: T.keywords(F.lower(F.col(c)), STOP)
    return turns.select("conv_id", F.round(T.overlap(k("a"), k("b")), 6).alias("overlap"), F.round(T.jaccard(k("a"), k("b")), 6).alias("jaccard"), F.round(T.coverage(k("a"), k("b"), 1.0), 6).alias("coverage"))


def benchmark_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a user: codes that events name, original by their type, replayed by what the user's last events hold."""
    e = table(spark, sf_dir, "events").withColumn("evidence_id", F.get_json_object("props", "$.k"))
    original = e.groupBy("user_id", "evidence_id").agg(F.min_by("event_type", "event_id").alias("value"))
    replayed = e.groupBy("user_id", "evidence_id").agg(F.max_by("event_type", "event_id").alias("value"))
    evidence = original.select("user_id", "evidence_id", F.when(F.col("value") == "error", "HIGH").otherwise("LOW").alias("criticality"))
    return evidence_survival(evidence, original, replayed, "user_id")


def criticality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by source: labelled documents, HIGH if toxic, surviving where the document has a label of quality 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("evidence_id", F.col("doc_id").cast("string"))
    evidence = labels.select("source", "evidence_id", F.when(F.col("toxic") == 1, "HIGH").otherwise("LOW").alias("criticality"))
    original = labels.select("source", "evidence_id", F.lit("1").alias("value"))
    replayed = labels.where("quality = 1").select("source", "evidence_id", F.lit("1").alias("value"))
    return evidence_survival(evidence, original, replayed, "source")


def coverage_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of customers of each nation that ordered."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    has = o.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1))
    return c.join(has, "c_custkey", "left").groupBy("c_nationkey").agg(F.round(F.count("has") / F.count("*"), 6).alias("coverage"))


def missing_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("unlabelled"))


def reference_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which neither address nor content hash stands in a page kept before."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host_key"), sha256(F.col("html")).alias("hash"))
    keyed = pages.withColumn("host_key", F.concat_ws("#", "host_key", (F.col("page_id") % 50).cast("string")))
    return first_by_keys(keyed, "page_id", ["host_key", "hash"])


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as references of two indexes: the even ones, then all. Some share an id, an address or a hash with others."""
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    refs = p.select(F.concat(F.lit("file-"), n % 171).alias("id"), F.concat(F.lit("file://pages/"), n % 190).alias("uri"), F.when(n % 9 == 0, F.sha2((n % 40).cast("string"), 256)).otherwise(F.sha2("html", 256)).alias("hash"), (n % 7).alias("created_at"), n.alias("page_id"), (F.char_length("url") % 40 + 1).cast("long").alias("tokens"), (n % 11 / 10).alias("relevance"))
    return refs.where(n % 2 == 0).withColumn("at", F.col("page_id")).unionByName(refs.withColumn("at", F.col("page_id") + 10**9))


def reference_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_index(page_references(spark, sf_dir), "at").select("place", "id", "uri", "hash", "created_at")


def budget_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each day registered, then chosen within 60 tokens."""
    kept = registered(page_references(spark, sf_dir), "at", "created_at")
    return budget_select(kept.select("created_at", "id", "relevance", "tokens"), "created_at", 60)


def reference_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References made of pages: derived id, validity and scheme of their addresses."""
    p = table(spark, sf_dir, "pages")
    uri = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("file://"), F.regexp_extract("url", r"//[^/]+(/.*)$", 1))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("mem://page/"), F.col("page_id"))).when(F.col("page_id") % 5 == 2, F.concat(F.lit("file://pages/../"), F.col("page_id"))).when(F.col("page_id") % 5 == 3, F.concat(F.lit("file://pages/"), F.col("page_id"))).otherwise(F.col("url"))
    return p.select("page_id", uri.alias("uri")).select("page_id", uri_problem(F.col("uri")).alias("problem"), scheme_of(F.col("uri")).alias("scheme"))


def parts_as_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("relevance"), F.col("p_size").cast("long").alias("tokens"), (F.col("p_size").cast("long") * 3).alias("raw_tokens"))


def budget_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_select(parts_as_references(spark, sf_dir), "p_brand", 300).select("p_brand", "id", "taken", "used")


def budget_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(budget_select(parts_as_references(spark, sf_dir), "p_brand", 300), "p_brand")


def volatile_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    entries = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("traceId"), F.col("event_id").cast("string"), F.lit("type"), F.col("event_type")))
    return e.select("event_id", canonical(entries).alias("payload"), sha256(canonical(entries)).alias("digest"))


def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "part"), "  RED ", ["p_name", "p_type"]).select("p_partkey", "p_name")


def redact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.redacted(F.split("text", "\n"), "(?i)(token|password|secret)")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, lambda x: x == "[redacted]")).cast("long").alias("hidden"), sha256(F.array_join(lines, "\n")).alias("digest"))


WORDS = "'[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*'"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
KEYS = f"list_filter(list_transform(regexp_extract_all({{0}}, {WORDS}), lambda w: lower(w)), lambda w: NOT list_contains({STOP_SQL}, w))"
SURVIVAL = """, j AS (SELECT e.*, o.value AS o, r.value AS r FROM ev e LEFT JOIN orig o USING ({0}, evidence_id) LEFT JOIN repl r USING ({0}, evidence_id)),
k AS (SELECT *, CASE WHEN o IS NOT NULL AND r IS NOT NULL AND o = r THEN 1 ELSE 0 END AS ok, CASE WHEN criticality = 'HIGH' THEN 1 ELSE 0 END AS high FROM j)
SELECT {0}, count(*) AS evidence_total, CAST(sum(ok) AS BIGINT) AS evidence_survived, round(CAST(sum(ok) AS DOUBLE) / count(*), 6) AS evidence_survival_rate, sum(high) > 0 AS has_high,
  round(CASE WHEN sum(high) > 0 THEN CAST(sum(ok * high) AS DOUBLE) / CAST(sum(high) AS DOUBLE) ELSE 0.0 END, 6) AS high_survival_rate FROM k GROUP BY 1"""
PICK = """r AS (SELECT p_brand, p_partkey AS id, p_retailprice AS relevance, CAST(p_size AS BIGINT) AS tokens, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) AS k FROM part),
pick AS (SELECT p_brand, id, tokens, k, tokens <= 300 AS taken, CASE WHEN tokens <= 300 THEN tokens ELSE 0 END AS used FROM r WHERE k = 1
  UNION ALL SELECT r.p_brand, r.id, r.tokens, r.k, pick.used + r.tokens <= 300, CASE WHEN pick.used + r.tokens <= 300 THEN pick.used + r.tokens ELSE pick.used END FROM pick JOIN r ON r.p_brand = pick.p_brand AND r.k = pick.k + 1)"""

# a fold over rows in order: what a row may not share with those kept before is carried along
FOLD = """keyed AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM given),
folded AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, false AS kept UNION ALL
  SELECT k.i, CASE WHEN list_has_any(seen, keys) THEN seen ELSE seen || keys END, NOT list_has_any(seen, keys) FROM folded f JOIN keyed k ON k.i = f.i + 1)"""
PAGES = """refs AS (SELECT 'file-' || (page_id % 171) AS id, 'file://pages/' || (page_id % 190) AS uri, CASE WHEN page_id % 9 = 0 THEN sha256(CAST(page_id % 40 AS VARCHAR)) ELSE sha256(html) END AS hash, page_id % 7 AS created_at, page_id, CAST(length(url) % 40 + 1 AS BIGINT) AS tokens, (page_id % 11) / 10.0::DOUBLE AS relevance FROM pages),
every AS (SELECT *, page_id AS pos FROM refs WHERE page_id % 2 = 0 UNION ALL SELECT *, page_id + 1000000000 FROM refs)"""

QUERIES = {
    "reference_index": reference_index_query, "budget_registered": budget_registered,
    "token_counts": token_counts, "sha_digest": sha_digest, "fnv_hash": fnv_hash, "line_counts": line_counts, "keyword_sets": keyword_sets, "keyword_sets_all": keyword_sets, "keyword_overlap": keyword_overlap,
    "evidence_survival": benchmark_evidence, "criticality_gate": criticality_gate, "coverage_semijoin": coverage_semijoin, "missing_antijoin": missing_antijoin, "reference_dedup": reference_dedup,
    "uri_validation": reference_registry, "budget_select": budget_selection, "budget_manifest": budget_manifest, "volatile_normalise": volatile_normalise, "search_filter": search_filter, "redact_lines": redact_lines,
}

ORACLE_SQL = {
    "reference_dedup": f"WITH RECURSIVE given AS (SELECT page_id, page_id AS pos, regexp_extract(url, '^https?://([^/]+)/', 1) || '#' || (page_id % 50) AS host_key, sha256(html) AS hash, ['h' || host_key, 'x' || hash] AS keys FROM pages), {FOLD} SELECT page_id, host_key, hash FROM keyed JOIN folded USING (i) WHERE kept",
    "reference_index": f"WITH RECURSIVE {PAGES}, given AS (SELECT *, ['i' || id, 'u' || uri, 'h' || hash] AS keys FROM every), {FOLD} SELECT row_number() OVER (ORDER BY created_at, id, uri, hash) AS place, id, uri, hash, created_at FROM keyed JOIN folded USING (i) WHERE kept",
    "budget_registered": f"""WITH RECURSIVE {PAGES}, given AS (SELECT *, [created_at || 'u' || uri, created_at || 'h' || hash] AS keys FROM every), {FOLD},
one AS (SELECT * FROM keyed JOIN folded USING (i) WHERE kept QUALIFY row_number() OVER (PARTITION BY created_at, id ORDER BY pos) = 1), o AS (SELECT *, row_number() OVER (PARTITION BY created_at ORDER BY relevance DESC, tokens, id) AS k FROM one),
chosen AS (SELECT DISTINCT created_at, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, false AS taken FROM o UNION ALL SELECT o.created_at, o.k, CASE WHEN c.used + o.tokens <= 60 THEN c.used + o.tokens ELSE c.used END, c.used + o.tokens <= 60 FROM chosen c JOIN o ON o.created_at = c.created_at AND o.k = c.k + 1)
SELECT o.created_at, o.id, o.relevance, o.tokens, c.taken, c.used FROM o JOIN chosen c USING (created_at, k)""",
    "token_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, {WORDS})) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_.:/+=-]+')) AS BIGINT) AS tokens FROM documents",
    "sha_digest": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "fnv_hash": "SELECT c_custkey, lpad(printf('%x', list_reduce(list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))), 8, '0') AS hash FROM customer",
    "line_counts": "WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS raw FROM documents) SELECT doc_id, count(*) AS lines, CAST(count(*) FILTER (WHERE trim(raw) = '') AS BIGINT) AS blank FROM l GROUP BY 1",
    "keyword_sets": f"WITH k AS (SELECT doc_id, {KEYS.format("coalesce(text, '')")} AS ws FROM documents), u AS (SELECT doc_id, ws, list_distinct(ws) AS d FROM k), o AS (SELECT doc_id, list_sort(list_slice(list_sort(list_transform(d, lambda w: {{'at': list_position(ws, w), 'w': w}})), 1, 10)) AS x FROM u) SELECT doc_id, array_to_string(list_sort(list_transform(x, lambda s: s.w)), ',') AS keywords FROM o",
    "keyword_overlap": f"""WITH t AS (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS b FROM conversations GROUP BY 1), k AS (SELECT conv_id, list_distinct({KEYS.format('lower(a)')}) AS a, list_distinct({KEYS.format('lower(b)')}) AS b FROM t), n AS (SELECT conv_id, len(a) AS na, len(list_distinct(list_concat(a, b))) AS nu, len(list_intersect(a, b)) AS ni FROM k)
SELECT conv_id, round(CASE WHEN na = 0 THEN 0.0 ELSE CAST(ni AS DOUBLE) / na END, 6) AS overlap, round(CASE WHEN nu = 0 THEN 1.0 ELSE CAST(ni AS DOUBLE) / nu END, 6) AS jaccard, round(CASE WHEN na = 0 THEN 1.0 ELSE CAST(ni AS DOUBLE) / na END, 6) AS coverage FROM n""",
    "evidence_survival": "WITH e AS (SELECT *, json_extract_string(props, '$.k') AS evidence_id FROM events), orig AS (SELECT user_id, evidence_id, arg_min(event_type, event_id) AS value FROM e GROUP BY ALL), repl AS (SELECT user_id, evidence_id, arg_max(event_type, event_id) AS value FROM e GROUP BY ALL), ev AS (SELECT user_id, evidence_id, CASE WHEN value = 'error' THEN 'HIGH' ELSE 'LOW' END AS criticality FROM orig)" + SURVIVAL.format("user_id"),
    "criticality_gate": "WITH l AS (SELECT source, CAST(doc_id AS VARCHAR) AS evidence_id, quality, toxic FROM labels JOIN documents USING (doc_id)), ev AS (SELECT source, evidence_id, CASE WHEN toxic = 1 THEN 'HIGH' ELSE 'LOW' END AS criticality FROM l), orig AS (SELECT source, evidence_id, '1' AS value FROM l), repl AS (SELECT source, evidence_id, '1' AS value FROM l WHERE quality = 1)" + SURVIVAL.format("source"),
    "coverage_semijoin": "SELECT c_nationkey, round(CAST(count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS DOUBLE) / count(*), 6) AS coverage FROM customer GROUP BY 1",
    "missing_antijoin": "SELECT source, count(*) AS unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "uri_validation": r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'file://' || regexp_extract(url, '//[^/]+(/.*)$', 1) WHEN 1 THEN 'mem://page/' || page_id WHEN 2 THEN 'file://pages/../' || page_id WHEN 3 THEN 'file://pages/' || page_id ELSE url END AS uri FROM pages), p AS (SELECT page_id, uri, regexp_extract(uri, '^([A-Za-z]+)://(.*)$', 1) AS s, regexp_extract(uri, '^([A-Za-z]+)://(.*)$', 2) AS path FROM u)
SELECT page_id, CASE WHEN s = '' THEN 'format' WHEN s NOT IN ('ctx', 'mem', 'replay', 'artifact', 'tool', 'file', 'run') THEN 'scheme' WHEN s <> 'file' THEN NULL WHEN trim(path) = '' THEN 'empty' WHEN path LIKE '/%' THEN 'absolute' WHEN contains(path, '..') THEN 'traversal' END AS problem, CASE WHEN s IN ('ctx', 'mem', 'replay', 'artifact', 'tool', 'file', 'run') THEN s END AS scheme FROM p""",
    "budget_select": f"WITH RECURSIVE {PICK} SELECT p_brand, id, taken, used FROM pick",
    "budget_manifest": f"WITH RECURSIVE {PICK} SELECT p_brand, CAST(count(*) FILTER (WHERE taken) AS BIGINT) AS n_selected, CAST(count(*) FILTER (WHERE NOT taken) AS BIGINT) AS n_omitted, CAST(coalesce(sum(tokens) FILTER (WHERE taken), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(2 * tokens) FILTER (WHERE taken), 0) AS BIGINT) AS raw_tokens_avoided FROM pick GROUP BY 1",
    "volatile_normalise": "WITH p AS (SELECT event_id, '{k:' || json_extract_string(props, '$.k') || ',traceId:[volatile],type:' || event_type || '}' AS payload FROM events) SELECT event_id, payload, sha256(payload) AS digest FROM p",
    "search_filter": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')",
    "redact_lines": "WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '(?i)(token|password|secret)') THEN '[redacted]' ELSE x END) AS ls FROM documents) SELECT doc_id, CAST(len(list_filter(ls, lambda x: x = '[redacted]')) AS BIGINT) AS hidden, sha256(array_to_string(ls, chr(10))) AS digest FROM l",
}

ORACLE_SQL["keyword_sets_all"] = ORACLE_SQL["keyword_sets"]
