"""Queries over conversations, events and orders as runs, series and signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.functions import numbers as N
from foldlog.functions.text import word_count
from foldlog.operators.reporting import correlation, quality_score
from foldlog.operators.series import chain_measures, ordered_score
from foldlog.operators.records import token_signals
from foldlog.operators.signals import REASONS, map_steps, signal_modes, signal_windows, steps_up_to, window_reasons
from foldlog.operators.timeline import compare_runs, running_snapshots, timeline_summary
from foldlog.session import table


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as executions: a turn is a step, its words its tokens, its first word a reference."""
    c = table(spark, sf_dir, "conversations")
    n = word_count(F.col("text"))
    return c.select(
        F.col("conv_id").alias("execution_id"), F.col("turn").alias("seq"), F.col("role").alias("event_type"), F.when(F.col("role") == "assistant", "completed").otherwise("running").alias("status"),
        F.when(F.col("role") == "assistant", 0).otherwise(n).alias("token_in"), F.when(F.col("role") == "assistant", n).otherwise(0).alias("token_out"),
        F.lower(F.regexp_extract("text", r"[A-Za-z0-9]+", 0)).alias("ref"), F.when(F.col("turn") % 2 == 1, F.round(n / 1000, 3)).alias("quality"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_summary(conversation_events(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_snapshots(conversation_events(spark, sf_dir))


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against the next."""
    e = conversation_events(spark, sf_dir)
    ids = e.select(F.col("execution_id").alias("left_id")).distinct()
    return compare_runs(e, ids.select("left_id", (F.col("left_id") + 1).alias("right_id")))


def conversation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline_summary(conversation_events(spark, sf_dir))
    tokens = F.col("token_in") + F.col("token_out")
    parts = {
        "validity": N.ratio(F.col("n_assistant"), F.col("event_count")), "specificity": N.ratio(F.col("n_user"), F.col("event_count")), "correctness": N.ratio(F.col("refs"), F.col("event_count")),
        "traceability": N.clamp(F.when(F.col("event_count") > 0, 0.5).otherwise(0.0) + F.least(F.lit(0.5), F.col("refs") / 8)),
        "rollback_safety": N.clamp(F.when(F.col("n_assistant") > 0, 0.5).otherwise(0.0) + F.least(F.lit(0.5), F.col("refs") / 4)),
        "token_efficiency": F.when(tokens <= 0, 1.0).otherwise(N.clamp((400 - tokens) / 400)),
    }
    weights = {"validity": 0.2, "specificity": 0.15, "correctness": 0.25, "traceability": 0.15, "rollback_safety": 0.15, "token_efficiency": 0.1}
    return t.select("execution_id", F.round(quality_score(parts, weights), 2).alias("score"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, n, score): events of a user and day, and the share of those of at most 245 in value."""
    e = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long") + 1)
    return e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") <= 245).cast("double")), 6).alias("score"))


def series_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_measures(daily(spark, sf_dir), "user_id", "day", "score").select("user_id", F.round("acceleration", 4).alias("acceleration"), "collapse", "half_life", "longevity", "final")


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the order of a customer's orders by date agrees with that by price."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("a"),
        F.transform(F.sort_array(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("b"),
    )
    return o.select("o_custkey", F.round(ordered_score(F.col("a"), F.col("b")), 6).alias("score"))


def user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal a user and day against the user's means: counts as ratios, errors as sparse rate, high values as unseen."""
    e = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long") + 1)
    d = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("err"), F.sum((F.col("value") > 60).cast("long")).alias("big"))
    base = d.groupBy("user_id").agg(F.sum("n").alias("tn"), F.sum("err").alias("te"), F.count("*").alias("days"))
    j = d.join(base, "user_id")
    return j.select(F.col("user_id").alias("execution_id"), F.col("day").alias("window_id"), F.col("day").alias("at"), F.col("n").cast("double").alias("compression_ratio"), (F.col("tn") / F.col("days")).alias("base_ratio"), (F.col("err") / F.col("n")).alias("sparse_rate"), (F.col("te") / F.col("tn")).alias("base_sparse"), (F.col("big") / F.col("n")).alias("unseen_rate"))


def signal_window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_windows(user_signals(spark, sf_dir)).select("execution_id", "window_id", "compression_ratio_drop", "sparse_frame_spike", "unseen_signature", "error", "band", "entering")


def signal_mode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_modes(signal_windows(user_signals(spark, sf_dir))).select("execution_id", "window_id", "error", "mode", "triggered")


def signal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of windows whose tokens are known on two days in three, their replay consistency on three in four."""
    s = user_signals(spark, sf_dir)
    known = lambda k, c: F.when(F.col("at") % k != 0, c)
    s = s.withColumns({"token_estimate": known(3, F.col("compression_ratio") * 10), "base_tokens": F.col("base_ratio") * 10, "consistency": known(4, 1 - F.col("sparse_rate")), "base_consistency": 1 - F.col("base_sparse")})
    w = window_reasons(token_signals(signal_modes(signal_windows(s))))
    return w.select("execution_id", "window_id", "mode", "token_cost_spike", "replay_consistency_drop", F.array_join("reasons", ";").alias("reasons"))


def seconds(column: str):
    return F.unix_timestamp(F.date_trunc("second", column))


def signal_step_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within half an hour before each error of the same user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds("ts").alias("at"))
    signals = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("window_id"), (F.col("at") - 1800).alias("start"), F.col("at").alias("end"))
    return map_steps(signals, e.select("user_id", F.col("event_id").alias("step_id"), "at"), "user_id", 1800)


def signal_step_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event to its user's next error, the event itself included."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds("ts").alias("at"))
    signals = e.where("event_type = 'error'").groupBy("user_id", F.col("at").alias("end")).agg(F.min("event_id").cast("string").alias("window_id"))
    return steps_up_to(signals, e.select("user_id", F.col("event_id").alias("step_id"), "at"), "user_id")


def user_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    share = lambda c: F.round(F.sum(c.cast("long")) / F.count("*"), 6)
    return e.groupBy("user_id").agg(
        F.sum((F.col("event_type") == "error").cast("long")).alias("evidence_total"), F.sum(((F.col("event_type") == "error") & (F.col("value") < 150)).cast("long")).alias("evidence_survived"),
        share(F.col("value") < 300).alias("replay"), share(F.col("value") < 400).alias("constraint"), share(F.col("value") < 450).alias("blocker"), share(F.col("value") < 45).alias("reduced"),
    )


def with_rates(m: DataFrame) -> DataFrame:
    has = F.col("evidence_total") > 0
    return m.withColumns({"has": has, "rate": F.round(F.when(has, F.col("evidence_survived") / F.col("evidence_total")).otherwise(0.0), 6)})


def profile_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = with_rates(user_metrics(spark, sf_dir))
    p = N.selected_profile(F.col("rate"), F.col("has"), F.lit(1.0), F.lit(False), F.col("replay"), F.col("constraint"), F.col("blocker"), F.col("reduced") * 100)
    out = m.select("user_id", p.alias("profile"))
    params = None
    for name, (window, families, *_rest) in N.PROFILES.items():
        pair = F.struct(F.lit(window).alias("w"), F.lit(families).alias("f"))
        params = F.when(F.col("profile") == name, pair) if params is None else params.when(F.col("profile") == name, pair)
    return out.withColumn("p", params).select("user_id", "profile", F.col("p.w").cast("long").alias("window_seconds"), F.col("p.f").cast("long").alias("max_families"))


def profile_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("user_id", *(N.list_limit(F.col("n"), p[1], 12).cast("long").alias(name.lower()) for name, p in N.PROFILES.items()))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = with_rates(user_metrics(spark, sf_dir))
    return m.withColumn("labels", N.failure_labels(F.col("has"), F.col("evidence_survived"), F.col("evidence_total"), F.col("rate"), F.lit(False), F.lit(1.0), F.col("constraint"), F.col("blocker")))


def failure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("user_id", F.array_join("labels", ",").alias("labels"))


def degradation_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by tens: how many collapsed (replay below one half), mean replay, labels found, severity."""
    g = labelled(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("team")).agg(
        F.count("*").alias("runs"), F.sum((F.col("replay") < 0.5).cast("long")).alias("collapsed"), F.round(F.avg("replay"), 4).alias("consistency"), F.collect_set("labels").alias("ls"), F.sum(F.size("labels")).alias("failures")
    )
    return g.select("team", "runs", "collapsed", "consistency", F.array_join(N.merged_labels(F.col("ls")), ",").alias("labels"), "failures", N.degradation_severity(F.col("collapsed"), F.col("failures"), F.col("consistency"), 1 - F.col("consistency")).alias("severity"))


def pearson_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_suppkey").agg(F.round(F.median("l_quantity"), 4).alias("median"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 4).alias("mean"))


def decision_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules for an event, one by its type, one by its value, and how often they agree for a user."""
    e = table(spark, sf_dir, "events")
    a = F.when(F.col("event_type") == "error", "halt").when(F.col("event_type") == "purchase", "inspect").otherwise("continue")
    b = F.when(F.col("value") > 200, "halt").when(F.col("value") > 100, "inspect").otherwise("continue")
    return e.groupBy("user_id").agg(F.round(F.avg((a == b).cast("double")), 6).alias("alignment"), F.sum((a == b).cast("long")).alias("agreed"))


EV = r"""ev AS (SELECT conv_id AS execution_id, turn AS seq, role AS event_type, CASE WHEN role = 'assistant' THEN 'completed' ELSE 'running' END AS status, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*')) AS n, lower(regexp_extract(text, '[A-Za-z0-9]+')) AS ref FROM conversations),
e AS (SELECT *, CASE WHEN event_type = 'assistant' THEN 0 ELSE n END AS token_in, CASE WHEN event_type = 'assistant' THEN n ELSE 0 END AS token_out, CASE WHEN seq % 2 = 1 THEN round(n / 1000.0::DOUBLE, 3) END AS quality FROM ev)"""
SUMMARY = EV + ", s AS (SELECT execution_id, count(*) AS event_count, min(seq) AS started, max(seq) AS completed, arg_max(status, seq) AS status, CAST(sum(token_in) AS BIGINT) AS token_in, CAST(sum(token_out) AS BIGINT) AS token_out, count(DISTINCT ref) AS refs, count(*) FILTER (WHERE event_type = 'system') AS n_system, count(*) FILTER (WHERE event_type = 'user') AS n_user, count(*) FILTER (WHERE event_type = 'assistant') AS n_assistant FROM e GROUP BY 1)"
SNAPS = EV + """, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY execution_id, ref ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM e),
sn AS (SELECT execution_id, seq, CAST(sum(token_in) OVER w AS BIGINT) AS token_in, CAST(sum(token_out) OVER w AS BIGINT) AS token_out, CAST(sum(fresh) OVER w AS BIGINT) AS refs_so_far, last_value(quality IGNORE NULLS) OVER w AS quality FROM f WINDOW w AS (PARTITION BY execution_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
DAY = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1"
SIG = f"""d AS (SELECT user_id, {DAY} AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS err, count(*) FILTER (WHERE value > 60) AS big FROM events GROUP BY ALL), b AS (SELECT user_id, CAST(sum(n) AS DOUBLE) AS tn, CAST(sum(err) AS DOUBLE) AS te, CAST(count(*) AS DOUBLE) AS days FROM d GROUP BY 1),
p AS (SELECT user_id, day, CAST(n AS DOUBLE) AS cr, tn / days AS br, CAST(err AS DOUBLE) / n AS sr, te / tn AS bs, CAST(big AS DOUBLE) / n AS ur FROM d JOIN b USING (user_id)),
q AS (SELECT user_id, day, floor((least(1, greatest(0, (br - cr) / br)) + 2.220446049250313e-16) * 1000 + 0.5) / 1000 AS c, CASE WHEN bs > 0 THEN floor((least(1, greatest(0, (sr - bs) / bs)) + 2.220446049250313e-16) * 1000 + 0.5) / 1000 ELSE floor((least(1, greatest(0, sr)) + 2.220446049250313e-16) * 1000 + 0.5) / 1000 END AS s, floor((ur + 2.220446049250313e-16) * 1000 + 0.5) / 1000 AS u FROM p),
x AS (SELECT *, floor((least(1, greatest(0, 0.35::DOUBLE * c + 0.35::DOUBLE * s + 0.3::DOUBLE * u)) + 2.220446049250313e-16) * 1000 + 0.5) / 1000 AS error FROM q),
y AS (SELECT *, coalesce(sum(CASE WHEN error >= 0.62 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS 2 PRECEDING), 0) >= 2 AS entering, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM x)"""
AT = "CAST(floor(epoch(ts)) AS BIGINT)"
METRICS = "m AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS et, count(*) FILTER (WHERE event_type = 'error' AND value < 150) AS es, round(CAST(count(*) FILTER (WHERE value < 300) AS DOUBLE) / count(*), 6) AS replay, round(CAST(count(*) FILTER (WHERE value < 400) AS DOUBLE) / count(*), 6) AS cons, round(CAST(count(*) FILTER (WHERE value < 450) AS DOUBLE) / count(*), 6) AS bl, round(CAST(count(*) FILTER (WHERE value < 45) AS DOUBLE) / count(*), 6) AS red FROM events GROUP BY 1), r AS (SELECT *, et > 0 AS has, round(CASE WHEN et > 0 THEN CAST(es AS DOUBLE) / et ELSE 0.0 END, 6) AS rate FROM m)"
LABELS = METRICS + ", l AS (SELECT *, list_filter([CASE WHEN has AND (es < et OR rate < 1) THEN 'EVIDENCE_LOSS' END, CASE WHEN cons < 1 THEN 'CONSTRAINT_DRIFT' END, CASE WHEN bl < 1 THEN 'BLOCKER_DETACHMENT' END], lambda x: x IS NOT NULL) AS labels FROM r)"

QUERIES = {
    "timeline_summary": timeline, "running_snapshots": snapshots, "run_comparison": run_comparison, "quality_score": conversation_quality, "series_measures": series_measures, "ordered_score": order_scores,
    "signal_windows": signal_window_query, "signal_modes": signal_mode_query, "signal_window_reasons": signal_reasons, "signal_step_mapping": signal_step_mapping, "signal_step_asof": signal_step_asof, "profile_select": profile_select, "profile_prune": profile_prune,
    "failure_labels": failure_labels, "degradation_severity": degradation_severity, "pearson_alignment": pearson_alignment, "median_latency": median_latency, "decision_alignment": decision_alignment,
}

_three = lambda x: f"floor((least(1, greatest(0, {x})) + 2.220446049250313e-16) * 1000 + 0.5) / 1000"
_said = lambda k: f"'{REASONS[k]}'"
_MODES = f"""z AS (SELECT user_id, day, k, error, CASE WHEN error >= 0.85 THEN 'rollback_required' WHEN entering THEN 'deliberation' WHEN error < 0.3 THEN 'habit' ELSE 'monitor' END AS mode FROM y WHERE k = 1
UNION ALL SELECT y.user_id, y.day, y.k, y.error, CASE WHEN y.error >= 0.85 THEN 'rollback_required' WHEN z.mode = 'deliberation' AND y.error > 0.42 THEN 'deliberation' WHEN y.entering THEN 'deliberation' WHEN y.error < 0.3 THEN 'habit' ELSE 'monitor' END FROM z JOIN y ON y.user_id = z.user_id AND y.k = z.k + 1)"""

ORACLE_SQL = {
    "signal_window_reasons": f"""WITH RECURSIVE {SIG}, {_MODES}, v AS (SELECT z.*, y.c, y.s, y.u, y.entering, coalesce(lag(z.mode) OVER (PARTITION BY z.user_id ORDER BY z.k), 'habit') AS prior, CASE WHEN z.day % 3 = 0 THEN NULL ELSE {_three("(cr * 10 - br * 10) / (br * 10)")} END AS tc, CASE WHEN z.day % 4 = 0 THEN NULL WHEN 1 - bs > 0 THEN {_three("((1 - bs) - (1 - sr)) / (1 - bs)")} ELSE 0.0::DOUBLE END AS rd
  FROM z JOIN y ON y.user_id = z.user_id AND y.k = z.k JOIN p ON p.user_id = z.user_id AND p.day = z.day)
SELECT user_id AS execution_id, day AS window_id, mode, tc AS token_cost_spike, rd AS replay_consistency_drop, concat_ws(';', CASE WHEN c > 0 THEN {_said("ratio")} END, CASE WHEN s > 0 THEN {_said("sparse")} END, CASE WHEN u > 0 THEN CASE mode WHEN 'deliberation' THEN {_said("unseen_long")} ELSE {_said("unseen")} END END, CASE WHEN tc > 0 THEN {_said("cost")} END, CASE WHEN rd > 0 THEN {_said("replay")} END,
  CASE WHEN mode = 'rollback_required' THEN {_said("rollback")} WHEN error < 0.85 AND entering THEN {_said("entered")} WHEN error >= 0.62 THEN {_said("pending")} WHEN prior = 'deliberation' AND error <= 0.42 THEN {_said("left")} WHEN mode = 'habit' THEN {_said("habit")} WHEN mode = 'monitor' THEN {_said("monitor")} END) AS reasons FROM v""",
    "timeline_summary": f"WITH {SUMMARY} SELECT * FROM s",
    "running_snapshots": f"WITH {SNAPS} SELECT * FROM sn",
    "run_comparison": f"""WITH {SNAPS}, c AS (SELECT execution_id, CAST(sum(token_in + token_out) AS BIGINT) AS cost FROM sn GROUP BY 1), g AS (SELECT execution_id, CAST(sum(token_in + token_out) AS BIGINT) AS plain, list_sort(list_distinct(list(ref))) AS refs FROM e GROUP BY 1), x AS (SELECT * FROM g JOIN c USING (execution_id))
SELECT l.execution_id AS left_id, r.execution_id AS right_id, r.cost - l.cost AS snapshot_cost_delta, r.plain - l.plain AS cost_delta, coalesce(array_to_string(list_filter(r.refs, lambda v: NOT list_contains(l.refs, v)), ','), '') AS added, coalesce(array_to_string(list_filter(l.refs, lambda v: NOT list_contains(r.refs, v)), ','), '') AS removed, coalesce(array_to_string(list_filter(l.refs, lambda v: list_contains(r.refs, v)), ','), '') AS shared FROM x l JOIN x r ON r.execution_id = l.execution_id + 1""",
    "quality_score": f"""WITH {SUMMARY}, p AS (SELECT execution_id, n_assistant / event_count::DOUBLE AS v, n_user / event_count::DOUBLE AS sp, least(1, refs / event_count::DOUBLE) AS co, 0.5 + least(0.5, refs / 8.0::DOUBLE) AS tr, least(1, CASE WHEN n_assistant > 0 THEN 0.5 ELSE 0 END + least(0.5, refs / 4.0::DOUBLE)) AS rb, CASE WHEN token_in + token_out <= 0 THEN 1.0 ELSE least(1, greatest(0, (400 - token_in - token_out) / 400.0::DOUBLE)) END AS te FROM s)
SELECT execution_id, round(round((0.2::DOUBLE * v + 0.15::DOUBLE * sp + 0.25::DOUBLE * co + 0.15::DOUBLE * tr + 0.15::DOUBLE * rb + 0.1::DOUBLE * te) / 1.0, 3), 2) AS score FROM p""",
    "series_measures": f"""WITH d AS (SELECT user_id, {DAY} AS day, round(avg(CASE WHEN value <= 245 THEN 1.0::DOUBLE ELSE 0 END), 6) AS score FROM events GROUP BY ALL), w AS (SELECT *, score - 2 * lag(score) OVER o + lag(score, 2) OVER o AS d2 FROM d WINDOW o AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, round(coalesce(avg(d2), 0), 4) + 0.0::DOUBLE AS acceleration, coalesce(min(day) FILTER (WHERE score < 0.5), 0) AS collapse, coalesce(min(day) FILTER (WHERE score <= 0.5), max(day)) AS half_life, coalesce(max(day) FILTER (WHERE score >= 0.8), 0) AS longevity, round(arg_max(score, day), 6) AS final FROM w GROUP BY 1""",
    "ordered_score": """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS j FROM orders), n AS (SELECT *, lead(j) OVER (PARTITION BY o_custkey ORDER BY i) AS nj FROM r)
SELECT o_custkey, round(1 - CAST(count(*) FILTER (WHERE j > nj) AS DOUBLE) / greatest(count(*) - 1, 1), 6) AS score FROM n GROUP BY 1""",
    "signal_windows": f"WITH {SIG} SELECT user_id AS execution_id, day AS window_id, c AS compression_ratio_drop, s AS sparse_frame_spike, u AS unseen_signature, error, CASE WHEN error >= 0.85 THEN 'rollback_required' WHEN error < 0.3 THEN 'habit' WHEN error <= 0.55 THEN 'monitor' WHEN error >= 0.62 THEN 'deliberation' ELSE 'monitor' END AS band, entering FROM y",
    "signal_modes": f"""WITH RECURSIVE {SIG}, z AS (SELECT user_id, day, k, error, CASE WHEN error >= 0.85 THEN 'rollback_required' WHEN entering THEN 'deliberation' WHEN error < 0.3 THEN 'habit' ELSE 'monitor' END AS mode FROM y WHERE k = 1
UNION ALL SELECT y.user_id, y.day, y.k, y.error, CASE WHEN y.error >= 0.85 THEN 'rollback_required' WHEN z.mode = 'deliberation' AND y.error > 0.42 THEN 'deliberation' WHEN y.entering THEN 'deliberation' WHEN y.error < 0.3 THEN 'habit' ELSE 'monitor' END FROM z JOIN y ON y.user_id = z.user_id AND y.k = z.k + 1)
SELECT user_id AS execution_id, day AS window_id, error, mode, mode IN ('deliberation', 'rollback_required') AS triggered FROM z""",
    "signal_step_mapping": f"WITH e AS (SELECT user_id, event_id, event_type, {AT} AS at FROM events) SELECT s.user_id, s.event_id AS window_id, e.event_id AS step_id FROM e s JOIN e ON e.user_id = s.user_id AND e.at BETWEEN s.at - 1800 AND s.at WHERE s.event_type = 'error'",
    "signal_step_asof": f"WITH e AS (SELECT user_id, event_id, event_type, {AT} AS at FROM events), s AS (SELECT user_id, e.at AS until, CAST(min(event_id) AS VARCHAR) AS window_id FROM e WHERE event_type = 'error' GROUP BY ALL) SELECT e.user_id, CAST(e.event_id AS VARCHAR) AS step_id, s.window_id FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.at <= s.until",
    "profile_select": f"WITH {METRICS}, c AS (SELECT user_id, CASE WHEN (has AND rate < 0.95) OR replay < 0.95 OR cons < 0.9 OR bl < 0.9 THEN 'CONSERVATIVE' WHEN (NOT has OR rate >= 0.99) AND replay >= 0.99 AND cons >= 0.98 AND bl >= 0.98 AND red * 100 < 45 THEN 'AGGRESSIVE' ELSE 'BALANCED' END AS profile FROM r) SELECT user_id, profile, CAST(CASE profile WHEN 'CONSERVATIVE' THEN 900 WHEN 'BALANCED' THEN 600 ELSE 300 END AS BIGINT) AS window_seconds, CAST(CASE profile WHEN 'CONSERVATIVE' THEN 12 WHEN 'BALANCED' THEN 8 ELSE 5 END AS BIGINT) AS max_families FROM c",
    "profile_prune": "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n AS conservative, CAST(least(n, greatest(1, ceil(n * 8 / 12.0))) AS BIGINT) AS balanced, CAST(least(n, greatest(1, ceil(n * 5 / 12.0))) AS BIGINT) AS aggressive FROM n",
    "failure_labels": f"WITH {LABELS} SELECT user_id, coalesce(array_to_string(labels, ','), '') AS labels FROM l",
    "degradation_severity": f"""WITH {LABELS}, g AS (SELECT user_id % 10 AS team, count(*) AS runs, count(*) FILTER (WHERE replay < 0.5) AS collapsed, round(avg(replay), 4) AS consistency, list_distinct(flatten(list(labels))) AS ls, CAST(sum(len(labels)) AS BIGINT) AS failures FROM l GROUP BY 1)
SELECT team, runs, collapsed, consistency, coalesce(array_to_string(list_filter(['EVIDENCE_LOSS', 'HIGH_CRITICAL_EVIDENCE_LOSS', 'CONSTRAINT_DRIFT', 'BLOCKER_DETACHMENT'], lambda x: list_contains(ls, x)), ','), '') AS labels, failures, CASE WHEN collapsed > 0 THEN 'CRITICAL' WHEN failures > 0 OR consistency < 1 THEN 'WARNING' ELSE 'INFO' END AS severity FROM g""",
    "pearson_alignment": "SELECT l_returnflag, l_linestatus, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY ALL",
    "median_latency": "SELECT l_suppkey, round(median(l_quantity), 4) AS median, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1",
    "decision_alignment": "WITH x AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'halt' WHEN 'purchase' THEN 'inspect' ELSE 'continue' END = CASE WHEN value > 200 THEN 'halt' WHEN value > 100 THEN 'inspect' ELSE 'continue' END AS same FROM events) SELECT user_id, round(CAST(count(*) FILTER (WHERE same) AS DOUBLE) / count(*), 6) AS alignment, count(*) FILTER (WHERE same) AS agreed FROM x GROUP BY 1",
}
