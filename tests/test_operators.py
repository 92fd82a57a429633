"""Operators on small hand-made inputs: traps, ties, nulls, empty tables."""

import datetime

from pyspark.sql import functions as F

from foldlog.functions import numbers as N
from foldlog.functions import text as T
from foldlog.functions.hashing import canonical, fnv1a
from foldlog.operators import families as fam
from foldlog.operators import parse as P
from foldlog.operators import signatures as S
from foldlog.operators.audit import evidence_survival
from foldlog.operators.frame import frames
from foldlog.operators.references import budget_select, first_by_keys, uri_problem
from foldlog.operators.series import ordered_score
from foldlog.operators.signals import map_steps, signal_modes, steps_up_to
from foldlog.sources.lines import sections, text_lines
from foldlog.streaming.signals import step


def one(spark, expression, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first().y


def parsed(spark, raws):
    rows = [("a", i + 1, r) for i, r in enumerate(raws)]
    return P.parse_lines(spark.createDataFrame(rows, "log_id string, line_no int, raw string"))


def test_parse_line(spark):
    line = "2024-01-02 03:04:05.5+0100 warning ECU=abs-front P0301 p0301 temp=81.5C temp=82C note:ok"
    r = parsed(spark, [line, "  "]).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.severity, r.ecu, r.codes) == ("WARN", "ABS-FRONT", ["P0301"])
    assert r.fields == {"ecu": "abs-front", "temp": "82C", "note": "ok"}
    assert r.timestamp == datetime.datetime(2024, 1, 2, 2, 4, 5, 500000)


def test_no_time_and_bad_time(spark):
    a, b = parsed(spark, ["no time at all", "2024-13-45 00:00:00 bad"]).orderBy("line_no").collect()
    assert a.timestamp is None and b.timestamp is None and a.ecu == "GEN" and a.severity == "INFO" and a.codes == []


def test_english_word_is_a_code(spark):
    # five letters that happen to be hexadecimal behind a P, C, B or U
    assert parsed(spark, ["he ceded it"]).first().codes == ["CEDED"]


def test_signature(spark):
    sig = lambda v, exact=True: one(spark, S.signature(F.lit(v), exact, True))
    assert sig("the and of") == "EMPTY"
    assert sig("engine temperature 81C", False) == "ENG.TMP.#C"
    assert sig("0xFF misfire P0301") == "0x#.MSFR.P0301"
    assert sig("balloon") == "BLN"
    assert sig("cylinder=4 rpm=900", False) == "CYLNDR=#N.RPM=#N"
    assert sig(" ".join(["brake"] * 20)) == ".".join(["BRK"] * 12)


def test_family_ties_go_to_the_first_line(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("a", 4, "x"), ("a", 5, "z")], "log_id string, line_no int, family string")
    assert [(r.family, r.n) for r in fam.top_families(e, 2).orderBy("rank").collect()] == [("x", 2), ("y", 2)]


def test_untimed_events_share_bucket_numbers(spark):
    t = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", 1, t, "f"), ("a", 2, None, "f"), ("a", 3, None, "g"), ("a", 4, t + datetime.timedelta(seconds=61), "g")], "log_id string, line_no int, timestamp timestamp, family string")
    got = {r.line_no: r.bucket for r in fam.buckets(e, 60).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_frames_short_and_full(spark):
    short = frames(parsed(spark, ["ERROR ABS P0301 brake", "INFO CPC ok"])).first()
    assert short.micro and short.payload == "M|2|E1I1|P0301|ABS.E.P0301.BS.P0301.BRK,CPC.I.-.CPC.K"
    full = frames(parsed(spark, ["ERROR ABS P0301 brake"] * 5)).first()
    assert not full.micro and '"m":"F1=5"' in full.payload and '"t0":null' in full.payload


def test_lines_of_a_text(spark):
    got = text_lines(spark.createDataFrame([(1, "a  \r\nb\x0bc\n"), (2, None)], "id int, t string"), "id", "t").orderBy("log_id", "line_no").collect()
    assert [(r.log_id, r.line_no, r.raw) for r in got] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "")]


def test_sections(spark):
    got = sections(spark.createDataFrame([(1, "PAPER_ID: x\nTITLE: T\nSECTION: Method\nline a\nline b\nSECTION: metrics\nm")], "id int, t string"), "id", "t").collect()
    assert {r.section: r.text for r in got} == {"t": "", "method": "line a\nline b", "metrics": "m"}


def test_text_scores(spark):
    a, b, none = F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("a")), F.array().cast("array<string>")
    assert one(spark, T.coverage(a, b, 1.0)) == 2 / 3 and one(spark, T.coverage(none, b, 0.0)) == 0.0
    assert one(spark, T.jaccard(none, none)) == 1.0 and one(spark, T.jaccard(a, b)) == 0.5 and one(spark, T.overlap(a, b)) == 0.5
    assert one(spark, T.word_count(F.col("x"))) == 0


def test_hashes(spark):
    assert one(spark, fnv1a(F.lit("a"))) == "e40c292c" and one(spark, fnv1a(F.lit(""))) == "811c9dc5"
    m = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit(None).cast("string"), F.lit("traceId"), F.lit("9"))
    assert one(spark, canonical(m)) == "{a:null,b:1,traceId:[volatile]}"


def test_numbers(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert one(spark, N.drop(lit(1.0), lit(2.0))) == 0.5 and one(spark, N.drop(lit(1.0), lit(0.0))) == 0.0
    assert one(spark, N.rise(lit(0.2), lit(0.0), bare=True)) == 0.2 and one(spark, N.rise(lit(None), lit(1.0), bare=True)) == 0.0
    assert one(spark, N.clamp(lit(float("nan")))) == 0.0
    assert one(spark, N.mode_band(lit(0.58))) == "monitor" and one(spark, N.mode_band(lit(0.62))) == "deliberation"
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, N.selected_profile(lit(0.0), no, lit(0.0), no, lit(1.0), lit(1.0), lit(1.0), lit(10.0))) == "AGGRESSIVE"
    assert one(spark, N.selected_profile(lit(1.0), yes, lit(0.9), yes, lit(1.0), lit(1.0), lit(1.0), lit(10.0))) == "CONSERVATIVE"
    assert one(spark, N.failure_labels(yes, F.lit(1), F.lit(2), lit(None), yes, lit(0.5), lit(1.0), lit(0.9))) == ["EVIDENCE_LOSS", "HIGH_CRITICAL_EVIDENCE_LOSS", "BLOCKER_DETACHMENT"]


def test_modes_agree_with_the_stream_step(spark):
    errors = [0.1, 0.7, 0.7, 0.5, 0.5, 0.42, 0.5, 0.9, 0.7, 0.5, 0.2, 0.65, 0.3, 0.66, 0.6]
    mode, recent, want = "habit", [], []
    rows = []
    for i, e in enumerate(errors):
        mode, recent = step(mode, recent, e)
        want.append(mode)
        rows.append((1, i, i, e, sum(x >= 0.62 for x in errors[max(0, i - 2) : i + 1]) >= 2))
    got = signal_modes(spark.createDataFrame(rows, "execution_id int, window_id int, at int, error double, entering boolean")).orderBy("at").collect()
    assert [r.mode for r in got] == want


def test_steps_of_windows(spark):
    s = spark.createDataFrame([(1, "w1", 0, 10), (1, "w2", 8, 20), (1, "w3", 95, 99)], "k int, window_id string, start int, end int")
    e = spark.createDataFrame([(1, "a", 0), (1, "b", 10), (1, "c", 50), (1, "d", 99), (2, "e", 5)], "k int, step_id string, at int")
    assert {(r.window_id, r.step_id) for r in map_steps(s, e, "k", 7).collect()} == {("w1", "a"), ("w1", "b"), ("w2", "b"), ("w3", "d")}
    assert {r.step_id: r.window_id for r in steps_up_to(s, e, "k").collect()} == {"a": "w1", "b": "w1", "c": "w3", "d": "w3", "e": None}


def test_budget_skips_what_does_not_fit(spark):
    refs = spark.createDataFrame([("g", 1, 0.9, 60), ("g", 2, 0.8, 50), ("g", 3, 0.7, 40), ("h", 4, 0.1, 200)], "g string, id int, relevance double, tokens long")
    assert {r.id: (r.taken, r.used) for r in budget_select(refs, "g", 100).collect()} == {1: (True, 60), 2: (False, 60), 3: (True, 100), 4: (False, 0)}


def test_first_by_keys_is_sequential(spark):
    # 2 falls to 1 by a; 3 shares b with 2 alone, which was not kept, so 3 stays; 4 falls to 3 by c
    rows = [(1, "a", "x", "p"), (2, "a", "y", "q"), (3, "b", "y", "r"), (4, "c", "z", "r"), (5, None, "n", "s"), (6, None, "m", "t")]
    refs = spark.createDataFrame(rows, "n int, a string, b string, c string")
    assert sorted(r.n for r in first_by_keys(refs, "n", ["a", "b", "c"]).collect()) == [1, 3, 5]
    assert first_by_keys(refs.limit(0), "n", ["a"]).count() == 0


def test_addresses(spark):
    cases = {"x": "format", "http://a": "scheme", "mem://a": None, "file://": "empty", "file:///etc": "absolute", "file://C:/a": "windows", "file://localhost/a": "local", "file://a/../b": "traversal", "file://a%2e%2e/b": "traversal", "file://a/b": None, None: "format"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.p for r in df.select("u", uri_problem(F.col("u")).alias("p")).collect()} == cases


def test_evidence_needs_both_sides(spark):
    ev = spark.createDataFrame([(1, "a", "high "), (1, "b", "LOW"), (1, "c", "LOW")], "k int, evidence_id string, criticality string")
    o = spark.createDataFrame([(1, "a", "v"), (1, "b", "v")], "k int, evidence_id string, value string")
    r = spark.createDataFrame([(1, "a", "v"), (1, "c", "v")], "k int, evidence_id string, value string")
    x = evidence_survival(ev, o, r, "k").first()
    assert (x.evidence_total, x.evidence_survived, x.evidence_survival_rate, x.has_high, x.high_survival_rate) == (3, 1, 0.333333, True, 1.0)


def test_ordered_score(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, ordered_score(arr(1, 2, 3), arr(1, 2, 3))) == 1.0
    assert one(spark, ordered_score(arr(1, 2, 3), arr(3, 2, 1))) == 0.0
    assert one(spark, ordered_score(arr(1, 2), arr(2))) == 0.5
