"""What FINDINGS_r03 doubted: the order of codes, the numbers of incidents, which of two copies is the duplicate."""

from foldlog.llm.repair import repair_conversations
from foldlog.operators.families import top_codes
from foldlog.operators.parse import parse_lines
from foldlog.operators.reporting import incidents


def test_codes_keep_their_order(spark):
    raw = [("l", 1, "DEBUG source=U1209 P0128 x U1209"), ("l", 2, "INFO source=U1209 B1000")]
    found = parse_lines(spark.createDataFrame(raw, "log_id string, line_no long, raw string"))
    assert [r.codes for r in found.orderBy("line_no").collect()] == [["U1209", "P0128"], ["U1209", "B1000"]]
    assert [(r.code, r.n) for r in top_codes(found).orderBy("rank").collect()] == [("U1209", 2), ("P0128", 1), ("B1000", 1)]


def test_incidents_have_names_of_their_own(spark):
    health = spark.createDataFrame([], "service string, status string")
    found = incidents(health, spark.range(10_050).selectExpr("id", "id AS user_id", "'ecu' AS field", "'HIGH' AS level"), "user_id")
    assert found.select("incident").distinct().count() == 10_050


def test_the_second_copy_goes(spark):
    rows = [(1, 0, "user", "Q."), (1, 1, "assistant", "A."), (1, 1, "assistant", "A.")]
    _, report = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert report.first().audit == "KKD"
