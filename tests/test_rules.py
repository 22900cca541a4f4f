"""Scalar rules, personal data, judgments, sources and the stream."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import predicates as P
from palimpsest.operators import judge as J, pii as I
from palimpsest.sources import sinks, spans as src
from palimpsest.streaming import funnel as S


def each(spark, rule, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["v"] for r in df.select("k", rule(F.col("t")).alias("v")).orderBy("k").collect()]


def test_dates(spark):
    assert each(spark, P.is_date, ["1 May", "01 Jun 26", "1 May 2026", "01/05/2026", "1/5/26", "May 2026", "1 May 2026 extra"]) == [True] * 5 + [False] * 2


def test_amounts(spark):
    assert each(spark, P.is_amount, ["1,234.56", "£1,234.56", "£ 9.99", "-12.34", "5.00CR", "label 9,876.54", "12"]) == [True] * 5 + [False] * 2
    assert [str(x) for x in each(spark, P.parse_amount, ["-£1,234.56", "5.00 CR", "x"])] == ["1234.56", "5.00", "0.00"]


def test_header_roles(spark):
    got = each(spark, P.header_role, ["Running balance", "£Paidout", "Paym ent type and details", "Notes about your balance and more", "Update", "Money in"])
    assert got == ["balance", "paid_out", "description", None, None, "paid_in"]


def test_providers(spark):
    got = each(spark, P.detect_provider, ["Your AMEX", "Barclays sort code", "Clockwise", "Wise Payments", "paid in", "x", None])
    assert got == ["amex_uk", "barclaycard", None, "wise", "generic_bank_uk", None, None]


def test_bands(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([-1.0, float("nan"), 10.0, 10.5, 250.0, 1000.0, 1000.01])], "k int, v double")
    assert [r["b"] for r in df.select("k", P.total_band(F.col("v")).alias("b")).orderBy("k").collect()] == ["unknown", "unknown", "0-10", "11-50", "51-250", "251-1000", "1000+"]


def page(spark, rows):
    return spark.createDataFrame([("d", 0, k, t, 10.0, y, 90.0, y + 10) for k, (y, t) in enumerate(rows)], "doc_id string, page_no int, seq int, text string, x0 double, y0 double, x1 double, y1 double")


ALL = [(10.0, "sort code 12-34-56"), (20.0, "account 12345678"), (30.0, "nino AB123456C"), (40.0, "iban GB29NWBK60161331926819"), (50.0, "phone 020 555 0100"), (60.0, "card 4242424242424242")]


def regions(spark, header_y, structured):
    return spark.createDataFrame([("d", 0, header_y, structured)], "doc_id string, page_no int, header_y double, structured_only boolean")


def test_findings(spark):
    above = I.page_findings(page(spark, ALL), regions(spark, 100.0, False))
    assert "text" not in above.columns
    types = {r["entity_type"] for r in above.collect()}
    assert types == {"UK_SORT_CODE", "UK_ACCOUNT_NUMBER", "UK_NINO", "IBAN_CODE", "PHONE_NUMBER", "CREDIT_CARD"}
    below = {r["entity_type"] for r in I.page_findings(page(spark, ALL), regions(spark, 5.0, False)).collect()}
    assert "PHONE_NUMBER" not in below and "CREDIT_CARD" in below
    landlord = {r["entity_type"] for r in I.page_findings(page(spark, ALL), regions(spark, 100.0, False), exclude=I.LANDLORD_PRESERVED).collect()}
    assert landlord == {"UK_NINO", "PHONE_NUMBER", "CREDIT_CARD"}


def test_shield(spark):
    hits = spark.createDataFrame([("d", 0, "PHONE_NUMBER", 0, 20, 0.75), ("d", 0, "UK_ACCOUNT_NUMBER", 10, 18, 0.65)], "doc_id string, page_no int, entity_type string, start int, end int, score double")
    assert I.shielded(hits, ("UK_ACCOUNT_NUMBER",)).count() == 0
    assert I.shielded(hits, ("PERSON",)).count() == 2


def test_batches_and_failure(spark):
    q = spark.range(95).selectExpr("'d' AS doc_id", "0 AS page_no", "id AS group_id", "concat('t', id) AS description")
    b = J.batched(q)
    assert [r["count"] for r in b.groupBy("batch_no").count().orderBy("batch_no").collect()] == [40, 40, 15]

    def scorer(texts):
        if "t94" in texts:
            raise RuntimeError
        return [0.9] * len(texts)

    answers = J.ask(b, scorer)
    assert answers.where("prob is null").count() == 15
    assert J.all_or_nothing(answers).where("prob is not null").count() == 0


def test_json_spans_and_names(spark):
    j = '{"blocks": [{"lines": [{"text": " Date ", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}, {"text": " ", "bbox": {"x": 0, "y": 0, "w": 0, "h": 0}}]}]}'
    got = src.spans_from_json(spark.createDataFrame([("d", 0, j)], "doc_id string, page_no int, json string")).collect()
    assert [tuple(r) for r in got] == [("d", 0, 0, "Date", 1.0, 2.0, 4.0, 6.0)]
    assert spark.range(1).select(sinks.output_name(F.lit("a"), F.lit(12.5)).alias("n")).first()["n"] == "redacted_a_£12.50.pdf"


def test_stream_equals_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    S.run_once(S.funnel(S.read_events(spark, folder), late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "check"))
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in S.funnel(spark.read.parquet(folder + "/events.parquet")).collect()}
    assert streamed and streamed <= batch  # the last window is still open


@pytest.mark.parametrize("text, want", [("a, ,b", ["a", "b"]), ("", [])])
def test_keywords(text, want):
    assert P.parse_keywords(text) == want


def test_sanitize_reads_whole_texts(spark, tmp_path):
    from palimpsest.plans.queries import QUERIES

    spark.createDataFrame([(1, "é" * 300 + "abc " + "x" * 70), (2, "plain")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["name"] for r in QUERIES["p32_sanitize"](spark, str(tmp_path)).collect()}
    assert got == {1: "abc " + "x" * 56, 2: "plain"}
