"""Synthetic statements through the whole plan: kept counts, totals, and what survives."""

from decimal import Decimal

import pytest

from palimpsest.operators import card as C, decide as D, judge as J, layout as L
from palimpsest.plans.statement import read_statement
from palimpsest.sources import spans as src
from palimpsest.types import SPANS

HEADER = [(50, 110, "Date"), (110, 110, "Description"), (340, 110, "Paid out"), (430, 110, "Paid in"), (510, 110, "Balance")]
FURNITURE = [(50, 60, "Sort Code 12-34-56"), (50, 80, "Jane Smith")]


def spans(spark, places, doc="d", page=0):
    rows = [(doc, page, k, t, float(x), float(y - 11), x + 5.5 * len(t), float(y + 4)) for k, (x, y, t) in enumerate(places)]
    return spark.createDataFrame(rows, SPANS)


def dated(rows):
    out = FURNITURE + HEADER
    for i, (day, text, paid_out, paid_in, balance) in enumerate(rows):
        y = 140 + 22 * i
        out = out + [(x, y, t) for x, t in ((50, day), (110, text), (340, paid_out), (430, paid_in), (510, balance)) if t]
    return out


F1 = dated([("01 May", "Payroll", "", "2000.00", "2500.00"), ("03 May", "Tesco", "45.20", "", "2454.80"), ("05 May", "Pret A Manger", "8.75", "", "2446.05"), ("07 May", "Landlord Rent", "1200.00", "", "1246.05"), ("09 May", "Netflix", "12.99", "", "1233.06"), ("11 May", "Amazon", "33.50", "", "1199.56")])
F2 = dated([("01 May", "Salary Payroll", "", "2500.00", "2510.00"), ("02 May", "Bank Transfer In", "", "500.00", "3010.00"), ("03 May", "Tesco", "45.20", "", "2964.80"), ("05 May", "Pret A Manger", "8.75", "", "2956.05"), ("07 May", "Landlord Rent", "1200.00", "", "1756.05"), ("09 May", "Netflix", "12.99", "", "1743.06")])
F3 = [(43, 384, "Description"), (384, 384, "Incoming"), (452, 384, "Outgoing"), (525, 384, "Amount")] + [
    (43, 405, "Coffee shop"), (452, 405, "-4.50"), (525, 405, "95.50"), (43, 420, "2 May 2026"), (115, 420, "ref 1"),
    (43, 441, "Received money"), (384, 441, "500.00"), (525, 441, "595.50"), (43, 456, "1 May 2026"), (115, 456, "ref 2"),
    (43, 470, "Sent rent"), (452, 470, "-450.00"), (525, 470, "145.50"), (43, 485, "1 May 2026"), (115, 485, "ref 3"),
    (43, 530, "Some prose about the account"), (43, 542, "and more of it"),
]
F4 = [(53, 440, "Date"), (117, 440, "Payment type and"), (211, 440, "details"), (350, 440, "£"), (357, 440, "Paid"), (376, 440, "out"), (438, 440, "£"), (445, 440, "Paid"), (464, 440, "in"), (513, 440, "£"), (520, 440, "Balance")] + [
    (53, 452, "01 Jun 26"), (117, 452, "BALANCE BROUGHT FORWARD"), (520, 452, "100.00"),
    (53, 464, "02 Jun 26"), (117, 464, "CR"), (140, 464, "Employer"), (117, 476, "Salary"), (440, 476, "2000.00"),
    (53, 488, "03 Jun 26"), (117, 488, "DD"), (140, 488, "Monthly rent"), (117, 500, "ref 9"), (352, 500, "950.00"), (520, 500, "1150.00"),
    (53, 512, "04 Jun 26"), (117, 512, "BALANCE CARRIED FORWARD"), (520, 512, "1150.00"),
]
F6 = [(50, 100, "Notes about your balance"), (250, 100, "and any credit received"), (450, 100, "on the given date"), (460, 130, "18/06/2026")]


@pytest.mark.parametrize(
    "places, params, kept, total",
    [
        (F1, D.Params(["rent"]), 1, "1200.00"),
        (F1, D.Params(["RENT"]), 1, "1200.00"),
        (F1, D.Params(["Tesco"], direction="redact"), 5, "3255.24"),
        (F1, D.Params([]), 6, "3300.44"),
        (F2, D.Params(["rent"], keep_credits=True), 3, "4200.00"),
        (F2, D.Params([], keep_credits=True), 2, "3000.00"),
        (F3, D.Params(["rent"]), 1, "450.00"),
        (F3, D.Params([], keep_credits=True), 1, "500.00"),
        (F4, D.Params(["rent"]), 1, "950.00"),
        (F4, D.Params(["rent"], keep_credits=True), 2, "2950.00"),
    ],
)
def test_kept_and_total(spark, places, params, kept, total):
    got = D.kept_total(read_statement(spans(spark, places)).decided(params)).first()
    assert (got["kept_count"], got["total"]) == (kept, Decimal(total))


def test_instruction_verdicts(spark):
    st = read_statement(spans(spark, F1))
    told = st.transactions.selectExpr("doc_id", "page_no", "group_id", "'instruction' AS kind", "CASE WHEN description IN ('Payroll', 'Netflix') THEN true END AS verdict")
    kept = lambda p: {r["description"] for r in st.decided(p, told).where("decision = 'keep'").collect()}
    assert kept(D.Params([])) == {"Tesco", "Pret A Manger", "Landlord Rent", "Amazon"}
    assert kept(D.Params([], keep_credits=True)) == {"Payroll"}


def test_balances_and_furniture(spark):
    st = read_statement(spans(spark, F1))
    left = {r["text"] for r in st.survivors(D.Params(["rent"])).collect()}
    assert {"Sort Code 12-34-56", "Jane Smith", "2500.00", "1199.56", "Landlord Rent", "1200.00"} <= left
    assert not {"Payroll", "2000.00", "Tesco"} & left
    left = {r["text"] for r in st.survivors(D.Params(["rent"], redact_balances=True)).collect()}
    assert "1200.00" in left and "Jane Smith" in left and not {"2500.00", "1199.56"} & left


def test_prose_is_no_header(spark):
    assert read_statement(spans(spark, F6)).columns.count() == 0


def test_row_anchors(spark):
    ys = [0, 2, 3, 3.5, 6, 6.6, 10]
    s = spark.createDataFrame([("d", 0, k, float(y)) for k, y in enumerate(ys)], "doc_id string, page_no int, seq int, y0 double")
    assert [r["row_id"] for r in L.cluster_rows(s, 3.0).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2, 3]


def test_generic_card_lines(spark):
    s = spans(spark, [(50, 80, "Transactions"), (50, 120, "SHELL"), (300, 120, "£10.00"), (50, 150, "NETFLIX"), (300, 150, "£12.99")])
    total = lambda p: C.decide_lines(s, ("Transactions",), p).selectExpr("sum(amount) AS t").first()["t"]
    assert total(D.Params(["NETFLIX"])) == Decimal("12.99")
    assert total(D.Params(["NETFLIX"], direction="redact")) == Decimal("10.00")


def test_two_column_card(spark):
    s = spans(spark, [
        (52, 183, "How you've used your card"), (52, 200, "24 Aug"), (84, 200, "Shop"), (255, 200, "£10.00"), (84, 212, "High Street"),
        (52, 230, "25 Aug Travel"), (255, 230, "£5.00CR"), (52, 260, "26 Aug"), (84, 260, "Cafe"), (240, 256, "e"), (255, 260, "£3.50"),
        (52, 300, "Promotional transactions"), (52, 320, "27 Aug"), (330, 120, "28 Aug"), (361, 120, "Books"), (520, 120, "£7.25"),
    ])
    got = {(r["col"], r["date"], r["merchant"], r["amount"], r["is_credit"]) for r in C.card_transactions(s).collect()}
    assert got == {(0, "24 Aug", "Shop High Street", Decimal("10.00"), False), (0, "25 Aug", "Travel", Decimal("5.00"), True), (0, "26 Aug", "Cafe", Decimal("3.50"), False), (1, "28 Aug", "Books", Decimal("7.25"), False)}


def test_direction_is_checked():
    with pytest.raises(ValueError):
        D.Params([], direction="both")


def test_judged_header(spark):
    places = [(50, 110, "When"), (110, 110, "Who to"), (340, 110, "How much"), (510, 110, "Left"), (50, 140, "01 May"), (110, 140, "Tesco"), (340, 140, "45.20"), (510, 140, "954.80"), (50, 162, "02 May"), (110, 162, "Netflix"), (340, 162, "12.99"), (510, 162, "941.81")]
    s = spans(spark, places)
    roles = {"When": "date", "Who to": "description", "How much": "paid_out", "Left": "balance"}
    pick = lambda lines: next(((k, 0.9) for k, p in enumerate(lines) if "When" in p), None)
    st = read_statement(s, columns=J.judged_columns(s, pick, lambda texts: [roles.get(t) for t in texts]))
    got = D.kept_total(st.decided(D.Params(["netflix"]))).first()
    assert (got["kept_count"], got["total"]) == (1, Decimal("12.99"))
    assert J.judged_columns(s, pick, lambda texts: ["description"] * len(texts)).count() == 0
    assert read_statement(s).columns.count() == 0


def test_judged_people(spark):
    f = spark.createDataFrame([("d", 0, "PERSON", 50.0, False), ("d", 0, "PERSON", 120.0, False), ("d", 0, "PERSON", 140.0, False), ("d", 0, "PHONE_NUMBER", 150.0, False), ("d", 0, "IBAN_CODE", 160.0, True)], "doc_id string, page_no int, entity_type string, y0 double, structured boolean").selectExpr("*", "10.0D AS x0", "100.0D AS header_y")
    chosen = spark.createDataFrame([("d", 0, 10.0, 120.0, "person", 0.9), ("d", 0, 10.0, 140.0, "merchant", 0.9)], "doc_id string, page_no int, x0 double, y0 double, choice string, confidence double")
    assert sorted(r["y0"] for r in J.kept_people(f, chosen).collect()) == [50.0, 120.0, 160.0]


def test_ask_tries_again_and_shows_errors(spark):
    q = spark.createDataFrame([("d", 0, k, f"text {k}") for k in range(3)], "doc_id string, page_no int, group_id int, description string")

    def broken(texts):
        raise KeyError("no such model")

    got = J.ask(J.batched(q), broken).collect()
    assert len(got) == 3 and all(r["prob"] is None and r["error"] == "KeyError: 'no such model'" for r in got)
    got = J.ask(J.batched(q), lambda texts: [0.5] * len(texts)).collect()
    assert all(r["prob"] == 0.5 and r["error"] is None for r in got)


def test_characters_under_a_box_go(spark):
    s = spark.createDataFrame([("d", 0, 1, "abcdefghij", 0.0, 0.0, 100.0, 10.0), ("d", 0, 2, "untouched", 0.0, 20.0, 90.0, 30.0), ("d", 1, 3, "other page", 0.0, 0.0, 100.0, 10.0)], SPANS)
    boxes = spark.createDataFrame([("d", 0, 25.0, 2.0, 45.0, 8.0)], "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double")
    assert {r["seq"]: r["left"] for r in D.destroyed_text(s, boxes).collect()} == {1: "abfghij", 2: "untouched", 3: "other page"}


def test_late_and_failing_scorers_give_no_answers(spark):
    q = spark.createDataFrame([("d", 0, k, f"text {k}") for k in range(2)], "doc_id string, page_no int, group_id int, description string")

    def late(texts):
        import time

        time.sleep(2)

    got = J.ask(J.batched(q), late, timeout=0.1).collect()
    assert [(r["prob"], r["error"]) for r in got] == [(None, "no answer in 0.1 s")] * 2
    f = spark.createDataFrame([("d", 0, float(k), float(-k), "PERSON", f"name {k}") for k in range(25)], "doc_id string, page_no int, x0 double, y0 double, entity_type string, description string")
    chosen = J.people(f, lambda texts: [("person", 0.9)] * len(texts)).collect()
    assert sorted(r["x0"] for r in chosen) == [float(k) for k in range(5, 25)]
    assert J.people(f, lambda texts: [("person", 0.9)]).count() == 0
    assert J.people(f, late, timeout=0.1).count() == 0


def test_pairs_of_spans(spark):
    s = spark.createDataFrame([("d", 0, 1, "limit", 0.0, 0.0, 50.0, 10.0), ("d", 0, 2, "under it", 40.0, 5.0, 90.0, 15.0), ("d", 0, 3, "beside", 60.0, 0.0, 90.0, 4.0), ("d", 1, 4, "elsewhere", 0.0, 0.0, 50.0, 10.0)], SPANS)
    assert [r["seq"] for r in C.meeting(s, s.where("text = 'limit'")).collect()] == [2]
    assert {r["seq"] for r in C.beside(s, s.where("seq = 1")).collect()} == {1, 3}
    assert {(r["y"], r["seq"]) for r in C.lone_decimals(s, s.where("seq = 2")).collect()} == {(0, 3), (0, 4)}


def test_report_and_enforcement(spark, tmp_path):
    from palimpsest import report

    s = spark.createDataFrame([("d", 0, 1, "Mail jane.doe@shop.example now", 0.0, 0.0, 300.0, 10.0), ("d", 0, 2, "nothing here", 0.0, 40.0, 100.0, 50.0), ("d", 1, 3, "plain", 0.0, 0.0, 50.0, 10.0)], SPANS)
    s.write.parquet(str(tmp_path / "spans"))
    lines = list(report.run(spark, str(tmp_path / "spans"), str(tmp_path / "out")))
    assert lines == ["d page 1: EMAIL_ADDRESS 1", "d page 2: no findings", "d total across 2 page(s): EMAIL_ADDRESS 1"]
    left = {r["seq"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out" / "redacted_spans")).collect()}
    assert left == {2: "nothing here", 3: "plain"}
    assert spark.read.parquet(str(tmp_path / "out" / "redactions")).count() == 1


def test_files_become_spans(spark, tmp_path):
    for name, text in (("b.pdf", "two words"), ("a.pdf", "one"), ("c.txt", "no")):
        (tmp_path / name).write_text(text)

    def extractor(raw):
        return [(0, w, 10.0 * k, 0.0, 10.0 * k + 8, 10.0) for k, w in enumerate(raw.decode().split())]

    files = src.documents(spark, str(tmp_path))
    assert [(r["name"], r["place"]) for r in src.file_order(files).orderBy("place").collect()] == [("a.pdf", 1), ("b.pdf", 2)]
    assert sorted((r["doc_id"][-5:], r["seq"], r["text"]) for r in src.extract_spans(files, extractor).collect()) == [("a.pdf", 0, "one"), ("b.pdf", 0, "two"), ("b.pdf", 1, "words")]


def test_folders_of_parts_are_listed(spark, tmp_path):
    from palimpsest.plans.queries import QUERIES

    spark.range(3).repartition(2).write.parquet(str(tmp_path / "b, {1}.parquet"))
    (tmp_path / "empty.parquet").mkdir()
    for name in ("c.parquet", "a.parquet", "d.txt", "_e.parquet"):
        (tmp_path / name).write_text("not opened")
    got = QUERIES["src8_files"](spark, str(tmp_path))
    assert got.dtypes == [("name", "string"), ("place", "int")]
    assert [tuple(r) for r in got.orderBy("place").collect()] == [("a.parquet", 1), ("b, {1}.parquet", 2), ("c.parquet", 3), ("empty.parquet", 4)]
    (tmp_path / "none").mkdir()
    assert QUERIES["src8_files"](spark, str(tmp_path / "none")).count() == 0
