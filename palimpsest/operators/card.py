"""Card statements: sections, two-column transactions, wrapped merchants, redaction bars, and the financial summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.predicates import CARD_AMOUNT, CARD_DATE, extract_currency, has_keyword, is_card_credit, parse_card_amount, split_card_date, whole_y, y_bucket
from palimpsest.operators.decide import Params
from palimpsest.operators.layout import PAGE, page_window, same_line

# Column geometry, section marks, summary labels and values.
X_TOLERANCE, COLUMN_SPLIT = 8, 310
COLUMNS = ({"date": (48, 82), "merchant": (80, 260), "amount": (250, 300), "e": (235, 265)}, {"date": (325, 365), "merchant": (355, 520), "amount": (515, 570), "e": (515, 530)})
SECTION_START = ("How you've used your card", "How you’ve used your card")
SECTION_END = ("Promotional transactions", "Interest and charges")
SUMMARY_LABELS = (
    "Your new balance", "Minimum payment", "Your previous balance", "Payments towards your account", "Your new activity", "Interest charged", "Other charges", "Available to spend",
    "Your current credit limit", "Estimated interest next month", "Simple standard rate p.a", "Simple cash rate p.a", "Transactions, interest and charges", "Interest and charges", "Monthly Membership Fee", "Number ",
)
SUMMARY_VALUE = r"(?i)^(?:£[0-9,]+\.[0-9]{2}|[0-9]{4}\s+[0-9]{4}\s+[0-9]{4}\s+[0-9]{4}|[0-9]+\.[0-9]+%|\([0-9]+\.[0-9]+%\s+compound.*\))$"
CARD_NUMBER = r"^(?:[0-9]{4}\s+[0-9]{4}\s+[0-9]{4}\s+[0-9]{4}|Number\s+[0-9]{4})"
BAR_LABELS = ("Interest and charges", "Monthly Membership Fee")
SUMMARY_PAGE, SUMMARY_Y, SUMMARY_X = 1, 182, 300


def in_x_range(lo: float, hi: float, x0: str = "x0", tol: float = X_TOLERANCE) -> Column:
    return F.col(x0).between(lo - tol, hi + tol)


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def bucket_order() -> Window:
    """A page's spans by four-point row, then from left to right."""
    return page_window(y_bucket(F.col("y0")), "x0", "seq")


def beside(values: DataFrame, labels: DataFrame) -> DataFrame:
    """values with a label in the same four-point row and half of the page."""
    place = {"_bucket": y_bucket(F.col("y0")), "_left": F.col("x0") < SUMMARY_X}
    at = labels.withColumns(place).select(*PAGE, *place).distinct()
    return values.withColumns(place).join(at, [*PAGE, *place], "left_semi").drop(*place)


def meeting(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """spans that meet one of boxes, a span's own box (of the same seq) left aside. Boxes come as one row a page."""
    per_page = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1")).alias("_boxes"))
    meets = F.exists("_boxes", lambda b: (b.seq != F.col("seq")) & (F.col("x0") < b.x1) & (F.col("x1") > b.x0) & (F.col("y0") < b.y1) & (F.col("y1") > b.y0))
    return spans.join(per_page, PAGE).where(meets).drop("_boxes")


def lone_decimals(decimals: DataFrame, named: DataFrame, reach: int = 1) -> DataFrame:
    """(page, y, seq): the last decimal of each whole y, but for those within reach of a named span's whole y."""
    last = decimals.groupBy(*PAGE, whole_y(F.col("y0")).alias("y")).agg(F.max("seq").alias("seq"))
    near = named.select(*PAGE, F.explode(F.sequence(whole_y(F.col("y0")) - reach, whole_y(F.col("y0")) + reach)).alias("y")).distinct()
    return last.join(near, [*PAGE, "y"], "left_anti")


def section_starts(spans: DataFrame, headers: tuple[str, ...], by_y: bool = False) -> DataFrame:
    """(page, section_y): the bottom of the page's first span with a header, in reading order or by y."""
    order = F.struct("y0", "seq") if by_y else F.struct("seq")
    return spans.where(_any_of(F.col("text"), headers)).groupBy(*PAGE).agg(F.min_by("y1", order).alias("section_y"))


def section_spans(spans: DataFrame, headers: tuple[str, ...]) -> DataFrame:
    """Spans below the section header; none on pages without one, or with one whose bottom is 0."""
    return spans.join(section_starts(spans, headers).where("section_y <> 0"), PAGE).where("y0 > section_y")


def section_ends(spans: DataFrame) -> DataFrame:
    """(page, col, end_y): the first end mark of each column; else 20 points below the last bare date there."""
    col = F.when(F.col("x0") < COLUMN_SPLIT, 0).otherwise(1)
    marks = spans.where(_any_of(F.col("text"), SECTION_END)).groupBy(*PAGE, col.alias("col")).agg(F.min_by("y0", "seq").alias("end_y"))
    bare = F.rlike(F.trim("text"), F.lit(CARD_DATE))
    dates = None
    for k, c in enumerate(COLUMNS):
        d = spans.where(bare & in_x_range(*c["date"])).groupBy(*PAGE).agg((F.max_by("y1", "seq") + 20).alias("date_y")).withColumn("col", F.lit(k))
        dates = d if dates is None else dates.unionByName(d)
    return marks.join(dates, [*PAGE, "col"], "full").select(*PAGE, "col", F.coalesce("end_y", "date_y").alias("end_y"))


def card_transactions(spans: DataFrame) -> DataFrame:
    """(page, col, tx, date, merchant, amount, is_credit, bar_y0, bar_y1): one row a transaction, on pages with a section.

    Rows are four-point buckets. A row with a date opens a transaction; rows right after it that have merchant text but
    neither date nor amount are its wrapped lines. A lone `e` marker is no merchant text; it belongs to the
    transaction less than 12 points away.
    """
    s = spans.withColumn("text", F.trim("text")).where("text <> ''")
    start, ends = section_starts(s, SECTION_START, by_y=True), section_ends(s)
    out = None
    for k, c in enumerate(COLUMNS):
        of = ends.where(F.col("col") == k).select(*PAGE, "end_y")
        here = s.join(start, PAGE).join(of, PAGE, "left").where((F.col("x0") >= c["date"][0] - 10) & (F.col("x0") <= c["amount"][1] + 20) & F.coalesce(F.col("y0") < F.col("end_y"), F.lit(True)))
        if k == 0:
            here = here.where("y0 >= section_y")
        got = _column_transactions(here, c).withColumn("col", F.lit(k))
        out = got if out is None else out.unionByName(got)
    return out


def _column_transactions(spans: DataFrame, c: dict) -> DataFrame:
    parts = split_card_date(F.col("text"))
    bare = parts.date.isNotNull() & parts.merchant.isNull() & in_x_range(*c["date"])
    merged = parts.merchant.isNotNull() & in_x_range(c["date"][0], c["date"][1] + 300)
    amount = F.rlike("text", F.lit(CARD_AMOUNT)) & in_x_range(*c["amount"])
    mark = (F.col("text") == "e") & in_x_range(*c["e"])
    kind = F.when(bare, "date").when(merged, "merged").when(amount, "amount").when(mark, "e").when(in_x_range(*c["merchant"]), "merchant")
    rows = spans.withColumns({"kind": kind, "bucket": y_bucket(F.col("y0")), "parts": parts}).where("kind is not null")
    words = F.when(F.col("kind") == "merged", F.col("parts.merchant")).when(F.col("kind") == "merchant", F.col("text"))
    has = lambda *k: F.max(F.col("kind").isin(*k))
    line = rows.groupBy(*PAGE, "bucket").agg(
        has("date", "merged").alias("opens"),
        has("amount").alias("has_amount"),
        has("date").alias("has_date"),
        F.max((F.col("kind") == "merchant") | (F.col("kind") == "merged")).alias("has_words"),
        F.max_by(F.when(F.col("kind").isin("date", "merged"), F.col("parts.date")), F.when(F.col("kind").isin("date", "merged"), F.col("seq"))).alias("date"),
        F.max_by(F.when(F.col("kind") == "amount", F.col("text")), F.when(F.col("kind") == "amount", F.col("seq"))).alias("amount_text"),
        F.array_sort(F.collect_list(F.when(words.isNotNull(), F.struct("seq", words.alias("w"))))).alias("words"),
        F.min(F.when(F.col("kind") != "e", F.col("y0"))).alias("top"),
        F.max(F.when(F.col("kind") != "e", F.col("y1"))).alias("bottom"),
    )
    w = Window.partitionBy(*PAGE).orderBy("bucket")
    line = line.withColumn("tx", F.sum(F.col("opens").cast("int")).over(w)).where("tx > 0")
    # a row that neither opens nor wraps ends the transaction; what follows belongs to none
    stops = ~F.col("opens") & (F.col("has_date") | F.col("has_amount") | ~F.col("has_words"))
    since = Window.partitionBy(*PAGE, "tx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_stopped", F.max(stops).over(since)).where(~F.col("_stopped"))
    texts = F.array_sort(F.collect_list(F.struct("bucket", F.transform("words", lambda x: x.w).alias("w"))))
    head = F.min_by("amount_text", "bucket")
    return line.groupBy(*PAGE, "tx").agg(
        F.min_by("date", "bucket").alias("date"),
        F.trim(F.array_join(F.flatten(F.transform(texts, lambda x: x.w)), " ")).alias("merchant"),
        parse_card_amount(head).alias("amount"),
        F.coalesce(is_card_credit(head), F.lit(False)).alias("is_credit"),
        (F.min("top") - 2).alias("bar_y0"),
        (F.max("bottom") + 2).alias("bar_y1"),
    )


def clamp_bars(bars: DataFrame, kept: DataFrame) -> DataFrame:
    """bars (page, bar, y0, y1) cut back from the page's kept boxes, in their order; a bar that collapses is dropped.

    A kept box that hangs out below lowers nothing and cuts the bar's bottom to half a point above the box; one that
    hangs out above cuts its top. A box within the bar, or beyond it on both sides, cuts nothing.
    """
    boxes = kept.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("box", F.col("y0").alias("ky0"), F.col("y1").alias("ky1")))).alias("_kept"))

    def cut(r: Column, k: Column) -> Column:
        meets = (k.ky0 < r.y1) & (k.ky1 > r.y0)
        below = meets & (k.ky0 > r.y0) & (k.ky1 > r.y1)
        above = meets & (k.ky0 < r.y0) & (k.ky1 < r.y1)
        return F.struct(F.when(above, F.greatest(r.y0, k.ky1 + 0.5)).otherwise(r.y0).alias("y0"), F.when(below, F.least(r.y1, k.ky0 - 0.5)).otherwise(r.y1).alias("y1"))

    joined = bars.join(boxes, PAGE, "left")
    none = F.array().cast("array<struct<box:int,ky0:double,ky1:double>>")
    r = F.aggregate(F.coalesce("_kept", none), F.struct(F.col("y0").alias("y0"), F.col("y1").alias("y1")), cut)
    return joined.withColumn("_r", r).where("_r.y1 > _r.y0").select(*PAGE, "bar", F.col("_r.y0").alias("y0"), F.col("_r.y1").alias("y1"))


def decide_lines(spans: DataFrame, headers: tuple[str, ...], params: Params) -> DataFrame:
    """Span-wise decisions of the generic card engine: (spans' columns, line_text, decision, amount).

    A span is named if its line has a keyword. Spans of fewer than two characters are skipped. Without keywords all
    stay.
    """
    here = same_line(section_spans(spans.withColumn("text", F.trim("text")), headers))
    named = has_keyword(F.col("line_text"), params.keywords)
    keep = (named if params.direction == "keep" else ~named) if params.keywords else F.lit(True)
    decision = F.when(F.length("text") < 2, "skip").when(keep, "keep").otherwise("redact")
    return here.withColumn("decision", decision).withColumn("amount", F.when(F.col("decision") == "keep", extract_currency(F.col("text"))))


def financial_summary(spans: DataFrame) -> DataFrame:
    """(page, seq, reason): what the summary pass redacts. Card numbers first, then values beside a label in the same
    bucket and half of the page, then pound values in the top left of the second page, then whole rows of two labels."""
    s = spans.withColumns({"text": F.trim("text"), "bucket": y_bucket(F.col("y0")), "side": F.when(F.col("x0") < SUMMARY_X, "left").otherwise("right")}).where("text <> ''")
    labels = F.lit(False)
    for label in SUMMARY_LABELS:
        labels = labels | F.contains(F.lower("text"), F.lit(label.lower()))
    labelled = s.where(labels).select(*PAGE, "bucket", "side").distinct().withColumn("_beside", F.lit(True))
    s = s.join(labelled, [*PAGE, "bucket", "side"], "left")
    value = F.rlike("text", F.lit(SUMMARY_VALUE))
    top_left = (F.col("page_no") == SUMMARY_PAGE) & (F.col("y0") < SUMMARY_Y) & (F.col("x0") < SUMMARY_X) & F.startswith("text", F.lit("£"))
    reason = F.when(F.rlike("text", F.lit(CARD_NUMBER)), "card_number").when(value & F.col("_beside"), "labelled_value").when(value & top_left, "summary_value").when(_any_of(F.col("text"), BAR_LABELS), "row_bar")
    return s.withColumn("reason", reason).where("reason is not null").select(*PAGE, "seq", "reason")


def financial_details(spans: DataFrame, pages: DataFrame, redact: list[str], preserve: list[str], zone: float) -> DataFrame:
    """(page, seq): spans that a redact pattern finds, or standalone pound amounts in the top `zone` of the page, unless
    a preserve pattern (whatever the case) finds the span."""
    hit = lambda patterns, flag: F.rlike("text", F.lit(flag + "(?:" + "|".join(patterns) + ")")) if patterns else F.lit(False)
    alone = F.rlike("text", F.lit(r"^\s*£[0-9,]+\.[0-9]{2}\s*$")) & (F.col("y0") <= F.col("height") * zone)
    return spans.join(pages.select(*PAGE, "height"), PAGE).where(~hit(preserve, "(?i)") & (hit(redact, "") | alone)).select(*PAGE, "seq")
