"""One registered query per operator, over the whole test tables. SQL twins are in palimpsest.plans.oracles."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palimpsest.functions import predicates as P
from palimpsest.operators import card as C, decide as D, groups as G, judge as J, layout as L, pii as I, usage as U
from palimpsest.plans.statement import Statement, read_statement
from palimpsest.sources import bridge, sinks, spans as src
from palimpsest.streaming import funnel as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _statement(spark: SparkSession, sf_dir: str, jitter: bool = False) -> Statement:
    return read_statement(bridge.statement_spans(bridge.statement_transactions(spark, sf_dir), jitter))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.read(spark, sf_dir, "orders")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with seq, their place in the order: line numbers repeat."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return bridge.read(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(w))


def _by_key(key: Column, *cases: Column) -> Column:
    """cases[key mod their number]."""
    out = F.when(key % len(cases) == 0, cases[0])
    for k, c in enumerate(cases[1:], 1):
        out = out.when(key % len(cases) == k, c)
    return out


# --- scalar rules -----------------------------------------------------------------------------------------------


def _date_text(o: DataFrame) -> Column:
    d = F.col("o_orderdate")
    return _by_key(F.col("o_orderkey"), F.date_format(d, "d MMM yyyy"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "MMM yyyy"), F.date_format(d, "d MMM yy"), F.concat(F.date_format(d, "d MMM yyyy"), F.lit(" extra")))


@query
def p01_date_cells(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", P.is_date(_date_text(o)).alias("is_date"))


def _amount_text() -> Column:
    money = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    return _by_key(F.col("o_orderkey"), money, F.concat(F.lit("£"), money), F.concat(F.lit("-"), money), F.concat(money, F.lit("CR")), F.concat(F.lit("Total "), money), F.concat(F.lit("£ "), money, F.lit(" cr")), F.lit("n/a"))


@query
def p02_amount_cells(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", P.is_amount(_amount_text()).alias("is_amount"))


@query
def p03_parse_amount(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", P.parse_amount(_amount_text()).alias("amount"))


@query
def p04_carry_rows(spark, sf_dir):
    o = _orders(spark, sf_dir)
    text = _by_key(F.col("o_orderkey"), F.concat(F.lit("BALANCE BROUGHT FORWARD "), F.col("o_orderpriority")), F.lit("balance carried  forward"), F.lit("Balance transfer"))
    return o.select("o_orderkey", P.is_carry_row(text).alias("is_carry"))


LABELS = [
    "Date", "Description", "Paid out", "Paid  in", "Running balance", "Balance", "£Paidout", "Money out", "Outgoing", "Amount", "Paym ent type and details", "Notes about your balance", "Details", "Payee",
    "and any credit received", "Transaction date", "Withdrawal", "memo", "Update", "", "Debit", "Deposits", "Credit limit", "Incoming", "Imbalance",
]


@query
def p05_header_role(spark, sf_dir):
    n = bridge.read(spark, sf_dir, "nation")
    labels = F.array(*[F.lit(x) for x in LABELS])
    return n.select("n_nationkey", F.explode(labels).alias("label")).select("n_nationkey", "label", P.header_role(F.col("label")).alias("role"))


def _role_of(key: Column) -> Column:
    return _by_key(key, *[F.lit(r) for r in ("date", "description", "paid_out", "paid_in", "balance")])


@query
def p06_credible_header(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem")
    roles = F.collect_set(_role_of(F.col("l_partkey")))
    return li.groupBy("l_orderkey").agg(P.is_credible_header(roles).alias("credible"))


@query
def p10_keyword_match(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", P.has_keyword(F.col("o_orderpriority"), P.parse_keywords("urgent, ,HIGH")).alias("named"))


@query
def p12_currency_extract(spark, sf_dir):
    money = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    text = _by_key(F.col("o_orderkey"), F.concat(F.lit("POS £"), money, F.lit(" 12.00")), F.concat(money, F.lit(" GBP")), F.lit("no amount"))
    return _orders(spark, sf_dir).select("o_orderkey", P.extract_currency(text).alias("amount"))


@query
def p13_date_prefix_split(spark, sf_dir):
    o = _orders(spark, sf_dir)
    day = F.date_format("o_orderdate", "dd MMM")
    text = _by_key(F.col("o_orderkey"), day, F.concat_ws(" ", day, "o_orderpriority"), F.lower(day))
    s = P.split_card_date(text)
    return o.select("o_orderkey", s.date.alias("day"), s.merchant.alias("merchant"))


@query
def p14_card_amount(spark, sf_dir):
    o, t = _orders(spark, sf_dir), _amount_text()
    return o.select("o_orderkey", P.parse_card_amount(t).alias("amount"), P.is_card_credit(t).alias("is_credit"))


MARKERS = ["American Express", "your BARCLAYCARD", "Revolut Ltd", "HSBC UK", "Wise Payments Ltd", "Clockwise", "sort code 1", "Paid in", "nothing", "Mastercard Avios", "hsbc paid amex"]


def _marked(text: str, key: str) -> Column:
    return F.concat_ws(" ", F.col(text), _by_key(F.col(key), *[F.lit(m) for m in MARKERS]))


@query
def p24_detect_provider(spark, sf_dir):
    c = bridge.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", P.detect_provider(_marked("text", "conv_id")).alias("provider"))


PROVIDERS = P.PROVIDERS


def provider_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "provider string, display_name string, engine string")


@query
def p25_provider_config(spark, sf_dir):
    """Provider by name, `amex` for amex_uk, an unknown name as amex_uk."""
    c = p24_detect_provider(spark, sf_dir).withColumn("provider", F.when(F.col("conv_id") % 13 == 0, F.lit("amex")).otherwise(F.col("provider")))
    return c.withColumn("provider", P.known_provider(F.col("provider"))).join(F.broadcast(provider_table(spark)), "provider").select("conv_id", "turn", "provider", "display_name")


@query
def k09_routing(spark, sf_dir):
    c = p24_detect_provider(spark, sf_dir)
    return c.select("conv_id", "turn", P.engine_of(F.col("provider")).alias("engine"))


@query
def p27_pad_rect(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem")
    b = P.padded(F.col("l_quantity"), F.lit(0.0), F.col("l_quantity") + 10, F.col("l_linenumber") * 4.0)
    cents = lambda c: F.round(c * 100).cast("long")
    return li.select("l_orderkey", "l_linenumber", *[cents(b[k]).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query
def p28_y_bucket(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", P.y_bucket(F.col("l_quantity") * 2.0).alias("bucket"))


@query
def p29_int_truncated(spark, sf_dir):
    return bridge.read(spark, sf_dir, "events").select("event_id", P.whole_y(F.col("value")).alias("y"))


@query
def p30_total_band(spark, sf_dir):
    e = bridge.read(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 50 == 0, -F.col("value")).when(F.col("event_id") % 50 == 1, F.lit(float("nan"))).otherwise(F.col("value") * 3)
    return e.select("event_id", P.total_band(v).alias("band"))


MESSAGES = ["No transactions found", "could not PARSE file", "Empty filename", "Landlord mode needs a bank", "timeout", "Nothing to redact in format"]


@query
def p31_error_category(spark, sf_dir):
    e = bridge.read(spark, sf_dir, "events")
    return e.select("event_id", P.error_category(_by_key(F.col("event_id"), *[F.lit(m) for m in MESSAGES], F.lit(None).cast("string"))).alias("category"))


@query
def p32_sanitize(spark, sf_dir):
    return bridge.read(spark, sf_dir, "documents").select("doc_id", P.sanitise_name(F.col("text")).alias("name"))


@query
def p33_escape(spark, sf_dir):
    return bridge.read(spark, sf_dir, "pages").select("page_id", F.md5(P.escape_markup(F.col("html")).cast("binary")).alias("escaped_md5"))


@query
def p34_sample_triage(spark, sf_dir):
    d = bridge.read(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(_marked("text", "doc_id"))
    return d.select("doc_id", P.triage_sample(text).alias("triage"))


# --- layout -----------------------------------------------------------------------------------------------------


@query
def src2_clean_spans(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem")
    raw = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_partkey") % 5 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "l_returnflag", F.lit(" "))).alias("text"))
    return L.clean_spans(raw)


@query
def w01_row_cluster(spark, sf_dir):
    """Rows of order lines, y from the quantity: anchors, not gaps."""
    li = bridge.read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity") * 0.5).alias("y0"))
    return L.cluster_rows(s, 3.0).select("doc_id", "seq", "row_id", F.round(F.col("row_y") * 2).cast("int").alias("anchor"))


@query
def w02_visual_lines(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity") * 0.5).alias("y0"))
    return L.cluster_rows(s, 2.0, strict=True).select("doc_id", "seq", F.col("row_id").alias("line_no"))


@query
def w03_y_bucket_rows(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", P.y_bucket(F.col("l_quantity")).alias("bucket")).agg(F.count(F.lit(1)).alias("spans"))


@query
def w04_phrase_merge(spark, sf_dir):
    """Order lines as spans of one row: x from the quantity, merged over gaps of at most 2."""
    li = _lineitem(spark, sf_dir)
    x = F.col("l_quantity")
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0).alias("row_id"), "seq", F.col("l_linestatus").alias("text"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + F.col("l_linenumber")).alias("x1"), F.lit(1.0).alias("y1"))
    m = L.merge_phrases(s, 2.0)
    return m.select("doc_id", F.col("phrase_id").cast("int").alias("phrase_id"), "text", F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))


def _header_phrases(spark, sf_dir) -> DataFrame:
    st = bridge.statement_spans(bridge.statement_transactions(spark, sf_dir))
    return L.merge_phrases(L.cluster_rows(st, 5.0))


@query
def s05_best_header(spark, sf_dir):
    h = L.best_header(L.header_labels(_header_phrases(spark, sf_dir)))
    return h.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("labels"), F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))


@query
def w05_column_bands(spark, sf_dir):
    st = bridge.statement_spans(bridge.statement_transactions(spark, sf_dir))
    c = L.detect_columns(st).select("doc_id", "page_no", F.posexplode("bands").alias("col_idx", "b"))
    return c.select("doc_id", "page_no", "col_idx", "b.role", F.round(F.col("b.x0") * 1000).cast("long").alias("x0"), F.round(F.col("b.x1") * 1000).cast("long").alias("x1"))


@query
def w06_amount_role(spark, sf_dir):
    """Headers of three labels by customer: date, paid in or details, and a last `amount`, or one in the middle."""
    c = bridge.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    roles = F.array(F.lit("date"), _by_key(k, F.lit("paid_in"), F.lit("description"), F.lit("amount")), _by_key(k, F.lit("amount"), F.lit("amount"), F.lit("balance")))
    h = c.select(k.cast("string").alias("doc_id"), F.lit(0).alias("page_no"), F.posexplode(roles).alias("phrase_id", "role"))
    h = h.withColumns({"x0": F.col("phrase_id") * 100.0, "x1": F.col("phrase_id") * 100.0 + 40, "y1": F.lit(50.0)})
    return L.column_bands(h).select("doc_id", F.array_join(F.transform("bands", lambda b: b.role), ",").alias("roles"))


@query
def j01_assign_role(spark, sf_dir):
    cells = _statement(spark, sf_dir).cells.where("row_y > header_y")
    return cells.groupBy("doc_id", "page_no", "role").agg(F.count(F.lit(1)).alias("cells"))


@query
def w07_dated_groups(spark, sf_dir):
    g = _statement(spark, sf_dir).grouped
    return g.groupBy("doc_id", "page_no", "group_id").agg(F.countDistinct("row_id").alias("rows"), F.count(F.lit(1)).alias("cells"))


def _dateless(spark, sf_dir) -> Statement:
    """Statements without their date column."""
    spans = bridge.statement_spans(bridge.statement_transactions(spark, sf_dir)).where("seq <> 0 and (seq < 10 or seq % 10 <> 0)")
    return read_statement(spans)


@query
def w08_dateless_groups(spark, sf_dir):
    t = _dateless(spark, sf_dir).transactions
    return t.select("doc_id", "page_no", "group_id", "description", "amount", "is_credit")


@query
def a04_group_description(spark, sf_dir):
    return _statement(spark, sf_dir, jitter=False).transactions.select("doc_id", "page_no", "group_id", "description")


@query
def a05_row_amount(spark, sf_dir):
    return _statement(spark, sf_dir).transactions.select("doc_id", "page_no", "group_id", "amount", "is_credit")


@query
def a08_phrase_boxes(spark, sf_dir):
    p = _header_phrases(spark, sf_dir)
    return p.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("phrases"), F.round(F.sum((F.col("x1") - F.col("x0")) * 2)).cast("long").alias("half_points"))


@query
def w10_seen_header(spark, sf_dir):
    """Every third page of a statement loses its header."""
    tx = bridge.statement_transactions(spark, sf_dir)
    spans = bridge.statement_spans(tx).where("page_no % 3 <> 1 or seq > 6")
    pages = tx.select("doc_id", "page_no").distinct()
    return L.seen_header(pages, L.detect_columns(spans)).select("doc_id", "page_no", F.col("header_y").isNotNull().alias("has_header"), "structured_only")


def _line_spans(spark, sf_dir) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    text = F.concat_ws("-", "l_returnflag", "l_linestatus", "l_linenumber")
    y = F.col("l_quantity") * 0.5
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), "seq", text.alias("text"), F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(10.0).alias("x1"), (y + 4).alias("y1"))


@query
def w11_offset_map(spark, sf_dir):
    return L.offset_map(_line_spans(spark, sf_dir)).select("doc_id", "seq", "start", "end")


@query
def src5_page_text(spark, sf_dir):
    return L.page_text(_line_spans(spark, sf_dir)).select("doc_id", "page_text")


@query
def j03_same_line(spark, sf_dir):
    return L.same_line(_line_spans(spark, sf_dir), 2.0).select("doc_id", "seq", "line_text")


@query
def s02_sort_by_y(spark, sf_dir):
    s = _line_spans(spark, sf_dir)
    return s.select("doc_id", "seq", F.row_number().over(L.page_window("y0", "seq")).alias("place"))


@query
def s06_section_start(spark, sf_dir):
    return C.section_starts(_line_spans(spark, sf_dir), ("R-F", "A-F")).select("doc_id", F.round(F.col("section_y") * 2).cast("int").alias("section_y2"))


@query
def src3_section_spans(spark, sf_dir):
    s = C.section_spans(_line_spans(spark, sf_dir), ("R-F", "A-F"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"))


# --- decisions --------------------------------------------------------------------------------------------------


def _totals(spark, sf_dir, params: D.Params, verdicts=None) -> DataFrame:
    s = _statement(spark, sf_dir)
    t = D.kept_total(s.decided(params, verdicts(s) if verdicts else None))
    return t.select("doc_id", "kept_count", F.col("total").cast("decimal(18,2)").alias("total"), "redacted_count")


@query
def k01_keep(spark, sf_dir):
    return _totals(spark, sf_dir, D.Params(["urgent", "Machinery"]))


@query
def k01_redact_direction(spark, sf_dir):
    return _totals(spark, sf_dir, D.Params(["urgent"], direction="redact"))


@query
def k01_landlord(spark, sf_dir):
    return _totals(spark, sf_dir, D.Params([], keep_credits=True))


@query
def k01_landlord_keywords(spark, sf_dir):
    return _totals(spark, sf_dir, D.Params(["urgent"], keep_credits=True))


@query
def k01_no_keywords(spark, sf_dir):
    return _totals(spark, sf_dir, D.Params())


def _instructions(s: Statement) -> DataFrame:
    """Transactions of less than 1000 pounds are told to go; every fifth group has no verdict."""
    v = F.when(F.col("group_id") % 5 != 0, F.col("amount") < 1000)
    return s.transactions.select("doc_id", "page_no", "group_id", F.lit("instruction").alias("kind"), v.alias("verdict"))


@query
def k01_instruction(spark, sf_dir):
    return _totals(spark, sf_dir, D.Params([], keep_credits=False), _instructions)


@query
def k01_instruction_credits(spark, sf_dir):
    return _totals(spark, sf_dir, D.Params(["urgent"], keep_credits=True), _instructions)


@query
def a01_kept_total(spark, sf_dir):
    d = _statement(spark, sf_dir).decided(D.Params(["urgent"]))
    return d.where("decision = 'keep'").agg(F.sum("amount").cast("decimal(18,2)").alias("total"), F.count(F.lit(1)).alias("kept"))


@query
def k05_balance_pass(spark, sf_dir):
    r = _statement(spark, sf_dir).redactions(D.Params(["urgent"], redact_balances=True))
    return r.groupBy("doc_id", "page_no", "reason").agg(F.count(F.lit(1)).alias("boxes"))


@query
def k08_redacted_cells(spark, sf_dir):
    r = _statement(spark, sf_dir).redactions(D.Params(["urgent"]))
    return r.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("boxes"))


@query
def j14_post_redaction_spans(spark, sf_dir):
    s = _statement(spark, sf_dir).survivors(D.Params(["urgent"], redact_balances=True))
    return s.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("spans"))


@query
def u02_words_subset(spark, sf_dir):
    """New words per page after a redaction: there are none."""
    st = _statement(spark, sf_dir)
    return U.new_words(st.spans, st.survivors(D.Params(["urgent"]))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("new_words"))


@query
def u01_flips(spark, sf_dir):
    st = _statement(spark, sf_dir)
    kept = lambda p: st.decided(p).where("decision = 'keep'").select("doc_id", "description")
    f = J.flips(kept(D.Params(["urgent"])), kept(D.Params(["machinery"])))
    return f.groupBy("change", "description").agg(F.count(F.lit(1)).alias("n"))


@query
def u03_redaction_union(spark, sf_dir):
    st = _statement(spark, sf_dir)
    a, b = (st.redactions(D.Params([k], redact_balances=True)).select("doc_id", "page_no", "seq") for k in ("urgent", "machinery"))
    return a.unionByName(b).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"))


@query
def j11_verdict_join(spark, sf_dir):
    st = _statement(spark, sf_dir)
    v = _instructions(st)
    out = st.transactions.join(v.select("doc_id", "page_no", "group_id", "verdict"), ["doc_id", "page_no", "group_id"], "left")
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def w12_batches(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc_id"), F.lit(0).alias("page_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("group_id"))
    return J.batched(li).groupBy("doc_id", "batch_no").agg(F.count(F.lit(1)).alias("questions"))


@query
def a18_batch_completeness(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_no"), "l_linenumber", F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")).alias("prob"))
    return J.all_or_nothing(li).groupBy("doc_id").agg(F.count("prob").alias("answered"))


def _cases(spark, sf_dir) -> DataFrame:
    labels = bridge.read(spark, sf_dir, "labels")
    prob = F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") * 37 % 100) / 100.0)
    return labels.select(prob.alias("prob"), (F.col("quality") == 1).alias("expected"))


@query
def a13_threshold_sweep(spark, sf_dir):
    return J.threshold_sweep(_cases(spark, sf_dir))


@query
def a13_best_threshold(spark, sf_dir):
    return J.best_threshold(J.threshold_sweep(_cases(spark, sf_dir)))


# --- card engines -----------------------------------------------------------------------------------------------


@query
def k03_span_decision(spark, sf_dir):
    d = C.decide_lines(_line_spans(spark, sf_dir), ("R-F", "A-F"), D.Params(["n-o"]))
    return d.groupBy("doc_id", "decision").agg(F.count(F.lit(1)).alias("spans"))


@query
def j05_label_value_semi(spark, sf_dir):
    """Order lines as labels (flag R) and values in the same bucket and half of the page."""
    li = bridge.read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), "l_linenumber", "l_returnflag", F.col("l_quantity").alias("y0"), F.when(F.col("l_partkey") % 2 == 0, 0.0).otherwise(300.0).alias("x0"))
    return C.beside(s.where("l_returnflag <> 'R'"), s.where("l_returnflag = 'R'")).select(F.col("doc_id").alias("l_orderkey"), "l_linenumber")


@query
def j06_clamp_rects(spark, sf_dir):
    """Bars and kept boxes from an order's lines, clamped in line order."""
    li = _lineitem(spark, sf_dir).withColumns({"doc_id": F.col("l_orderkey").cast("string"), "page_no": F.lit(0)})
    bars = li.where("l_returnflag = 'N'").select("doc_id", "page_no", F.col("seq").alias("bar"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 6).alias("y1"))
    kept = li.where("l_returnflag = 'R'").select("doc_id", "page_no", F.col("seq").alias("box"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 5).alias("y1"))
    return C.clamp_bars(bars, kept).select("doc_id", "bar", F.round(F.col("y0") * 2).cast("int").alias("y0"), F.round(F.col("y1") * 2).cast("int").alias("y1"))


@query
def j07_limit_boxes(spark, sf_dir):
    """Spans that meet another span's box that mentions a limit (flag A)."""
    s = _line_spans(spark, sf_dir)
    return C.meeting(s, s.where(F.startswith("text", F.lit("A")))).select("doc_id", "seq")


@query
def j08_unmark_decimals(spark, sf_dir):
    """The last decimal of each whole y, but for those within 1 of a keyword's y."""
    s = _line_spans(spark, sf_dir)
    named = F.contains("text", F.lit("R-"))
    return C.lone_decimals(s.where(~named), s.where(named)).select("doc_id", "y", "seq")


@query
def k04_section_decisions(spark, sf_dir):
    """The span-wise engine of one section and one direction: kept, redacted and skipped spans."""
    d = C.decide_lines(_line_spans(spark, sf_dir), ("R-F",), D.Params(["a-f"], direction="redact"))
    return d.groupBy("decision").agg(F.count(F.lit(1)).alias("spans"))


def card_spans(spark, sf_dir) -> DataFrame:
    """A card page per customer: up to 40 orders in the left column, then the right; every fifth merchant wraps, every
    seventh amount is a credit, every third date is merged with its merchant."""
    o = _orders(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    t = o.select(F.col("o_custkey").cast("string").alias("doc_id"), n.alias("n"), "o_orderkey", "o_orderdate", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    t = t.withColumns({"page_no": F.floor(F.col("n") / 40).cast("int"), "i": F.col("n") % 40})
    t = t.withColumns({"col": F.floor(F.col("i") / 20).cast("int"), "y": 200.0 + 28 * (F.col("i") % 20), "day": F.date_format("o_orderdate", "dd MMM")})
    x = lambda left, right: F.when(F.col("col") == 0, float(left)).otherwise(float(right))
    money = F.concat(F.lit("£"), F.format_number("amount", 2), F.when(F.col("o_orderkey") % 7 == 0, "CR").otherwise(""))
    merged = F.col("o_orderkey") % 3 == 0
    cell = lambda k, text, xx, dy=0.0: F.struct(F.lit(k).alias("k"), text.alias("text"), xx.alias("x"), F.lit(dy).alias("dy"))
    cells = F.array(
        cell(0, F.when(merged, F.concat_ws(" ", "day", "o_orderpriority")).otherwise(F.col("day")), x(52, 330)),
        cell(1, F.when(~merged, F.col("o_orderpriority")), x(84, 361)),
        cell(2, money, x(255, 520)),
        cell(3, F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("BRANCH "), F.col("o_orderkey"))), x(84, 361), 12.0),
    )
    body = t.select("doc_id", "page_no", "i", "y", F.explode(cells).alias("c")).where("c.text is not null")
    body = body.select("doc_id", "page_no", (10 + F.col("i") * 10 + F.col("c.k")).cast("int").alias("seq"), "c.text", "c.x", (F.col("y") + F.col("c.dy")).alias("y"))
    head = t.groupBy("doc_id", "page_no").agg(F.lit(1).alias("one")).select("doc_id", "page_no", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(t).alias("text"), F.lit(float(x0)).alias("x"), F.lit(float(y)).alias("y")) for k, t, x0, y in ((0, C.SECTION_START[0], 52, 183), (1, C.SECTION_END[0], 52, 800), (2, C.SECTION_END[0], 330, 800))])).alias("h")).select("doc_id", "page_no", "h.*")
    return body.unionByName(head).select("doc_id", "page_no", "seq", "text", F.col("x").alias("x0"), (F.col("y") - 8).alias("y0"), (F.col("x") + 2.5 * F.length("text")).alias("x1"), (F.col("y") + 2).alias("y1"))


@query
def w09_wrapped_merchant(spark, sf_dir):
    t = C.card_transactions(card_spans(spark, sf_dir))
    return t.select("doc_id", "page_no", "col", "date", "merchant")


@query
def k02_card_totals(spark, sf_dir):
    t = C.card_transactions(card_spans(spark, sf_dir)).withColumn("decision", D.decision(F.col("merchant"), F.col("is_credit"), D.Params(["urgent"], keep_credits=True)))
    kept = F.col("decision") == "keep"
    return t.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(kept, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("total"), F.count(F.when(kept, F.col("amount"))).alias("kept_count"))


@query
def a09_row_bars(spark, sf_dir):
    t = C.card_transactions(card_spans(spark, sf_dir))
    return t.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("bars"), F.round(F.sum(F.col("bar_y1") - F.col("bar_y0"))).cast("long").alias("points"))


SUMMARY_TEXTS = ["Your new balance", "£120.50", "Minimum payment", "4000 1234 1234 1234", "12.9%", "Number 1234", "Interest and charges", "Tfl Travel", "£9.99"]


@query
def k06_card_summary(spark, sf_dir):
    """Texts of the summary on order lines: bucket from the quantity, half of the page from the part."""
    li = bridge.read(spark, sf_dir, "lineitem")
    y, x = F.col("l_quantity") * 8, F.when(F.col("l_partkey") % 2 == 0, 100.0).otherwise(400.0)
    s = li.select(F.col("l_suppkey").cast("string").alias("doc_id"), (F.col("l_orderkey") % 3).cast("int").alias("page_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), _by_key(F.col("l_partkey") + F.col("l_linenumber"), *[F.lit(t) for t in SUMMARY_TEXTS]).alias("text"), x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 8).alias("y1"))
    return C.financial_summary(s).groupBy("doc_id", "page_no", "reason").agg(F.count(F.lit(1)).alias("spans"))


@query
def k07_financial_details(spark, sf_dir):
    """Details pass with patterns for a redaction, a preserved one, and the zone of the top 40 %."""
    li = bridge.read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linenumber").alias("seq"), _by_key(F.col("l_partkey"), F.lit("Credit Limit: £500.00"), F.lit(" £12.50 "), F.lit("call 0800 111 222 £1.00"), F.lit("CREDIT LIMIT")).alias("text"), F.lit(0.0).alias("x0"), (F.col("l_quantity") * 16).alias("y0"))
    pages = s.select("doc_id", "page_no").distinct().withColumn("height", F.lit(842.0))
    return C.financial_details(s, pages, [r"Credit\s+Limit", "1[.]00"], [r"0800\s+[0-9]+\s+[0-9]+"], 0.4).select("doc_id", "seq")


@query
def p21_summary_labels(spark, sf_dir):
    li = bridge.read(spark, sf_dir, "lineitem")
    t = _by_key(F.col("l_partkey") + F.col("l_linenumber"), *[F.lit(t) for t in SUMMARY_TEXTS])
    return li.select(t.alias("t")).groupBy(F.rlike("t", F.lit(C.SUMMARY_VALUE)).alias("is_value"), F.rlike("t", F.lit(C.CARD_NUMBER)).alias("is_card_number")).agg(F.count(F.lit(1)).alias("n"))


# --- personal data ----------------------------------------------------------------------------------------------

PLANTED = ["sort code 12-34-56", "account no 12345678 of", "ref 12345678 end", "NI number AB123456C", "iban GB29NWBK60161331926819 x", "card 4242424242424242 x", "id 4242424242424241 x", "mail jane@mail.example.com now", "call 020 555 0100 now", "code 123456 end"]


def _planted(spark, sf_dir) -> DataFrame:
    n = bridge.read(spark, sf_dir, "customer")
    return n.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_no"), F.concat_ws(" ", F.lit("Mr"), "c_mktsegment", F.lit("has"), _by_key(F.col("c_custkey"), *[F.lit(p) for p in PLANTED])).alias("page_text"))


@query
def i01_uk_recognizers(spark, sf_dir):
    h = I.recognise(_planted(spark, sf_dir))
    return h.where(F.col("entity_type").startswith("UK_")).select("doc_id", "entity_type", F.col("start").cast("int"), (F.round(F.col("score") * 100)).cast("int").alias("score"))


@query
def i02_card_luhn(spark, sf_dir):
    o = _orders(spark, sf_dir)
    digits = F.concat(F.lit("424242424242"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return o.select("o_orderkey", I.luhn_ok(digits).alias("valid"))


@query
def i02_iban_mod97(spark, sf_dir):
    o = _orders(spark, sf_dir)
    iban = F.concat(F.lit("GB"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("NWBK60161331926819"))
    return o.select("o_orderkey", I.iban_ok(iban).alias("valid"))


@query
def i04_match_offsets(spark, sf_dir):
    d = bridge.read(spark, sf_dir, "documents")
    m = I.match_offsets(F.col("text"), r"[0-9]+\.[0-9]+")
    return d.select("doc_id", F.explode(m).alias("m")).select("doc_id", F.col("m.start").alias("start"), F.col("m.value").alias("value"))


def _findings_input(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two spans a customer, above and below a header at y 100; every fourth page has no header but follows one."""
    c = bridge.read(spark, sf_dir, "customer")
    text = lambda shift: _by_key(F.col("c_custkey") + shift, *[F.lit(p) for p in PLANTED])
    rows = F.explode(F.array(F.struct(F.lit(0).alias("seq"), text(0).alias("text"), F.lit(50.0).alias("y0")), F.struct(F.lit(1).alias("seq"), text(3).alias("text"), F.lit(150.0).alias("y0")))).alias("r")
    spans = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_no"), rows).select("doc_id", "page_no", "r.seq", "r.text", F.lit(10.0).alias("x0"), "r.y0", F.lit(90.0).alias("x1"), (F.col("r.y0") + 10).alias("y1"))
    info = F.col("c_custkey") % 4 == 0
    return spans, c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_no"), F.when(~info, 100.0).alias("header_y"), info.alias("structured_only"))


@query
def i05_region_filter(spark, sf_dir):
    f = I.page_findings(*_findings_input(spark, sf_dir))
    return f.select("doc_id", "entity_type", F.col("y0").cast("int").alias("y0"))


@query
def i06_landlord_preserved(spark, sf_dir):
    f = I.page_findings(*_findings_input(spark, sf_dir), exclude=I.LANDLORD_PRESERVED)
    return f.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query
def a10_pii_counts(spark, sf_dir):
    return I.count_by_type(I.page_findings(*_findings_input(spark, sf_dir)))


def _hits(spark, sf_dir) -> DataFrame:
    """Order lines as hits: ranges from the quantity, types from the flag, scores from the discount."""
    li = _lineitem(spark, sf_dir)
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), "seq", F.col("l_returnflag").alias("entity_type"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity") + 6).cast("int").alias("end"), (F.col("l_discount") * 8).alias("score"))


@query
def j04_pii_shield(spark, sf_dir):
    return I.shielded(_hits(spark, sf_dir), ("R",)).select("doc_id", "seq")


@query
def j02_offset_to_span(spark, sf_dir):
    """Hits at l_quantity in the pages of their order's lines."""
    spans = _line_spans(spark, sf_dir)
    hits = _hits(spark, sf_dir).select("doc_id", "page_no", "seq", "start")
    return I.locate(hits, spans).select("doc_id", "seq", F.round(F.col("y0") * 2).cast("int").alias("span_y"))


@query
def s09_first_candidates(spark, sf_dir):
    e = bridge.read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_no"), F.col("event_id").cast("double").alias("y0"), F.lit(0.0).alias("x0"), F.col("event_type").alias("entity_type"))
    return I.first_candidates(e, 3).select("doc_id", F.col("y0").cast("long").alias("event_id"))


# --- logs and events --------------------------------------------------------------------------------------------


@query
def s09_tail20(spark, sf_dir):
    return U.tail(bridge.read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"])


@query
def s10_debug_listing(spark, sf_dir):
    s = _line_spans(spark, sf_dir)
    y = F.round("y0", 1)
    return s.select("doc_id", "text", F.row_number().over(Window.partitionBy("doc_id").orderBy(y, F.round("x0", 1), "seq")).alias("place"))


@query
def a11_page_fingerprint(spark, sf_dir):
    st = bridge.statement_spans(bridge.statement_transactions(spark, sf_dir))
    return U.page_fingerprints(st)


@query
def a17_usage_stats(spark, sf_dir):
    return U.usage_stats(bridge.read(spark, sf_dir, "events"))


@query
def a16_untouched_pages(spark, sf_dir):
    w = w10_seen_header(spark, sf_dir)
    return w.groupBy("doc_id").agg(F.count_if(~F.col("has_header")).alias("untouched"))


@query
def snk2_output_name(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", sinks.output_name(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)")).alias("name"))


@query
def a12_page_words(spark, sf_dir):
    return U.page_words(_line_spans(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"))


@query
def a14_person_accuracy(spark, sf_dir):
    labels = bridge.read(spark, sf_dir, "labels")
    return J.choice_accuracy(labels.select(((F.col("doc_id") * 53 % 100) / 100.0).alias("prob"), (F.col("toxic") == 1).alias("expected")))


@query
def a15_cases_by_key(spark, sf_dir):
    return bridge.read(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("cases"), F.min("doc_id").alias("first_doc"))


@query
def s07_section_ends(spark, sf_dir):
    return C.section_ends(card_spans(spark, sf_dir)).select("doc_id", "page_no", "col", F.col("end_y").cast("int").alias("end_y"))


@query
def src6_text_in_box(spark, sf_dir):
    box = [F.lit(v) for v in (0.0, 5.0, 20.0, 10.0)]
    return src.text_in_box(_line_spans(spark, sf_dir), *box).select("doc_id", "text")


@query
def src9_json_spans(spark, sf_dir):
    """Order lines as structured-text JSON, a page an order, and back."""
    s = _line_spans(spark, sf_dir)
    line = F.struct(F.concat(F.lit(" "), "text").alias("text"), F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")).alias("bbox"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x.l)
    pages = s.groupBy("doc_id", "page_no").agg(F.to_json(F.struct(F.array(F.struct(lines.alias("lines"))).alias("blocks"))).alias("json"))
    out = src.spans_from_json(pages)
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), "text", F.round(F.col("y0") * 2).cast("int").alias("y"), F.round(F.col("y1") * 2).cast("int").alias("y_end"))


@query
def src10_form_keywords(spark, sf_dir):
    n = bridge.read(spark, sf_dir, "nation")
    parts = F.filter(F.transform(F.split(F.concat(F.lit(" "), "n_name", F.lit(" , ,rent")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return n.select("n_nationkey", F.array_join(parts, "|").alias("keywords"))


@query
def t01_funnel(spark, sf_dir):
    f = S.funnel(bridge.read(spark, sf_dir, "events"))
    return f.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


# --- redaction on the page, requests, sinks, judgments -----------------------------------------------------------


@query
def j09_destroyed_text(spark, sf_dir):
    """Boxes over the middle of the lines with flag A: every character that meets one goes, on whatever line."""
    s = _line_spans(spark, sf_dir)
    boxes = s.where(F.startswith("text", F.lit("A"))).select("doc_id", "page_no", F.lit(3.0).alias("x0"), "y0", F.lit(7.0).alias("x1"), "y1")
    return D.destroyed_text(s, boxes).select("doc_id", "seq", "left")


@query
def i07_enforced(spark, sf_dir):
    """Spans with text left after an enforcing run."""
    spans, regions = _findings_input(spark, sf_dir)
    left = D.destroyed_text(spans, I.enforced(I.page_findings(spans, regions)))
    return left.groupBy("doc_id").agg(F.count_if(F.col("left") != "").alias("left"))


@query
def k10_request_error(spark, sf_dir):
    k = F.col("o_orderkey")
    direction = _by_key(k, F.lit("keep"), F.lit("redact"), F.lit("both"), F.lit(None))
    keywords = _by_key(F.floor(k / 4), F.lit("rent, food"), F.lit(" , "), F.lit(None))
    told = _by_key(F.floor(k / 16), F.lit(None), F.lit("no coffee"), F.lit("  "))
    name = _by_key(F.floor(k / 8), F.lit("a.pdf"), F.lit("b.pdf"), F.lit("c.pdf"), F.lit(""), F.lit(None))
    return _orders(spark, sf_dir).select("o_orderkey", D.request_error(direction, keywords, told, k % 5 == 0, k % 7 != 0, name).alias("error"))


@query
def snk3_total_annotations(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("doc_id", F.col("o_custkey"))
    ends = o.groupBy("doc_id", (F.col("o_orderkey") % 3).cast("int").alias("page_no")).agg(F.min(F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 700).cast("double"))).alias("end_y"))
    totals = o.groupBy("doc_id").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    return sinks.total_annotations(ends, totals).select("doc_id", "page_no", F.col("y").cast("int").alias("y"), "text")


@query
def snk5_log_lines(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select(sinks.log_line(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("o_orderstatus")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def src7_log_values(spark, sf_dir):
    """Log lines, blank ones among them, read back."""
    o = _orders(spark, sf_dir)
    lines = o.select(_by_key(F.col("o_orderkey"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(",a,"), "o_orderstatus"), F.lit("  ")).alias("value"))
    return src.parse_log(lines).groupBy("value").agg(F.count("ts").alias("n"))


@query
def snk9_response(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", sinks.response(order=F.col("o_orderkey"), status=F.col("o_orderstatus")).alias("body"))


@query
def t02_running_count(spark, sf_dir):
    return S.running_count(bridge.read(spark, sf_dir, "events"))


@query
def p22_second_zone(spark, sf_dir):
    """The details pass with the second card's zone and lists."""
    li = bridge.read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linenumber").alias("seq"), _by_key(F.col("l_partkey"), F.lit("Credit Limit: £500.00"), F.lit(" £12.50 "), F.lit("call 0800 111 222 £1.00"), F.lit("CREDIT LIMIT")).alias("text"), F.lit(0.0).alias("x0"), (F.col("l_quantity") * 16).alias("y0"))
    pages = s.select("doc_id", "page_no").distinct().withColumn("height", F.lit(842.0))
    return C.financial_details(s, pages, [r"0800\s+[0-9]+"], ["credit limit"], 0.3).select("doc_id", "seq")


@query
def p23_legacy_patterns(spark, sf_dir):
    o = _orders(spark, sf_dir)
    t = _by_key(F.col("o_orderkey"), F.lit("£1,200.50"), F.lit("Jan 12"), F.lit("rate 12.34%"), F.lit("plain"))
    return o.select(t.alias("t")).groupBy(*[F.rlike("t", F.lit(p)).alias(n) for n, p in (("currency", U.LEGACY_CURRENCY), ("day", U.LEGACY_DATE), ("decimal", U.LEGACY_DECIMAL))]).agg(F.count(F.lit(1)).alias("n"))


@query
def a19_legacy_total(spark, sf_dir):
    money = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    t = _by_key(F.col("o_orderkey"), money, F.concat(F.lit("£"), money), F.lit("12.34%"))
    return U.legacy_total(_orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), t.alias("text")))


@query
def a20_debug_transactions(spark, sf_dir):
    """All transactions of all pages with their number in the document; nothing is redacted."""
    t = _statement(spark, sf_dir).transactions
    return t.select("doc_id", "page_no", "group_id", "description", "amount", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("of"))


@query
def s01_reading_order(spark, sf_dir):
    return _line_spans(spark, sf_dir).select("doc_id", "seq", F.row_number().over(L.page_window("y0", "x0", "seq")).alias("place"))


@query
def j03_semantic_keywords(spark, sf_dir):
    """Verdicts by a scorer of the text's length; only those of 0.75 and more keep."""

    def scorer(texts):
        return [len(t) % 10 / 10 for t in texts]

    return _totals(spark, sf_dir, D.Params(["no such word"]), lambda s: J.keyword_verdicts(s.transactions, scorer))


@query
def j08_judged_header(spark, sf_dir):
    """Statements whose header labels say nothing: a picker and an assigner find the columns."""
    spans = bridge.statement_spans(bridge.statement_transactions(spark, sf_dir))
    roles = {f"Col {c}": r for c, r in zip("abcde", ("date", "description", "paid_out", "paid_in", "balance"))}
    label = F.lit(None).cast("string")
    for odd, (_, known) in zip(roles, bridge.COLUMNS.values()):
        label = F.when(F.col("text") == known, odd).otherwise(label)
    spans = spans.withColumn("text", F.coalesce(label, "text"))

    def pick(lines):
        return next(((k, 0.9) for k, p in enumerate(lines) if "Col a" in p), None)

    def assign(texts):
        return [roles.get(t) for t in texts]

    s = read_statement(spans, columns=J.judged_columns(L.clean_spans(spans), pick, assign))
    t = D.kept_total(s.decided(D.Params(["urgent"])))
    return t.select("doc_id", "kept_count", F.col("total").cast("decimal(18,2)").alias("total"), "redacted_count")


@query
def j09_stamped_lines(spark, sf_dir):
    """One verdict a visual line, on all of its spans; lines of an even number of spans score 0.75."""
    li = bridge.read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linenumber").alias("seq"), F.lit("a-b-c").alias("text"), F.lit(0.0).alias("x0"), (F.col("l_quantity") * 0.5).alias("y0"))

    def scorer(texts):
        return [len(t) % 4 / 4 for t in texts]

    return J.stamped(s, scorer).groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("row_id").alias("line_no")).agg(F.count(F.lit(1)).alias("spans"), F.min("verdict").alias("verdict"))


@query
def u04_kept_people(spark, sf_dir):
    """All above y 25; below it structured types, and the people that a classifier calls so with 0.6 or more."""
    li = _lineitem(spark, sf_dir)
    f = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("seq").cast("double").alias("x0"), F.col("l_quantity").cast("double").alias("y0"), _by_key(F.col("l_partkey"), F.lit("PERSON"), F.lit("PHONE_NUMBER"), F.lit("IBAN_CODE")).alias("entity_type"), (F.col("l_partkey") % 3 == 2).alias("structured"), F.lit(25.0).alias("header_y"), (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_suppkey") % 2 == 0, "person").otherwise("merchant").alias("choice"))
    return J.kept_people(f.drop("confidence", "choice"), f.select("doc_id", "page_no", "x0", "y0", "choice", "confidence")).select("doc_id", F.col("x0").cast("long").alias("seq"), "entity_type")


@query
def j13_label_lookup(spark, sf_dir):
    labels = bridge.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("expected"))
    docs = bridge.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return J.label_lookup(docs, labels, ["doc_id"]).groupBy("lang", "expected").agg(F.count(F.lit(1)).alias("n"))


@query
def p35_feature_flags(spark, sf_dir):
    k = F.col("o_orderkey")
    on = J.enabled(k % 2 == 0, _by_key(F.floor(k / 2), F.lit("on"), F.lit("off"), F.lit(None)), _by_key(F.floor(k / 8), F.lit("key"), F.lit(" ")))
    return _orders(spark, sf_dir).select("o_orderkey", on.alias("enabled"))


# --- files, orders of rows, counters, reports, judged people -------------------------------------------------------


@query
def src1_file_spans(spark, sf_dir):
    """Files read whole and turned to spans by a caller's extractor: each text of a table's second column is a span."""

    def extractor(raw: bytes) -> list[tuple]:
        texts = pq.read_table(pa.BufferReader(raw)).column(1).to_pylist()
        return [(0, t, 0.0, 10.0 * k, 50.0, 10.0 * k + 8) for k, t in enumerate(texts)]

    spans = src.extract_spans(src.documents(spark, sf_dir, "region.parquet"), extractor)
    return spans.select(F.element_at(F.split("doc_id", "/"), -1).alias("file"), "seq", "text", F.col("y0").cast("int").alias("y"))


@query
def src8_files(spark, sf_dir):
    """The files of a folder in lexicographic order, a folder of parts as one; their contents are not read."""
    return src.file_order(src.entries(spark, sf_dir, "*.parquet")).select("name", "place")


@query
def s03_bucket_order(spark, sf_dir):
    """Card spans in the order of their four-point rows, then from left to right."""
    li = _lineitem(spark, sf_dir)
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), "seq", F.col("l_quantity").alias("y0"), (F.col("l_partkey") % 4).alias("x0"))
    return s.select("doc_id", "seq", F.row_number().over(C.bucket_order()).alias("place"))


@query
def s08_last_dates(spark, sf_dir):
    """Columns without an end mark end below their last bare date, the last in extraction order."""
    li = _lineitem(spark, sf_dir)
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), "seq", _by_key(F.col("l_partkey"), F.lit("24 Aug"), F.lit("Shop"), F.lit(" 3 Sep ")).alias("text"), _by_key(F.col("l_suppkey"), F.lit(52.0), F.lit(330.0), F.lit(200.0)).alias("x0"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 8).alias("y1"))
    return C.section_ends(s).select("doc_id", "col", F.col("end_y").cast("int").alias("end_y"))


@query
def snk4_usage_count(spark, sf_dir):
    """Lines of an append log, blank ones left out; a log without lines counts 0."""
    o = _orders(spark, sf_dir)
    line = _by_key(F.col("o_orderkey"), sinks.log_line(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("done")), F.lit("  "), F.lit(None))
    return U.usage_count(o.select(line.alias("value")))


@query
def i08_page_report(spark, sf_dir):
    """What a reporting run prints: a line a page and a line a document, without any matched text."""
    spans, regions = _findings_input(spark, sf_dir)
    return I.report(I.page_findings(spans, regions), regions).select("doc_id", "page_no", "line")


@query
def j05_people(spark, sf_dir):
    """The first 20 candidates of a page, chosen by a classifier of their texts; 0.6 and more counts."""
    li = _lineitem(spark, sf_dir)
    f = li.select((F.col("l_orderkey") % 16).alias("doc_id"), F.floor(F.col("l_orderkey") / 32).cast("int").alias("page_no"), F.col("l_orderkey").cast("double").alias("y0"), F.col("seq").cast("double").alias("x0"), F.lit("PERSON").alias("entity_type"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("description"))

    def classifier(texts):
        return [("person" if t[0] == "A" else "merchant", 0.9 if t[-1] == "F" else 0.5) for t in texts]

    people = J.people(f, classifier).where((F.col("choice") == "person") & (F.col("confidence") >= J.PERSON_MIN))
    return people.select("doc_id", "page_no", F.col("y0").cast("long").alias("order"), F.col("x0").cast("int").alias("seq"))
