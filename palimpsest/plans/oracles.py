"""SQL twins of palimpsest.plans.queries, for DuckDB over the same tables.

Layout queries are held against plain relational answers from the star schema, not against a second layout engine.
"""

from __future__ import annotations

from palimpsest.functions import predicates as P
from palimpsest.operators import card as C
from palimpsest.plans.queries import LABELS, MARKERS, MESSAGES, PLANTED, PROVIDERS, SUMMARY_TEXTS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _by_key(key: str, *cases: str) -> str:
    return f"CASE ({key}) % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


MONEY = "format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2)))"
DATE_TEXT = _by_key("o_orderkey", "strftime(o_orderdate, '%-d %b %Y')", "strftime(o_orderdate, '%d/%m/%Y')", "strftime(o_orderdate, '%b %Y')", "strftime(o_orderdate, '%-d %b %y')", "strftime(o_orderdate, '%-d %b %Y') || ' extra'")
AMOUNT_TEXT = _by_key("o_orderkey", MONEY, f"'£' || {MONEY}", f"'-' || {MONEY}", f"{MONEY} || 'CR'", f"'Total ' || {MONEY}", f"'£ ' || {MONEY} || ' cr'", "'n/a'")
TX = """
WITH numbered AS (
  SELECT o.*, c_mktsegment, n_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
tx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(n // 25 AS INTEGER) AS page_no, CAST(n % 25 AS INTEGER) AS i, o_orderkey,
    o_orderpriority || ' ' || c_mktsegment || ' ' || n_name AS description, CASE WHEN o_orderkey % 4 = 0 THEN 'REF ' || o_orderkey END AS wrap,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderstatus = 'P' AS is_credit,
    description || coalesce(' ' || wrap, '') AS full_text,
    sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS balance
  FROM numbered)
"""
CELLS_OF_ROW = "4 + CASE WHEN wrap IS NOT NULL THEN 1 ELSE 0 END"


def _totals(keep: str) -> str:
    return f"""{TX}, d AS (SELECT *, {keep} AS keep FROM tx)
SELECT doc_id, count(*) FILTER (WHERE keep) AS kept_count, CAST(coalesce(sum(amount) FILTER (WHERE keep), 0) AS DECIMAL(18,2)) AS total, count(*) FILTER (WHERE NOT keep) AS redacted_count
FROM d GROUP BY doc_id"""


def _has(*words: str, text: str = "full_text") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {_q(w.lower())})" for w in words) + ")"


TOLD = "((i + 1) % 5 <> 0 AND amount < 1000)"


def _bounded(words: list[str]) -> str:
    return "(^|[^0-9A-Za-z_])(" + "|".join(w.replace(".", "[.]") for w in words) + ")($|[^0-9A-Za-z_])"


def _provider(text: str) -> str:
    out = f"CASE WHEN {text} IS NULL THEN NULL "
    for slug, marks in P.PROVIDER_MARKERS.items():
        out += "WHEN " + " OR ".join(f"contains(lower({text}), {_q(m)})" for m in marks) + f" THEN '{slug}' "
    for slug, words in P.PROVIDER_WORDS.items():
        out += f"WHEN regexp_matches(lower({text}), {_q(_bounded(words))}) THEN '{slug}' "
    return out + f"WHEN contains(lower({text}), 'mastercard avios') THEN 'barclaycard' END"


def _marked(text: str, key: str) -> str:
    return f"({text} || ' ' || {_by_key(key, *map(_q, MARKERS))})"


def _header_role(t: str) -> str:
    bare = f"regexp_replace({t}, '[^a-z0-9]', '', 'g')"
    out = f"CASE WHEN {t} = '' THEN NULL "
    for label, role in P.EXACT_LABELS.items():
        out += f"WHEN {bare} = '{label.replace(' ', '')}' THEN '{role}' "
    out += f"WHEN length({t}) > {P.LABEL_CHARS} OR len(string_split({t}, ' ')) > {P.LABEL_WORDS} THEN NULL "
    for role, labels in P.ROLE_LABELS.items():
        exact = ", ".join(_q(x.replace(" ", "")) for x in labels)
        out += f"WHEN regexp_matches({t}, {_q(_bounded(labels))}) OR {bare} IN ({exact}) THEN '{role}' "
    return out + "END"


ROLE_OF = _by_key("l_partkey", *map(_q, ("date", "description", "paid_out", "paid_in", "balance")))
LINE_TEXT = "l_returnflag || '-' || l_linestatus || '-' || l_linenumber"
SEQ = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER)"
LINES = f"SELECT l_orderkey AS doc_id, {SEQ} AS seq, {LINE_TEXT} AS text, l_quantity * 0.5 AS y0, l_quantity * 0.5 + 4 AS y1, l_quantity FROM lineitem"
BUCKET = "CAST(round_even({0} / 4, 0) * 4 AS INTEGER)"
CARD = """
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders),
card AS (
  SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(n // 40 AS INTEGER) AS page_no, CAST((n % 40) // 20 AS INTEGER) AS col, strftime(o_orderdate, '%d %b') AS date,
    o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ' BRANCH ' || o_orderkey ELSE '' END AS merchant, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderkey % 7 = 0 AS is_credit, o_orderkey
  FROM numbered)
"""
SUMMARY_KEY = "l_partkey + l_linenumber"
VALUE = "regexp_matches({0}, '(?i)^(£[0-9,]+[.][0-9]{{2}}|[0-9]{{4}}\\s+[0-9]{{4}}\\s+[0-9]{{4}}\\s+[0-9]{{4}}|[0-9]+[.][0-9]+%|\\([0-9]+[.][0-9]+%\\s+compound.*\\))$')"
CARD_NO = "regexp_matches({0}, '^([0-9]{{4}}\\s+[0-9]{{4}}\\s+[0-9]{{4}}\\s+[0-9]{{4}}|Number\\s+[0-9]{{4}})')"
TYPES = {0: ("UK_SORT_CODE", 85), 1: ("UK_ACCOUNT_NUMBER", 65), 2: ("UK_ACCOUNT_NUMBER", 30), 3: ("UK_NINO", 85), 4: ("IBAN_CODE", 100), 5: ("CREDIT_CARD", 100), 7: ("EMAIL_ADDRESS", 100), 8: ("PHONE_NUMBER", 75), 9: ("UK_SORT_CODE", 10)}
FOUND = {k: t for k, (t, s) in TYPES.items() if s >= 40}
ALWAYS = ("UK_SORT_CODE", "UK_ACCOUNT_NUMBER", "UK_NINO", "IBAN_CODE", "CREDIT_CARD", "EMAIL_ADDRESS")


def _found(exclude: tuple[str, ...] = ()) -> str:
    """What is found on the two spans of a customer's page: above the header by key, below it by key + 3."""
    kind = lambda shift: "CASE (c_custkey + %d) %% 10 " % shift + " ".join(f"WHEN {k} THEN '{t}'" for k, t in FOUND.items()) + " END"
    always = ", ".join(map(_q, ALWAYS))
    gone = " AND entity_type NOT IN (" + ", ".join(map(_q, exclude)) + ")" if exclude else ""
    return f"""WITH f AS (
  SELECT c_custkey AS doc_id, {kind(0)} AS entity_type, 50 AS y0, c_custkey % 4 <> 0 AS any_type FROM customer
  UNION ALL SELECT c_custkey, {kind(3)}, 150, FALSE FROM customer),
found AS (SELECT * FROM f WHERE entity_type IS NOT NULL AND (any_type OR entity_type IN ({always})){gone})
"""


def _start(k: int) -> int:
    """Where the planted datum starts in its text."""
    return PLANTED[k].index({0: "12-", 1: "1234", 2: "1234", 3: "AB", 9: "1234"}[k])


W_FOLD = """WITH RECURSIVE s AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_quantity * 0.5 AS y0, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS k FROM lineitem),
fold AS (
  SELECT doc_id, seq, k, y0 AS anchor, 0 AS row_id FROM s WHERE k = 1
  UNION ALL
  SELECT s.doc_id, s.seq, s.k, CASE WHEN s.y0 - f.anchor {0} THEN s.y0 ELSE f.anchor END, f.row_id + CASE WHEN s.y0 - f.anchor {0} THEN 1 ELSE 0 END
  FROM fold f JOIN s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
"""

SQL: dict[str, str] = {
    "p01_date_cells": f"SELECT o_orderkey, regexp_matches({DATE_TEXT}, {_q(P.DATE_CELL)}) AS is_date FROM orders",
    "p02_amount_cells": f"SELECT o_orderkey, regexp_matches({AMOUNT_TEXT}, {_q(P.AMOUNT_CELL)}) AS is_amount FROM orders",
    "p03_parse_amount": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 IN (4, 6) THEN 0 ELSE abs(CAST(o_totalprice AS DECIMAL(18,2))) END AS DECIMAL(18,2)) AS amount FROM orders",
    "p04_carry_rows": "SELECT o_orderkey, o_orderkey % 3 <> 2 AS is_carry FROM orders",
    "p05_header_role": "WITH l AS (SELECT n_nationkey, unnest([" + ", ".join(map(_q, LABELS)) + f"]) AS label FROM nation), s AS (SELECT *, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS t FROM l) SELECT n_nationkey, label, {_header_role('t')} AS role FROM s",
    "p06_credible_header": f"SELECT l_orderkey, count(DISTINCT {ROLE_OF}) >= 3 AND bool_or({ROLE_OF} IN ('date', 'description')) AND bool_or({ROLE_OF} IN ('paid_in', 'paid_out', 'balance', 'amount')) AS credible FROM lineitem GROUP BY l_orderkey",
    "p10_keyword_match": "SELECT o_orderkey, o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%' AS named FROM orders",
    "p12_currency_extract": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 < 2 THEN o_totalprice END AS DECIMAL(18,2)) AS amount FROM orders",
    "p13_date_prefix_split": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%d %b') END AS day, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS merchant FROM orders",
    "p14_card_amount": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 1 THEN o_totalprice END AS DECIMAL(18,2)) AS amount, o_orderkey % 7 IN (3, 5) AS is_credit FROM orders",
    "p24_detect_provider": f"SELECT conv_id, turn, {_provider(_marked('text', 'conv_id'))} AS provider FROM conversations",
    "p25_provider_config": f"WITH d AS (SELECT conv_id, turn, CASE WHEN conv_id % 13 = 0 THEN 'amex_uk' ELSE coalesce({_provider(_marked('text', 'conv_id'))}, 'amex_uk') END AS provider FROM conversations) SELECT conv_id, turn, provider, CASE provider " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b, _ in PROVIDERS) + " END AS display_name FROM d",
    "k09_routing": f"WITH d AS (SELECT conv_id, turn, {_provider(_marked('text', 'conv_id'))} AS p FROM conversations) SELECT conv_id, turn, CASE WHEN p IN ('generic_bank_uk', 'hsbc', 'revolut', 'wise') THEN 'bank' WHEN p = 'barclaycard' THEN 'card' WHEN p = 'amex_uk' THEN 'card_privacy' ELSE 'generic_card' END AS engine FROM d",
    "p27_pad_rect": "SELECT l_orderkey, l_linenumber, CAST(round((l_quantity - 1) * 100) AS BIGINT) AS x0, CAST(l_linenumber * 100 AS BIGINT) AS y0, CAST(round((l_quantity + 11) * 100) AS BIGINT) AS x1, CAST(l_linenumber * 300 AS BIGINT) AS y1 FROM lineitem",
    "p28_y_bucket": f"SELECT l_orderkey, l_linenumber, {BUCKET.format('l_quantity * 2.0')} AS bucket FROM lineitem",
    "p29_int_truncated": "SELECT event_id, CAST(trunc(value) AS INTEGER) AS y FROM events",
    "p30_total_band": "WITH v AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN -value WHEN event_id % 50 = 1 THEN NULL ELSE value * 3 END AS v FROM events) SELECT event_id, CASE WHEN v IS NULL OR v < 0 THEN 'unknown' WHEN v <= 10 THEN '0-10' WHEN v <= 50 THEN '11-50' WHEN v <= 250 THEN '51-250' WHEN v <= 1000 THEN '251-1000' ELSE '1000+' END AS band FROM v",
    "p31_error_category": f"WITH m AS (SELECT event_id, lower(coalesce({_by_key('event_id', *map(_q, MESSAGES), 'NULL')}, '')) AS m FROM events) SELECT event_id, CASE WHEN contains(m, 'no transactions') OR contains(m, 'nothing to redact') THEN 'no_transactions' WHEN contains(m, 'parse') OR contains(m, 'format') THEN 'parse_failed' WHEN contains(m, 'no file') OR contains(m, 'empty filename') THEN 'no_file' WHEN contains(m, 'landlord mode') THEN 'landlord_on_card' ELSE 'server_error' END AS category FROM m",
    "p32_sanitize": "SELECT doc_id, nullif(trim(substr(regexp_replace(substr(text, 1, 200), '[^A-Za-z0-9 ]', '', 'g'), 1, 60)), '') AS name FROM documents",
    "p33_escape": "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages",
    "p34_sample_triage": f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {_marked('text', 'doc_id')} END AS t FROM documents) SELECT doc_id, CASE WHEN t IS NULL THEN 'no_file' WHEN {_provider('t')} IN ('amex_uk', 'barclaycard') THEN 'already_supported' WHEN length(trim(t)) < 300 THEN 'unreadable' ELSE 'statement' END AS triage FROM d",
    "src2_clean_spans": "SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_returnflag AS text FROM lineitem WHERE l_partkey % 5 <> 0",
    "w01_row_cluster": W_FOLD.format("> 3") + "SELECT doc_id, seq, row_id, CAST(round(anchor * 2) AS INTEGER) AS anchor FROM fold",
    "w02_visual_lines": W_FOLD.format(">= 2") + "SELECT doc_id, seq, row_id AS line_no FROM fold",
    "w03_y_bucket_rows": f"SELECT l_orderkey, {BUCKET.format('l_quantity')} AS bucket, count(*) AS spans FROM lineitem GROUP BY 1, 2",
    "w04_phrase_merge": f"""WITH s AS (SELECT l_orderkey AS doc_id, {SEQ} AS seq, l_linestatus AS text, l_quantity AS x0, l_quantity + l_linenumber AS x1 FROM lineitem),
g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY x0, seq)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY x0, seq) - 1 AS phrase_id FROM g)
SELECT doc_id, CAST(phrase_id AS INTEGER) AS phrase_id, string_agg(text, ' ' ORDER BY x0, seq) AS text, CAST(min(x0) AS INTEGER) AS x0, CAST(last(x1 ORDER BY x0, seq) AS INTEGER) AS x1 FROM p GROUP BY doc_id, phrase_id""",
    "s05_best_header": f"{TX} SELECT DISTINCT doc_id, page_no, CAST(5 AS BIGINT) AS labels, 'balance,date,description,paid_in,paid_out' AS roles FROM tx",
    "w05_column_bands": f"{TX}, b(col_idx, role, x0, x1) AS (VALUES (0, 'date', 0, 100625), (1, 'description', 100625, 251125), (2, 'paid_out', 251125, 405625), (3, 'paid_in', 405625, 489250), (4, 'balance', 489250, 595000)), p AS (SELECT DISTINCT doc_id, page_no FROM tx) SELECT doc_id, page_no, col_idx, role, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1 FROM p, b",
    "w06_amount_role": "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'date,paid_in,balance' WHEN 1 THEN 'date,description,paid_out' ELSE 'date,paid_out,balance' END AS roles FROM customer",
    "j01_assign_role": f"""{TX}, r AS (SELECT doc_id, page_no, unnest(CASE WHEN wrap IS NULL THEN ['date', 'description', CASE WHEN is_credit THEN 'paid_in' ELSE 'paid_out' END, 'balance'] ELSE ['date', 'description', 'description', CASE WHEN is_credit THEN 'paid_in' ELSE 'paid_out' END, 'balance'] END) AS role FROM tx)
SELECT doc_id, page_no, role, count(*) AS cells FROM r GROUP BY 1, 2, 3""",
    "w07_dated_groups": f"{TX} SELECT doc_id, page_no, CAST(i + 1 AS BIGINT) AS group_id, CAST(CASE WHEN wrap IS NULL THEN 1 ELSE 2 END AS BIGINT) AS rows, CAST({CELLS_OF_ROW} AS BIGINT) AS cells FROM tx",
    "w08_dateless_groups": f"{TX} SELECT doc_id, page_no, CAST(i + 1 AS BIGINT) AS group_id, full_text AS description, amount, is_credit FROM tx",
    "a04_group_description": f"{TX} SELECT doc_id, page_no, CAST(i + 1 AS BIGINT) AS group_id, full_text AS description FROM tx",
    "a05_row_amount": f"{TX} SELECT doc_id, page_no, CAST(i + 1 AS BIGINT) AS group_id, amount, is_credit FROM tx",
    "a08_phrase_boxes": f"""{TX}, w AS (SELECT doc_id, page_no, wrap, length(description) + length(format('{{:,.2f}}', amount)) + length(format('{{:,.2f}}', balance)) + coalesce(length(wrap), 0) AS chars FROM tx)
SELECT doc_id, page_no, CAST(sum({CELLS_OF_ROW} - 1) + 7 AS BIGINT) AS phrases, CAST(sum(chars * 11 + 120) + 11 * ({sum(map(len, ['Date', 'Description', 'Paid out', 'Paid in', 'Balance', 'Sort Code 12-34-56', 'Jane Smith']))}) AS BIGINT) AS half_points FROM w GROUP BY 1, 2""",
    "w10_seen_header": f"{TX}, p AS (SELECT DISTINCT doc_id, page_no FROM tx) SELECT doc_id, page_no, page_no % 3 <> 1 AS has_header, page_no % 3 = 1 AS structured_only FROM p",
    "w11_offset_map": f"WITH s AS ({LINES}), o AS (SELECT doc_id, seq, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM s) SELECT doc_id, seq, CAST(st AS INTEGER) AS start, CAST(st + length(text) AS INTEGER) AS \"end\" FROM o",
    "src5_page_text": f"WITH s AS ({LINES}) SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS page_text FROM s GROUP BY doc_id",
    "j03_same_line": f"WITH s AS ({LINES}) SELECT a.doc_id, a.seq, string_agg(b.text, ' ' ORDER BY b.y0, b.seq) AS line_text FROM s a JOIN s b ON a.doc_id = b.doc_id AND abs(a.y0 - b.y0) < 2 GROUP BY a.doc_id, a.seq",
    "s02_sort_by_y": f"WITH s AS ({LINES}) SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y0, seq) AS INTEGER) AS place FROM s",
    "s06_section_start": f"WITH s AS ({LINES}) SELECT doc_id, CAST(round(first(y1 ORDER BY seq) * 2) AS INTEGER) AS section_y2 FROM s WHERE contains(text, 'R-F') OR contains(text, 'A-F') GROUP BY doc_id",
    "src3_section_spans": f"WITH s AS ({LINES}), h AS (SELECT doc_id, first(y1 ORDER BY seq) AS y FROM s WHERE contains(text, 'R-F') OR contains(text, 'A-F') GROUP BY doc_id) SELECT s.doc_id, count(*) AS spans FROM s JOIN h ON s.doc_id = h.doc_id AND s.y0 > h.y GROUP BY 1",
    "k01_keep": _totals(_has("urgent", "machinery")),
    "k01_redact_direction": _totals(f"NOT {_has('urgent')}"),
    "k01_landlord": _totals("is_credit"),
    "k01_landlord_keywords": _totals(f"({_has('urgent')} OR is_credit)"),
    "k01_no_keywords": _totals("TRUE"),
    "k01_instruction": _totals(f"NOT {TOLD}"),
    "k01_instruction_credits": _totals(f"(({_has('urgent')} AND NOT {TOLD}) OR is_credit)"),
    "a01_kept_total": f"{TX} SELECT CAST(sum(amount) AS DECIMAL(18,2)) AS total, count(*) AS kept FROM tx WHERE {_has('urgent')}",
    "k05_balance_pass": f"""{TX}, r AS (SELECT doc_id, page_no, 'balance' AS reason, 1 AS n FROM tx UNION ALL SELECT doc_id, page_no, 'transaction', {CELLS_OF_ROW} - 1 FROM tx WHERE NOT {_has('urgent')})
SELECT doc_id, page_no, reason, CAST(sum(n) AS BIGINT) AS boxes FROM r GROUP BY 1, 2, 3""",
    "k08_redacted_cells": f"{TX} SELECT doc_id, page_no, CAST(sum({CELLS_OF_ROW} - 1) AS BIGINT) AS boxes FROM tx WHERE NOT {_has('urgent')} GROUP BY 1, 2",
    "j14_post_redaction_spans": f"{TX} SELECT doc_id, page_no, CAST(7 + coalesce(sum({CELLS_OF_ROW} - 1) FILTER (WHERE {_has('urgent')}), 0) AS BIGINT) AS spans FROM tx GROUP BY 1, 2",
    "u02_words_subset": "SELECT CAST('' AS VARCHAR) AS doc_id, CAST(0 AS BIGINT) AS new_words FROM region WHERE FALSE",
    "u01_flips": f"{TX}, u AS (SELECT full_text AS d FROM tx WHERE {_has('urgent')}), m AS (SELECT full_text AS d FROM tx WHERE {_has('machinery')}), f AS (SELECT 'lost' AS change, d FROM (SELECT d FROM u EXCEPT ALL SELECT d FROM m) UNION ALL SELECT 'gained', d FROM (SELECT d FROM m EXCEPT ALL SELECT d FROM u)) SELECT change, d AS description, count(*) AS n FROM f GROUP BY 1, 2",
    "u03_redaction_union": f"{TX} SELECT doc_id, CAST(sum(1 + CASE WHEN {_has('urgent')} AND {_has('machinery')} THEN 0 ELSE {CELLS_OF_ROW} - 1 END) AS BIGINT) AS spans FROM tx GROUP BY 1",
    "j11_verdict_join": f"{TX} SELECT CASE WHEN (i + 1) % 5 <> 0 THEN amount < 1000 END AS verdict, count(*) AS n FROM tx GROUP BY 1",
    "w12_batches": "WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 40 AS batch_no FROM lineitem) SELECT doc_id, CAST(batch_no AS INTEGER) AS batch_no, count(*) AS questions FROM b GROUP BY 1, 2",
    "a18_batch_completeness": "SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CASE WHEN bool_and(l_partkey % 11 <> 0) THEN count(*) ELSE 0 END AS answered FROM lineitem GROUP BY l_orderkey",
    "a13_threshold_sweep": "WITH c AS (SELECT CASE WHEN doc_id % 9 <> 0 THEN (doc_id * 37 % 100) / 100.0 END AS p, quality = 1 AS e FROM labels), t(threshold) AS (VALUES (0.5), (0.6), (0.7), (0.75), (0.8), (0.9)) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE (p >= threshold) = e) AS \"right\", count(*) AS cases, round(count(*) FILTER (WHERE (p >= threshold) = e) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM c, t GROUP BY threshold",
    "a13_best_threshold": "WITH c AS (SELECT CASE WHEN doc_id % 9 <> 0 THEN (doc_id * 37 % 100) / 100.0 END AS p, quality = 1 AS e FROM labels), t(threshold) AS (VALUES (0.5), (0.6), (0.7), (0.75), (0.8), (0.9)), s AS (SELECT threshold, count(*) FILTER (WHERE (p >= threshold) = e) AS r FROM c, t GROUP BY threshold) SELECT CAST(threshold AS DOUBLE) AS threshold FROM s ORDER BY r DESC, threshold LIMIT 1",
    "k03_span_decision": f"""WITH s AS ({LINES}), h AS (SELECT doc_id, first(y1 ORDER BY seq) AS y FROM s WHERE contains(text, 'R-F') OR contains(text, 'A-F') GROUP BY doc_id),
i AS (SELECT s.* FROM s JOIN h ON s.doc_id = h.doc_id AND s.y0 > h.y),
l AS (SELECT a.doc_id, a.seq, string_agg(b.text, ' ' ORDER BY b.y0, b.seq) AS t FROM i a JOIN i b ON a.doc_id = b.doc_id AND abs(a.y0 - b.y0) < 2 GROUP BY a.doc_id, a.seq)
SELECT doc_id, CASE WHEN contains(lower(t), 'n-o') THEN 'keep' ELSE 'redact' END AS decision, count(*) AS spans FROM l GROUP BY 1, 2""",
    "k04_section_decisions": f"""WITH s AS ({LINES}), h AS (SELECT doc_id, first(y1 ORDER BY seq) AS y FROM s WHERE contains(text, 'R-F') GROUP BY doc_id),
i AS (SELECT s.* FROM s JOIN h ON s.doc_id = h.doc_id AND s.y0 > h.y),
l AS (SELECT a.doc_id, a.seq, string_agg(b.text, ' ' ORDER BY b.y0, b.seq) AS t FROM i a JOIN i b ON a.doc_id = b.doc_id AND abs(a.y0 - b.y0) < 2 GROUP BY a.doc_id, a.seq)
SELECT CASE WHEN contains(lower(t), 'a-f') THEN 'redact' ELSE 'keep' END AS decision, count(*) AS spans FROM l GROUP BY 1""",
    "j05_label_value_semi": f"WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, {BUCKET.format('l_quantity')} AS b, l_partkey % 2 AS s FROM lineitem) SELECT l_orderkey, l_linenumber FROM v WHERE f <> 'R' AND EXISTS (SELECT 1 FROM v AS r WHERE r.f = 'R' AND r.l_orderkey = v.l_orderkey AND r.b = v.b AND r.s = v.s)",
    "j06_clamp_rects": f"""WITH RECURSIVE lines AS (SELECT *, {SEQ} AS seq FROM lineitem), bars AS (SELECT l_orderkey, seq AS bar, l_quantity AS y0, l_quantity + 6 AS y1 FROM lines WHERE l_returnflag = 'N'),
kept AS (SELECT l_orderkey, l_quantity AS a, l_quantity + 5 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) AS k FROM lines WHERE l_returnflag = 'R'),
fold AS (SELECT l_orderkey, bar, y0, y1, 0 AS k FROM bars
  UNION ALL SELECT f.l_orderkey, f.bar, CASE WHEN a < y1 AND b > y0 AND a < y0 AND b < y1 THEN greatest(y0, b + 0.5) ELSE y0 END, CASE WHEN a < y1 AND b > y0 AND a > y0 AND b > y1 THEN least(y1, a - 0.5) ELSE y1 END, f.k + 1 FROM fold f JOIN kept USING (l_orderkey) WHERE kept.k = f.k + 1),
done AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, bar ORDER BY k DESC) AS r FROM fold)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, bar, CAST(round(y0 * 2) AS INTEGER) AS y0, CAST(round(y1 * 2) AS INTEGER) AS y1 FROM done WHERE r = 1 AND y1 > y0""",
    "j07_limit_boxes": f"WITH s AS ({LINES}) SELECT doc_id, seq FROM s WHERE EXISTS (SELECT 1 FROM s AS l WHERE l.doc_id = s.doc_id AND l.seq <> s.seq AND starts_with(l.text, 'A') AND s.y0 < l.y1 AND s.y1 > l.y0)",
    "j08_unmark_decimals": f"WITH s AS (SELECT *, CAST(trunc(y0) AS INTEGER) AS y FROM ({LINES})), d AS (SELECT doc_id, y, max(seq) AS seq FROM s WHERE NOT contains(text, 'R-') GROUP BY 1, 2) SELECT doc_id, y, seq FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND contains(s.text, 'R-') AND abs(s.y - d.y) <= 1)",
    "w09_wrapped_merchant": f"{CARD} SELECT doc_id, page_no, col, date, merchant FROM card",
    "k02_card_totals": f"{CARD} SELECT doc_id, CAST(coalesce(sum(amount) FILTER (WHERE is_credit OR {_has('urgent', text='merchant')}), 0) AS DECIMAL(18,2)) AS total, count(*) FILTER (WHERE is_credit OR {_has('urgent', text='merchant')}) AS kept_count FROM card GROUP BY doc_id",
    "a09_row_bars": f"{CARD} SELECT doc_id, page_no, count(*) AS bars, CAST(sum(14 + CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE 0 END) AS BIGINT) AS points FROM card GROUP BY 1, 2",
    "k06_card_summary": f"""WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(l_orderkey % 3 AS INTEGER) AS page_no, {_by_key(SUMMARY_KEY, *map(_q, SUMMARY_TEXTS))} AS t, {BUCKET.format('l_quantity * 8')} AS b, l_partkey % 2 AS side, l_quantity * 8 AS y FROM lineitem),
l AS (SELECT DISTINCT doc_id, page_no, b, side FROM s WHERE {' OR '.join(f"contains(lower(t), {_q(x.lower())})" for x in C.SUMMARY_LABELS)}),
r AS (SELECT s.doc_id, s.page_no, CASE WHEN {CARD_NO.format('t')} THEN 'card_number' WHEN {VALUE.format('t')} AND l.b IS NOT NULL THEN 'labelled_value' WHEN {VALUE.format('t')} AND s.page_no = 1 AND y < 182 AND s.side = 0 AND starts_with(t, '£') THEN 'summary_value' WHEN contains(t, 'Interest and charges') OR contains(t, 'Monthly Membership Fee') THEN 'row_bar' END AS reason
  FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND s.page_no = l.page_no AND s.b = l.b AND s.side = l.side)
SELECT doc_id, page_no, reason, count(*) AS spans FROM r WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
    "k07_financial_details": "SELECT l_orderkey AS doc_id, l_linenumber AS seq FROM lineitem WHERE l_partkey % 4 = 0 OR (l_partkey % 4 = 1 AND l_quantity * 16 <= 842.0 * 0.4)",
    "p21_summary_labels": f"WITH s AS (SELECT {_by_key(SUMMARY_KEY, *map(_q, SUMMARY_TEXTS))} AS t FROM lineitem) SELECT {VALUE.format('t')} AS is_value, {CARD_NO.format('t')} AS is_card_number, count(*) AS n FROM s GROUP BY 1, 2",
    "i01_uk_recognizers": "SELECT c_custkey AS doc_id, CASE c_custkey % 10 " + " ".join(f"WHEN {k} THEN '{TYPES[k][0]}'" for k in (0, 1, 2, 3, 9)) + " END AS entity_type, CAST(length('Mr ' || c_mktsegment || ' has ') + CASE c_custkey % 10 " + " ".join(f"WHEN {k} THEN {_start(k)}" for k in (0, 1, 2, 3, 9)) + " END AS INTEGER) AS start, CASE c_custkey % 10 " + " ".join(f"WHEN {k} THEN {TYPES[k][1]}" for k in (0, 1, 2, 3, 9)) + " END AS score FROM customer WHERE c_custkey % 10 IN (0, 1, 2, 3, 9)",
    "i02_card_luhn": "WITH d AS (SELECT o_orderkey, string_split('424242424242' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'), '') AS ds FROM orders), s AS (SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda k: CASE WHEN k % 2 = 0 THEN CAST(ds[k] AS INTEGER) WHEN CAST(ds[k] AS INTEGER) * 2 > 9 THEN CAST(ds[k] AS INTEGER) * 2 - 9 ELSE CAST(ds[k] AS INTEGER) * 2 END)) AS t FROM d) SELECT o_orderkey, t % 10 = 0 AS valid FROM s",
    "i02_iban_mod97": "SELECT o_orderkey, CAST('23321120' || '60161331926819' || '1611' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS valid FROM orders",
    "i04_match_offsets": "WITH d AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+\\.[0-9]+') AS m, regexp_split_to_array(text, '[0-9]+\\.[0-9]+') AS q FROM documents), k AS (SELECT doc_id, m, q, unnest(range(1, len(m) + 1)) AS i FROM d) SELECT doc_id, CAST(list_sum(list_transform(q[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start, m[i] AS value FROM k",
    "i05_region_filter": _found() + "SELECT doc_id, entity_type, y0 FROM found",
    "i06_landlord_preserved": _found(("PERSON", "UK_ACCOUNT_NUMBER", "UK_SORT_CODE", "IBAN_CODE")) + "SELECT entity_type, count(*) AS n FROM found GROUP BY 1",
    "a10_pii_counts": _found() + "SELECT entity_type, CASE WHEN entity_type IS NULL THEN NULL ELSE page_no END AS page_no, count(*) AS n FROM (SELECT *, 0 AS page_no FROM found) GROUP BY ROLLUP (entity_type, page_no)",
    "j04_pii_shield": f"WITH h AS (SELECT l_orderkey AS doc_id, {SEQ} AS seq, l_discount, l_returnflag AS f, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity + 6 AS INTEGER) AS e FROM lineitem) SELECT doc_id, seq FROM h WHERE f <> 'R' AND l_discount * 8 >= 0.4 AND NOT EXISTS (SELECT 1 FROM h AS g WHERE g.doc_id = h.doc_id AND g.f = 'R' AND g.l_discount * 8 >= 0.4 AND h.s < g.e AND g.s < h.e)",
    "j02_offset_to_span": f"""WITH s AS ({LINES}), o AS (SELECT doc_id, seq, y0, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st, length(text) AS n FROM s),
h AS (SELECT l_orderkey AS doc_id, {SEQ} AS seq, CAST(l_quantity AS INTEGER) AS pos FROM lineitem),
j AS (SELECT h.doc_id, h.seq, y0, row_number() OVER (PARTITION BY h.doc_id, h.seq ORDER BY CASE WHEN st <= pos AND pos < st + n THEN -1 WHEN st <= pos AND pos <= st + n THEN 0 ELSE least(abs(pos - st), abs(pos - st - n)) END, st) AS r FROM h JOIN o ON h.doc_id = o.doc_id)
SELECT doc_id, seq, CAST(round(y0 * 2) AS INTEGER) AS span_y FROM j WHERE r = 1""",
    "s09_first_candidates": "SELECT user_id AS doc_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3",
    "s09_tail20": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20",
    "s10_debug_listing": f"WITH s AS ({LINES}) SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(y0, 1), seq) AS INTEGER) AS place FROM s",
    "a11_page_fingerprint": f"{TX}, w AS (SELECT doc_id, page_no, wrap, length(strftime(o_orderdate, '%-d %b %Y')) + length(description) + length(format('{{:,.2f}}', amount)) + length(format('{{:,.2f}}', balance)) + coalesce(length(wrap), 0) AS chars FROM tx JOIN orders USING (o_orderkey)) SELECT doc_id, page_no, CAST(sum(chars) + {sum(map(len, ['Date', 'Description', 'Paid out', 'Paid in', 'Balance', 'Sort Code 12-34-56', 'Jane Smith']))} AS BIGINT) AS chars, CAST(sum({CELLS_OF_ROW}) + 7 AS BIGINT) AS spans, CAST(2 * count(*) AS BIGINT) AS amounts FROM w GROUP BY 1, 2",
    "a17_usage_stats": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "a16_untouched_pages": f"{TX}, p AS (SELECT DISTINCT doc_id, page_no FROM tx) SELECT doc_id, count(*) FILTER (WHERE page_no % 3 = 1) AS untouched FROM p GROUP BY 1",
    "snk2_output_name": "SELECT o_orderkey, 'redacted_' || o_orderkey || '_£' || format('{:.2f}', CAST(o_totalprice AS DECIMAL(18,2))) || '.pdf' AS name FROM orders",
    "a12_page_words": f"WITH s AS ({LINES}) SELECT doc_id, count(DISTINCT text) AS words FROM s GROUP BY 1",
    "a14_person_accuracy": "WITH c AS (SELECT (doc_id * 53 % 100) / 100.0 AS p, toxic = 1 AS e FROM labels) SELECT count(*) FILTER (WHERE (p >= 0.6) = e) AS \"right\", count(*) FILTER (WHERE p < 0.6) AS unsure, count(*) AS cases FROM c",
    "a15_cases_by_key": "SELECT quality, toxic, count(*) AS cases, min(doc_id) AS first_doc FROM labels GROUP BY 1, 2",
    "s07_section_ends": f"{CARD} SELECT DISTINCT doc_id, page_no, unnest([0, 1]) AS col, 792 AS end_y FROM card",
    "src6_text_in_box": f"WITH s AS ({LINES}) SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS text FROM s WHERE y0 < 11 AND y1 > 4 GROUP BY doc_id",
    "src9_json_spans": f"WITH s AS ({LINES}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, text, CAST(round(y0 * 2) AS INTEGER) AS y, CAST(round(y1 * 2) AS INTEGER) AS y_end FROM s",
    "src10_form_keywords": "SELECT n_nationkey, string_agg(w, '|' ORDER BY k) AS keywords FROM (SELECT n_nationkey, unnest([trim(n_name), 'rent']) AS w, unnest([1, 2]) AS k FROM nation) GROUP BY 1",
    "t01_funnel": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value FROM events GROUP BY 1, 2",
}

_K = "o_orderkey"
_DIRECTION = _by_key(_K, "'keep'", "'redact'", "'both'", "NULL")
_KEYWORDS = _by_key(f"{_K} // 4", "'rent, food'", "' , '", "NULL")
_TOLD = _by_key(f"{_K} // 16", "NULL", "'no coffee'", "'  '")
_NAME = _by_key(f"{_K} // 8", "'a.pdf'", "'b.pdf'", "'c.pdf'", "''", "NULL")
SQL |= {
    "j09_destroyed_text": f"WITH s AS ({LINES}) SELECT doc_id, seq, CASE WHEN EXISTS (SELECT 1 FROM s AS b WHERE b.doc_id = s.doc_id AND b.text LIKE 'A%' AND b.y0 < s.y1 AND b.y1 > s.y0) THEN substr(text, 1, 1) || substr(text, 5) ELSE text END AS \"left\" FROM s",
    "i07_enforced": _found() + "SELECT c_custkey AS doc_id, 2 - count(DISTINCT f.y0) AS \"left\" FROM customer LEFT JOIN found f ON f.doc_id = c_custkey GROUP BY 1",
    "k10_request_error": f"""SELECT o_orderkey, CASE WHEN ({_NAME}) IS NULL THEN 'no file' WHEN coalesce({_DIRECTION}, 'keep') = 'both' THEN 'invalid direction'
WHEN trim(coalesce({_TOLD}, '')) <> '' AND {_K} % 7 = 0 THEN 'instructions are off' WHEN ({_NAME}) = '' THEN 'empty filename'
WHEN {_K} % 5 <> 0 AND coalesce({_KEYWORDS}, ' , ') = ' , ' AND trim(coalesce({_TOLD}, '')) = '' THEN 'no keywords' END AS error FROM orders""",
    "snk3_total_annotations": """WITH e AS (SELECT o_custkey AS doc_id, o_orderkey % 3 AS p, min(o_orderkey % 700) FILTER (WHERE o_orderkey % 5 <> 0) AS y FROM orders GROUP BY 1, 2),
l AS (SELECT doc_id, max(p) AS p, arg_max_null(y, p) AS y FROM e GROUP BY doc_id)
SELECT doc_id, 1 AS page_no, CAST(coalesce(y + 15, 545) AS INTEGER) AS y, (SELECT format('{:.2f}', CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)) FROM orders WHERE o_custkey = l.doc_id) AS text FROM l WHERE p > 0""",
    "snk5_log_lines": "SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || ',' || o_orderstatus AS line, count(*) AS n FROM orders GROUP BY 1",
    "src7_log_values": "SELECT 'a,' || o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1",
    "snk9_response": "SELECT o_orderkey, '{\"order\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS body FROM orders",
    "t02_running_count": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "p22_second_zone": "SELECT l_orderkey AS doc_id, l_linenumber AS seq FROM lineitem WHERE l_partkey % 4 = 2 OR (l_partkey % 4 = 1 AND l_quantity * 16 <= 842.0 * 0.3)",
    "p23_legacy_patterns": f"SELECT {_K} % 4 = 0 AS currency, {_K} % 4 = 1 AS day, {_K} % 4 IN (0, 2) AS decimal, count(*) AS n FROM orders GROUP BY 1, 2, 3",
    "a19_legacy_total": f"SELECT o_custkey AS doc_id, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE {_K} % 3 = 0), 0) AS DECIMAL(18,2)) AS total FROM orders GROUP BY 1",
    "a20_debug_transactions": f"{TX} SELECT doc_id, page_no, i + 1 AS group_id, full_text AS description, amount, count(*) OVER (PARTITION BY doc_id) AS \"of\" FROM tx",
    "s01_reading_order": f"WITH s AS ({LINES}) SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y0, seq) AS INTEGER) AS place FROM s",
    "j03_semantic_keywords": _totals("length(full_text) % 10 >= 8"),
    "j08_judged_header": _totals(_has("urgent")),
    "j09_stamped_lines": W_FOLD.format(">= 2") + "SELECT doc_id, row_id AS line_no, count(*) AS spans, count(*) % 2 = 0 AS verdict FROM fold GROUP BY 1, 2",
    "u04_kept_people": f"SELECT l_orderkey AS doc_id, seq, CASE l_partkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PHONE_NUMBER' ELSE 'IBAN_CODE' END AS entity_type FROM (SELECT *, {SEQ} AS seq FROM lineitem) WHERE l_quantity <= 25 OR l_partkey % 3 = 2 OR (l_partkey % 3 = 0 AND l_suppkey % 2 = 0 AND l_discount * 10 >= 0.6)",
    "j13_label_lookup": "SELECT lang, quality AS expected, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2",
    "p35_feature_flags": f"SELECT o_orderkey, coalesce({_K} % 2 = 0 AND ({_by_key(f'{_K} // 2', chr(39) + 'on' + chr(39), chr(39) + 'off' + chr(39), 'NULL')}) = 'on' AND ({_by_key(f'{_K} // 8', chr(39) + 'key' + chr(39), chr(39) + ' ' + chr(39))}) = 'key', FALSE) AS enabled FROM orders",
}

_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
_COUNTS = "(SELECT string_agg(entity_type || ' ' || n, ', ' ORDER BY entity_type) FROM (SELECT entity_type, count(*) AS n FROM found WHERE found.doc_id = c_custkey GROUP BY 1))"
SQL |= {
    "src1_file_spans": "SELECT 'region.parquet' AS file, CAST(k - 1 AS INTEGER) AS seq, r_name AS text, CAST(10 * (k - 1) AS INTEGER) AS y FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region)",
    "src8_files": "SELECT * FROM (VALUES " + ", ".join(f"('{t}.parquet', {k})" for k, t in enumerate(_TABLES, 1)) + ") t(name, place)",
    "s03_bucket_order": f"SELECT l_orderkey AS doc_id, seq, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {BUCKET.format('l_quantity')}, l_partkey % 4, seq) AS INTEGER) AS place FROM (SELECT *, {SEQ} AS seq FROM lineitem)",
    "s08_last_dates": f"SELECT l_orderkey AS doc_id, CAST(l_suppkey % 3 AS INTEGER) AS col, CAST(arg_max(l_quantity, seq) + 28 AS INTEGER) AS end_y FROM (SELECT *, {SEQ} AS seq FROM lineitem) WHERE l_partkey % 3 <> 1 AND l_suppkey % 3 < 2 GROUP BY 1, 2",
    "snk4_usage_count": f"SELECT count(*) AS n FROM orders WHERE {_K} % 3 = 0",
    "i08_page_report": _found() + f"SELECT c_custkey AS doc_id, 0 AS page_no, 'page 1: ' || coalesce({_COUNTS}, 'no findings') AS line FROM customer UNION ALL SELECT c_custkey, NULL, 'total across 1 page(s): ' || coalesce({_COUNTS}, 'no findings') FROM customer",
    "j05_people": f"WITH f AS (SELECT l_orderkey, seq, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey % 16, l_orderkey // 32 ORDER BY l_orderkey, seq) AS place FROM (SELECT *, {SEQ} AS seq FROM lineitem)) SELECT l_orderkey % 16 AS doc_id, CAST(l_orderkey // 32 AS INTEGER) AS page_no, l_orderkey AS \"order\", seq FROM f WHERE place <= 20 AND l_returnflag = 'A' AND l_linestatus = 'F'",
}
