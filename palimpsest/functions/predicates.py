"""Scalar rules on span texts as Columns: dates, amounts, header labels, keywords, providers, bands, triage."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Patterns and word lists that results depend on.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_CELL = r"^(?:[0-9]{1,2}\s+[A-Za-z]{3}(?:\s+(?:[0-9]{4}|[0-9]{2}))?|[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2}))$"
AMOUNT_CELL = r"(?i)^-?£?\s?[0-9,]+\.[0-9]{2}\s*(?:CR)?$"
CARRY_ROW = r"(?i)balance\s+(?:brought|carried)\s+forward"
CARD_DATE = rf"^[0-9]{{1,2}}\s+(?:{MONTHS})$"
CARD_DATE_PREFIX = rf"^([0-9]{{1,2}}\s+(?:{MONTHS}))\s+(.+)$"
CARD_AMOUNT = r"^£[0-9]{1,3}(,[0-9]{3})*\.[0-9]{2}(CR)?$"
CURRENCY = (r"£[0-9,]+\.[0-9]{2}", r"[0-9,]+\.[0-9]{2}")
EXACT_LABELS = {"payment type and details": "description"}
ROLE_LABELS = {
    "balance": ["balance"],
    "paid_out": ["paid out", "money out", "withdrawal", "debit", "payment out", "payments out", "outgoing"],
    "paid_in": ["paid in", "money in", "receipt", "deposit", "credit", "incoming"],
    "date": ["date"],
    "description": ["description", "details", "narrative", "transaction", "payee", "memo"],
    "amount": ["amount"],
}
LABEL_CHARS, LABEL_WORDS = 25, 3
PROVIDER_MARKERS = {
    "amex_uk": ["american express", "amex"],
    "barclaycard": ["barclaycard", "barclays"],
    "revolut": ["revolut"],
    "hsbc": ["hsbc"],
}
PROVIDER_WORDS = {"wise": ["wise payments", "transferwise", "wise.com"], "generic_bank_uk": ["sort code", "paid in", "paid out", "money in", "money out"]}
BANDS = ((10, "0-10"), (50, "11-50"), (250, "51-250"), (1000, "251-1000"))
ERRORS = (("no_transactions", ("no transactions", "nothing to redact")), ("parse_failed", ("parse", "format")), ("no_file", ("no file", "empty filename")), ("landlord_on_card", ("landlord mode",)))

PROVIDERS = [("amex_uk", "American Express", "card"), ("barclaycard", "Barclaycard", "card"), ("revolut", "Revolut", "bank"), ("hsbc", "HSBC", "bank"), ("wise", "Wise", "bank"), ("generic_bank_uk", "Other UK bank", "bank"), ("auto", "Detect automatically", "auto")]
ENGINES = {"bank": ("generic_bank_uk", "hsbc", "revolut", "wise"), "card": ("barclaycard",), "card_privacy": ("amex_uk",)}


def _bounded(words: list[str]) -> str:
    """Any of the words between characters that are no ASCII letter, digit or underscore."""
    return "(?:^|[^0-9A-Za-z_])(?:" + "|".join(re.escape(w).replace("\\ ", " ") for w in words) + ")(?:$|[^0-9A-Za-z_])"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def is_date(text: Column) -> Column:
    return F.rlike(F.trim(text), F.lit(DATE_CELL))


def is_amount(text: Column) -> Column:
    return F.rlike(F.trim(text), F.lit(AMOUNT_CELL))


def parse_amount(text: Column) -> Column:
    """The absolute amount; 0 for what does not parse."""
    digits = F.regexp_replace(F.upper(F.trim(text)), r"£|,|CR|\s", "")
    return F.coalesce(F.abs(digits.try_cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)"))


def is_carry_row(text: Column) -> Column:
    return F.rlike(text, F.lit(CARRY_ROW))


def header_role(text: Column) -> Column:
    """The role a header label names, else null. Long exact labels first, then short labels in the roles' order."""
    t = squeezed(text)
    bare = F.regexp_replace(t, "[^a-z0-9]", "")
    bare_of = lambda s: re.sub("[^a-z0-9]", "", s)
    out = F.when(t == "", None)
    for label, role in EXACT_LABELS.items():
        out = out.when(bare == bare_of(label), role)
    out = out.when((F.length(t) > LABEL_CHARS) | (F.size(F.split(t, " ")) > LABEL_WORDS), None)
    for role, labels in ROLE_LABELS.items():
        out = out.when(F.rlike(t, F.lit(_bounded(labels))) | bare.isin([label.replace(" ", "") for label in labels]), role)
    return out.otherwise(None)


def is_credible_header(roles: Column) -> Column:
    """roles: the distinct roles of a line's labels."""
    text_roles, money = F.array(F.lit("date"), F.lit("description")), F.array(*[F.lit(r) for r in ("paid_in", "paid_out", "balance", "amount")])
    return (F.size(roles) >= 3) & F.arrays_overlap(roles, text_roles) & F.arrays_overlap(roles, money)


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Any keyword as a literal substring, whatever the case; false without keywords."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(F.lower(text), F.lit(k.lower()))
    return out


def parse_keywords(form: str) -> list[str]:
    return [k.strip() for k in form.split(",") if k.strip()]


def extract_currency(text: Column) -> Column:
    """The first amount in a text: with a pound sign if there is one, else a plain decimal; null without."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in CURRENCY])
    return F.regexp_replace(found, "[£$€¥₹,]", "").try_cast("decimal(18,2)")


def split_card_date(text: Column) -> Column:
    """struct(date, merchant): both parts of a merged span, only date for a bare one, nulls otherwise."""
    t = F.trim(text)
    part = lambda k: F.nullif(F.regexp_extract(t, CARD_DATE_PREFIX, k), F.lit(""))
    return F.struct(F.when(F.rlike(t, F.lit(CARD_DATE)), t).otherwise(part(1)).alias("date"), part(2).alias("merchant"))


def parse_card_amount(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(CARD_AMOUNT)), F.regexp_replace(text, "£|,|CR", "").try_cast("decimal(18,2)"))


def is_card_credit(text: Column) -> Column:
    return F.endswith(F.upper(F.trim(text)), F.lit("CR"))


def detect_provider(text: Column) -> Column:
    """The statement's provider, or null. Card brands come before banks; `wise` only as a whole marker."""
    t = F.lower(text)
    out = F.when(text.isNull(), None)
    for slug, marks in PROVIDER_MARKERS.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(t, F.lit(m))
        out = out.when(hit, slug)
    for slug, words in PROVIDER_WORDS.items():
        out = out.when(F.rlike(t, F.lit(_bounded(words))), slug)
    return out.when(F.contains(t, F.lit("mastercard avios")), "barclaycard").otherwise(None)


def known_provider(name: Column) -> Column:
    """A provider of PROVIDERS; any other name, or none, is taken as amex_uk."""
    return F.when(name.isin([p[0] for p in PROVIDERS]), name).otherwise("amex_uk")


def engine_of(provider: Column) -> Column:
    """The engine that reads a provider's statements: bank, card, card_privacy, or generic_card for all others."""
    out = None
    for engine, names in ENGINES.items():
        out = (F if out is None else out).when(provider.isin(*names), engine)
    return out.otherwise("generic_card")


def whole_y(y: Column) -> Column:
    """y without its fraction, as the decimals pass compares lines."""
    return y.cast("int")


def total_band(pounds: Column) -> Column:
    out = F.when(pounds.isNull() | F.isnan(pounds.cast("double")) | (pounds < 0), "unknown")
    for top, name in BANDS:
        out = out.when(pounds <= top, name)
    return out.otherwise("1000+")


def error_category(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    out = None
    for name, marks in ERRORS:
        hit = F.lit(False)
        for x in marks:
            hit = hit | F.contains(m, F.lit(x))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("server_error")


def sanitise_name(text: Column) -> Column:
    """Letters, digits and spaces, at most 60, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.substring(F.regexp_replace(text, "[^A-Za-z0-9 ]", ""), 1, 60)), F.lit(""))


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def triage_sample(text: Column) -> Column:
    """What becomes of an uploaded sample, from the text of all its pages; null text: no file."""
    return (
        F.when(text.isNull(), "no_file")
        .when(detect_provider(text).isin("amex_uk", "barclaycard"), "already_supported")
        .when(F.length(F.trim(text)) < 300, "unreadable")
        .otherwise("statement")
    )


def y_bucket(y: Column) -> Column:
    """Four-point buckets, half to even."""
    return (F.bround(y / 4) * 4).cast("int")


def padded(x0: Column, y0: Column, x1: Column, y1: Column, pad: float = 1.0) -> Column:
    """A redaction box: wider by pad on either side, a quarter of the height less above and below."""
    inset = (y1 - y0) * 0.25
    return F.struct((x0 - pad).alias("x0"), (y0 + inset).alias("y0"), (x1 + pad).alias("x1"), (y1 - inset).alias("y1"))
