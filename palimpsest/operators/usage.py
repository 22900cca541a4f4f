"""Usage logs and events: counts, tails, funnels, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.predicates import is_amount
from palimpsest.operators.layout import PAGE

TAIL = 20
# The legacy engine's patterns.
LEGACY_CURRENCY = r"£[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?"
LEGACY_DATE = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+[0-9]{1,2}\b"
LEGACY_DECIMAL = r"(?<![0-9]%)[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)(?!%)"


def legacy_total(spans: DataFrame) -> DataFrame:
    """(doc_id, total): the spans with a decimal that are a number as a whole; what else they hold makes them none."""
    number = F.regexp_replace("text", ",", "").try_cast("decimal(18,2)")
    return spans.where(F.rlike("text", F.lit(LEGACY_DECIMAL))).groupBy("doc_id").agg(F.coalesce(F.sum(number), F.lit(0)).cast("decimal(18,2)").alias("total"))


def tail(log: DataFrame, order: list[str], n: int = TAIL) -> DataFrame:
    """The last n rows, in order: a top-k, not a sort of the log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def usage_count(log: DataFrame, line: str = "value") -> DataFrame:
    """(n): the lines of an append log, blank and missing ones left out; counts over appends cannot lose an increment."""
    return log.agg(F.count_if(F.trim(line) != "").alias("n"))


def usage_stats(events: DataFrame, kind: str = "event_type") -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def page_fingerprints(spans: DataFrame) -> DataFrame:
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    return spans.groupBy(*PAGE).agg(F.sum(F.length(squeezed)).alias("chars"), F.count(F.lit(1)).alias("spans"), F.count_if(is_amount(F.col("text"))).alias("amounts"))


def page_words(spans: DataFrame) -> DataFrame:
    return spans.select(*PAGE, F.explode(F.split(F.trim("text"), r"\s+")).alias("word")).where("word <> ''").distinct()


def new_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """Words of `after` that its page did not have before; none after a redaction."""
    return page_words(after).exceptAll(page_words(before))
