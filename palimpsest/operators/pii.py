"""Personal data on statement pages: recognisers, context, regions, and the shield of preserved types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.predicates import padded
from palimpsest.operators.layout import PAGE, offset_map, page_text


@dataclass(frozen=True)
class Recogniser:
    entity: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    check: str | None = None


# Entity types, patterns, base scores and context words.
EDGE, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
RECOGNISERS = (
    Recogniser("UK_SORT_CODE", EDGE + "[0-9]{2}-[0-9]{2}-[0-9]{2}" + END, 0.5, ("sort", "code", "sort code")),
    Recogniser("UK_SORT_CODE", EDGE + "[0-9]{6}" + END, 0.1, ("sort", "sort code")),
    Recogniser("UK_ACCOUNT_NUMBER", EDGE + "[0-9]{8}" + END, 0.3, ("account", "acc", "a/c")),
    Recogniser("UK_NINO", EDGE + "[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]" + END, 0.5, ("national insurance", "nino", "ni number")),
    Recogniser("IBAN_CODE", EDGE + "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + END, 0.5, ("iban",), "mod97"),
    Recogniser("CREDIT_CARD", EDGE + "[0-9](?:[ -]?[0-9]){12,18}" + END, 0.3, ("card", "credit", "debit"), "luhn"),
    Recogniser("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.5, ("email",), "always"),
    Recogniser("PHONE_NUMBER", EDGE + r"(?:\+[0-9]{1,3}[ -]?)?(?:\(?0?[0-9]{3,5}\)?[ -][0-9]{3}[ -]?[0-9]{3,4})" + END, 0.4, ("phone", "tel", "call", "mobile")),
)
STRUCTURED = ("UK_SORT_CODE", "UK_ACCOUNT_NUMBER", "UK_NINO", "IBAN_CODE", "CREDIT_CARD", "EMAIL_ADDRESS")
LANDLORD_PRESERVED = ("PERSON", "UK_ACCOUNT_NUMBER", "UK_SORT_CODE", "IBAN_CODE")
BOOST, BOOST_FLOOR, CONTEXT_WORDS = 0.35, 0.4, 5


def luhn_ok(text: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", ""))


def iban_ok(text: Column) -> Column:
    """Mod-97 of the rearranged number is 1."""
    bare = F.upper(F.regexp_replace(text, " ", ""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    step = lambda a, c: F.when(F.rlike(c, F.lit("[0-9]")), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def match_offsets(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches: offsets follow from the parts between matches."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a.at + F.length(x.p)
        end = start + F.length(x.m)
        return F.struct(end.alias("at"), F.array_append(a.out, F.struct(start.alias("start"), end.alias("end"), x.m.alias("value"))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda a: a.out)


def recognise(texts: DataFrame, text: str = "page_text", recognisers: tuple[Recogniser, ...] = RECOGNISERS) -> DataFrame:
    """texts' other columns with (entity_type, start, end, score): one row a match that passes its check.

    A context word among the five words before raises the score by 0.35, to 0.4 at least; a passed checksum makes it 1.
    """
    found = []
    for r in recognisers:
        ok = {"luhn": luhn_ok, "mod97": iban_ok}.get(r.check)
        m = match_offsets(F.col(text), r.pattern)
        found.append(F.transform(_checked(m, ok) if ok else m, _labelled(r)))
    rows = texts.withColumn("_m", F.explode(F.concat(*found)))
    before = F.slice(F.reverse(F.split(F.trim(F.lower(F.substring(F.col(text), F.lit(1), F.col("_m.start")))), r"\s+")), 1, CONTEXT_WORDS)
    near = F.concat(F.lit(" "), F.array_join(F.reverse(before), " "), F.lit(" "))
    boosted = F.exists("_m.context", lambda c: F.contains(near, c))
    score = F.when(F.col("_m.sure"), 1.0).when(boosted, F.least(F.lit(1.0), F.greatest(F.col("_m.score") + BOOST, F.lit(BOOST_FLOOR)))).otherwise(F.col("_m.score"))
    others = [c for c in texts.columns if c != text]
    return rows.select(*others, F.col("_m.entity").alias("entity_type"), F.col("_m.start").alias("start"), F.col("_m.end").alias("end"), F.round(score, 2).alias("score"))


def _checked(matches: Column, ok) -> Column:
    return F.filter(matches, lambda x: ok(x.value))


def _labelled(r: Recogniser):
    context = F.array(*[F.lit(c) for c in r.context]).cast("array<string>")
    return lambda x: F.struct(F.lit(r.entity).alias("entity"), x.start.alias("start"), x.end.alias("end"), F.lit(r.score).alias("score"), context.alias("context"), F.lit(r.check is not None).alias("sure"))


def shielded(hits: DataFrame, exclude: tuple[str, ...], min_score: float = 0.4) -> DataFrame:
    """hits of at least min_score and of other types, but for those that overlap a hit of an excluded type."""
    good = hits.where(F.col("score") >= min_score)
    guard = good.where(F.col("entity_type").isin(*exclude)).select(*PAGE, F.col("start").alias("s"), F.col("end").alias("e"))
    rest = good.where(~F.col("entity_type").isin(*exclude))
    on = [rest[c] == guard[c] for c in PAGE] + [(rest["start"] < guard["e"]) & (guard["s"] < rest["end"])]
    return rest.join(guard, on, "left_anti")


def locate(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """hits with the box of the span that holds their start; between spans, the nearest, the first of equals."""
    mapped = offset_map(spans).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("start", "end", "x0", "y0", "x1", "y1"))).alias("_spans"))
    far = lambda s: F.when((s.start <= F.col("start")) & (F.col("start") <= s.end), 0).otherwise(F.least(F.abs(F.col("start") - s.start), F.abs(F.col("start") - s.end)))
    inside = F.filter("_spans", lambda s: (s.start <= F.col("start")) & (F.col("start") < s.end))
    nearest = F.array_min(F.transform("_spans", lambda s: F.struct(far(s).alias("d"), s.start.alias("o"), s.alias("s"))))["s"]
    box = F.coalesce(F.get(inside, F.lit(0)), nearest)
    return hits.join(mapped, PAGE).withColumn("_b", box).select(*hits.columns, "_b.x0", "_b.y0", "_b.x1", "_b.y1")


def page_findings(spans: DataFrame, regions: DataFrame, min_score: float = 0.4, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(page, entity_type, score, x0, y0, x1, y1), never the text.

    regions has (page, header_y, structured_only). Below a header only structured types count, and on pages that are
    structured_only nothing else does.
    """
    hits = recognise(page_text(spans))
    left = shielded(hits, exclude, min_score) if exclude else hits.where(F.col("score") >= min_score)
    placed = locate(left, spans).join(regions.select(*PAGE, "header_y", "structured_only"), PAGE)
    below = F.coalesce(F.col("y0") > F.col("header_y"), F.lit(False))
    ok = F.col("entity_type").isin(*STRUCTURED) | ~(below | F.col("structured_only"))
    return placed.where(ok).select(*PAGE, "entity_type", "score", "x0", "y0", "x1", "y1")


def enforced(findings: DataFrame) -> DataFrame:
    """(page, x0, y0, x1, y1, reason): the padded boxes that an enforcing run redacts; a reporting run only counts."""
    box = padded(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return findings.withColumn("_b", box).select(*PAGE, "_b.x0", "_b.y0", "_b.x1", "_b.y1", F.concat(F.lit("pii:"), "entity_type").alias("reason"))


def count_by_type(findings: DataFrame) -> DataFrame:
    """Counts per page and type, per type (page_no null), and in all (both null) by one rollup."""
    return findings.rollup("entity_type", "page_no").agg(F.count(F.lit(1)).alias("n"))


def report(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line): a page's counts by type, and a document's (page_no null); never any matched text."""
    counts = findings.groupBy(*PAGE, "entity_type").agg(F.count(F.lit(1)).alias("n"))
    typed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(" ", x.entity_type, x.n)), ", ")
    said = lambda c: F.when(F.size(c) > 0, typed(c)).otherwise("no findings")
    per_page = counts.groupBy(*PAGE).agg(F.collect_list(F.struct("entity_type", "n")).alias("c"))
    lines = pages.select(*PAGE).distinct().join(per_page, PAGE, "left").withColumn("c", F.coalesce("c", F.array().cast(per_page.schema["c"].dataType)))
    total = counts.groupBy("doc_id", "entity_type").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.collect_list(F.struct("entity_type", "n")).alias("c"))
    whole = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages")).join(total, "doc_id", "left").withColumn("c", F.coalesce("c", F.array().cast(total.schema["c"].dataType)))
    page_line = F.concat(F.lit("page "), F.col("page_no") + 1, F.lit(": "), said(F.col("c")))
    total_line = F.concat(F.lit("total across "), F.col("pages"), F.lit(" page(s): "), said(F.col("c")))
    return lines.select(*PAGE, page_line.alias("line")).unionByName(whole.select("doc_id", F.lit(None).cast("int").alias("page_no"), total_line.alias("line")))


def first_candidates(findings: DataFrame, limit: int = 20) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "entity_type")
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
