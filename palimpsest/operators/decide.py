"""Keep or redact: one decision per transaction, and the boxes that follow from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.predicates import has_keyword, is_amount, is_carry_row, padded
from palimpsest.operators.layout import PAGE

DIRECTIONS = ("keep", "redact")


@dataclass(frozen=True)
class Params:
    keywords: list[str] = field(default_factory=list)
    direction: str = "keep"
    keep_credits: bool = False
    redact_balances: bool = False

    def __post_init__(self) -> None:
        if self.direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}")


def decision(description: Column, credit: Column, params: Params, keyword_verdict: Column | None = None, instruction_verdict: Column | None = None, carry: Column | None = None) -> Column:
    """keep, redact or skip. Verdicts are true, false or null; only true acts.

    A carry row is skipped. With keywords, those that match are kept (or, in direction redact, those that do not),
    and credits too if asked for; without keywords all are kept, or only credits. An instruction's verdict redacts,
    and a credit that is to be kept overrides it.
    """
    yes = lambda v: F.lit(False) if v is None else F.coalesce(v, F.lit(False))
    named = has_keyword(description, params.keywords) | yes(keyword_verdict)
    is_credit = F.coalesce(credit, F.lit(False)) if params.keep_credits else F.lit(False)
    if params.keywords:
        keep = (named if params.direction == "keep" else ~named) | is_credit
    else:
        keep = F.lit(not params.keep_credits)
    keep = (keep & ~yes(instruction_verdict)) | is_credit
    return F.when(yes(carry), "skip").when(keep, "keep").otherwise("redact")


def decide(transactions: DataFrame, params: Params, verdicts: DataFrame | None = None) -> DataFrame:
    """transactions with decision; verdicts has (page, group_id, kind, verdict) with kind keyword or instruction."""
    t, named, told = transactions, None, None
    if verdicts is not None:
        wide = verdicts.groupBy(*PAGE, "group_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("verdict"))).alias(f"_{k}") for k in ("keyword", "instruction")])
        t = t.join(wide, [*PAGE, "group_id"], "left")
        named, told = F.col("_keyword"), F.col("_instruction")
    carry = F.col("dated") & is_carry_row(F.col("description"))
    return t.withColumn("decision", decision(F.col("description"), F.col("is_credit"), params, named, told, carry)).drop("_keyword", "_instruction")


def redactions(cells: DataFrame, decided: DataFrame, params: Params) -> DataFrame:
    """(page, seq, x0, y0, x1, y1, reason): boxes of redacted groups, and of balances if asked for.

    A decided transaction has its cells with it, so they need not be found again.
    """
    rows = decided.where("decision = 'redact'").select(*PAGE, F.explode("cells").alias("c")).select(*PAGE, "c.*").where(F.col("role").isin("date", "description", "paid_in", "paid_out"))
    out = rows.select(*PAGE, "seq", "x0", "y0", "x1", "y1", F.lit("transaction").alias("reason"))
    if params.redact_balances:
        balances = cells.where(is_amount(F.col("text")) & ((F.col("row_y") <= F.col("header_y")) | (F.col("role") == "balance")))
        out = out.unionByName(balances.select(*PAGE, "seq", "x0", "y0", "x1", "y1", F.lit("balance").alias("reason")))
    box = padded(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return out.withColumn("_b", box).select(*PAGE, "seq", "_b.x0", "_b.y0", "_b.x1", "_b.y1", "reason").dropDuplicates([*PAGE, "seq", "reason"])


def destroyed_text(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """spans with left, the text that boxes (page, x0, y0, x1, y1) leave: a character that meets a box is destroyed.

    The characters of a span are taken as equally wide. Boxes come as one row a page.
    """
    per_page = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_boxes"))
    joined = spans.join(per_page, PAGE, "left")
    near = F.filter("_boxes", lambda b: (b.y0 < F.col("y1")) & (b.y1 > F.col("y0")) & (b.x0 < F.col("x1")) & (b.x1 > F.col("x0")))
    wide = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    kept = F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("c"), (F.col("x0") + wide * i).alias("from"))), lambda c: ~F.exists("_near", lambda b: (b.x0 < c["from"] + wide) & (b.x1 > c["from"])))
    left = F.when(F.size("_near") > 0, F.array_join(F.transform(kept, lambda c: c.c), "")).otherwise(F.col("text"))
    return joined.withColumn("_near", F.coalesce(near, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))).withColumn("left", left).select(*spans.columns, "left")


def request_error(direction: Column, keywords: Column, instruction: Column, landlord: Column, instructions_on: Column, filename: Column) -> Column:
    """Why a request is refused, null if it is not; the first reason counts. A null filename is a missing file."""
    told = F.trim(F.coalesce(instruction, F.lit(""))) != ""
    named = F.size(F.filter(F.split(F.coalesce(keywords, F.lit("")), ","), lambda k: F.trim(k) != "")) > 0
    return (
        F.when(filename.isNull(), "no file")
        .when(~F.coalesce(direction, F.lit("keep")).isin(*DIRECTIONS), "invalid direction")
        .when(told & ~instructions_on, "instructions are off")
        .when(filename == "", "empty filename")
        .when(~landlord & ~named & ~told, "no keywords")
    )


def surviving_spans(spans: DataFrame, redacted: DataFrame) -> DataFrame:
    """Spans without a redaction on them."""
    return spans.join(redacted.select(*PAGE, "seq").distinct(), [*PAGE, "seq"], "left_anti")


def kept_total(decided: DataFrame) -> DataFrame:
    kept = F.col("decision") == "keep"
    return decided.groupBy("doc_id").agg(F.count_if(kept).alias("kept_count"), F.coalesce(F.sum(F.when(kept, F.col("amount"))), F.lit(0).cast("decimal(28,2)")).alias("total"), F.count_if(F.col("decision") == "redact").alias("redacted_count"))
