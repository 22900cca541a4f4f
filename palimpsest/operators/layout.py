"""Spans to rows, header columns and cells, one page at a time but all pages at once.

Every step is partitioned by (doc_id, page_no), so the shuffle by that key serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.predicates import header_role, is_credible_header

PAGE = ["doc_id", "page_no"]


def page_window(*order: str | Column) -> Window:
    return Window.partitionBy(*PAGE).orderBy(*order)


def clean_spans(spans: DataFrame) -> DataFrame:
    """Texts trimmed, empty ones left out."""
    return spans.withColumn("text", F.trim("text")).where("text <> ''")


def row_anchors(ys: Column, tol: float, strict: bool = False) -> Column:
    """Ascending anchors: the first y, then every y further than tol (strict: at least tol) above the last anchor."""
    beyond = (lambda d: d >= tol) if strict else (lambda d: d > tol)
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(ys), empty, lambda a, y: F.when((F.size(a) == 0) | beyond(y - F.element_at(a, -1)), F.array_append(a, y)).otherwise(a))


def cluster_rows(spans: DataFrame, tol: float = 3.0, strict: bool = False) -> DataFrame:
    """spans with row_id (from 0 down the page) and row_y, the row's anchor.

    A page is gathered once, its anchors are found in one fold, and its spans are laid out again: no join, and what
    follows by page needs no further shuffle.
    """
    others = [c for c in spans.columns if c not in PAGE]
    paged = spans.groupBy(*PAGE).agg(F.collect_set("y0").alias("_ys"), F.collect_list(F.struct(*others)).alias("_spans"))
    laid = paged.select(*PAGE, row_anchors(F.col("_ys"), tol, strict).alias("_anchors"), "_spans")
    flat = laid.select(*PAGE, "_anchors", F.explode("_spans").alias("_s")).select(*PAGE, "_anchors", "_s.*")
    at = F.size(F.filter("_anchors", lambda a: a <= F.col("y0")))
    return flat.withColumn("row_id", at - 1).withColumn("row_y", F.element_at("_anchors", at)).select(*spans.columns, "row_id", "row_y")


def merge_phrases(rows: DataFrame, gap: float = 12.0) -> DataFrame:
    """(page, row_id, phrase_id, text, x0, y0, x1, y1): neighbours in a row joined where at most gap apart.

    x1 is the last span's, which need not be the largest.
    """
    w = Window.partitionBy(*PAGE, "row_id").orderBy("x0", "y0", "seq")
    new = F.when(F.col("x0") - F.lag("x1").over(w) <= gap, 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("phrase_id", F.sum("_new").over(w) - 1).withColumn("_n", F.row_number().over(w))
    parts = F.array_sort(F.collect_list(F.struct("_n", "text")))
    return marked.groupBy(*PAGE, "row_id", "phrase_id").agg(
        F.array_join(F.transform(parts, lambda p: p.text), " ").alias("text"),
        F.min_by("x0", "_n").alias("x0"),
        F.min("y0").alias("y0"),
        F.max_by("x1", "_n").alias("x1"),
        F.max("y1").alias("y1"),
    )


def header_labels(phrases: DataFrame) -> DataFrame:
    return phrases.withColumn("role", header_role(F.col("text"))).where("role is not null")


def best_header(labels: DataFrame) -> DataFrame:
    """The labels of each page's header line: the credible line of most labels, the first of equals."""
    line = Window.partitionBy(*PAGE, "row_id")
    found = labels.withColumn("_roles", F.collect_set("role").over(line)).withColumn("_n", F.count(F.lit(1)).over(line))
    found = found.where(is_credible_header(F.col("_roles")))
    best = found.withColumn("_rank", F.dense_rank().over(page_window(F.desc("_n"), "row_id")))
    return best.where("_rank = 1").drop("_roles", "_n", "_rank")


def column_bands(header: DataFrame, pages: DataFrame | None = None, width: float = 595.0) -> DataFrame:
    """One row a page: header_y (the least bottom of its labels) and bands, an array of (role, x0, x1) left to right.

    Bands meet half-way between label centres and cover [0, width). A label `amount` is the balance if it is the last,
    no label says balance, and there is a paid in or paid out; otherwise paid out.
    """
    w = page_window("cx", "phrase_id")
    at = header.withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    if pages is not None:
        at = at.join(pages.select(*PAGE, "width"), PAGE, "left").withColumn("width", F.coalesce("width", F.lit(width)))
    else:
        at = at.withColumn("width", F.lit(width))
    roles = F.collect_set("role").over(Window.partitionBy(*PAGE))
    half = lambda other: (other.over(w) + F.col("cx")) / 2
    at = at.withColumns({"_roles": roles, "_from": F.coalesce(half(F.lag("cx")), F.lit(0.0)), "_next": half(F.lead("cx")), "_last": F.lead("cx").over(w).isNull()})
    to_balance = F.col("_last") & ~F.array_contains("_roles", "balance") & F.arrays_overlap("_roles", F.array(F.lit("paid_in"), F.lit("paid_out")))
    role = F.when(F.col("role") != "amount", F.col("role")).when(to_balance, "balance").otherwise("paid_out")
    band = F.struct(F.col("_from").alias("x0"), F.coalesce("_next", "width").alias("x1"), role.alias("role"))
    return at.groupBy(*PAGE).agg(F.min("y1").alias("header_y"), F.array_sort(F.collect_list(band)).alias("bands"))


def detect_columns(spans: DataFrame, pages: DataFrame | None = None, tol: float = 5.0) -> DataFrame:
    return column_bands(best_header(header_labels(merge_phrases(cluster_rows(spans, tol)))), pages)


def assign_roles(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells: spans of pages that have columns, with the role of the band that holds their centre.

    Centres outside all bands take the nearest edge's. One row a page joins, whatever the number of bands.
    """
    cx = (F.col("x0") + F.col("x1")) / 2
    joined = rows.join(columns, PAGE)
    band = F.coalesce(F.get(F.filter("bands", lambda b: cx < b.x1), F.lit(0)), F.element_at("bands", -1))
    return joined.withColumn("role", band["role"])


def seen_header(pages: DataFrame, columns: DataFrame) -> DataFrame:
    """pages with structured_only: no header here, but one on an earlier page of the document."""
    has = pages.join(columns.select(*PAGE, "header_y"), PAGE, "left").withColumn("_has", F.col("header_y").isNotNull())
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return has.withColumn("structured_only", ~F.col("_has") & F.coalesce(F.max("_has").over(before), F.lit(False))).drop("_has")


def same_line(spans: DataFrame, reach: float = 2.0) -> DataFrame:
    """spans with line_text: the texts of all spans of the page less than reach apart in y, in order of y."""
    frame = f"PARTITION BY {', '.join(PAGE)} ORDER BY y0 RANGE BETWEEN {float(reach)}D PRECEDING AND {float(reach)}D FOLLOWING"
    near = F.expr(f"collect_list(struct(y0, seq, text)) OVER ({frame})")
    line = F.array_sort(F.filter(near, lambda s: F.abs(s.y0 - F.col("y0")) < reach))
    return spans.withColumn("line_text", F.array_join(F.transform(line, lambda s: s.text), " "))


def offset_map(spans: DataFrame) -> DataFrame:
    """spans with start and end in the page's text, which joins them by one space in order of seq."""
    before = page_window("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return spans.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def page_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s.text), " ").alias("page_text"))
