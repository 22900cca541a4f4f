"""Cells to transactions: dated and dateless grouping, descriptions, amounts, credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.predicates import is_amount, is_date, parse_amount
from palimpsest.operators.layout import PAGE


def _has_role(role: str) -> Column:
    return F.exists("bands", lambda b: b.role == role)


def group_rows(cells: DataFrame, max_gap: float = 20.0) -> DataFrame:
    """Cells below the header that belong to a transaction, with group_id (from 1) and is_head.

    On a page with a date column a row with a date starts a group, otherwise a row with a paid in or paid out amount.
    The rows that follow belong to it while each is at most max_gap below the row before; after a larger gap rows
    belong to nothing until the next start.
    """
    body = cells.where("row_y > header_y")
    dated = _has_role("date")
    date_cell = is_date(F.col("text")) & (F.col("role") == "date")
    money_cell = is_amount(F.col("text")) & F.col("role").isin("paid_in", "paid_out")
    start_cell = F.when(dated, date_cell).otherwise(money_cell)
    row = Window.partitionBy(*PAGE, "row_id")
    down = Window.partitionBy(*PAGE).orderBy("row_id")  # rows of one row_id are peers
    rows = body.withColumns({"dated": dated, "is_head": F.max(start_cell).over(row), "_first": F.row_number().over(row.orderBy("x0", "seq")) == 1})
    above = F.max("row_y").over(down.rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"group_id": F.sum((F.col("is_head") & F.col("_first")).cast("int")).over(down), "_far": ~F.col("is_head") & F.coalesce(F.col("row_y") - above > max_gap, F.lit(False))})
    since = Window.partitionBy(*PAGE, "group_id").orderBy("row_id")
    rows = rows.withColumn("_broken", F.max("_far").over(since)).where("group_id > 0 and not _broken")
    return rows.select(*cells.columns, "group_id", "is_head", "dated")


def transactions(grouped: DataFrame) -> DataFrame:
    """(page, group_id, description, amount, is_credit, dated, cells): one row a group; cells are (seq, role, box).

    amount is the first paid out, else the first paid in, else 0. A dateless group takes amounts from its head row.
    Credit: a paid in amount on pages that have both money columns; elsewhere an amount that ends in CR or starts
    with a minus.
    """
    order = F.struct("row_id", "y0", "x0", "seq")
    counted = is_amount(F.col("text")) & (F.col("dated") | F.col("is_head"))
    first = lambda role: F.min_by(F.when(counted & (F.col("role") == role), parse_amount(F.col("text"))), F.when(counted & (F.col("role") == role), order))
    marked = F.endswith(F.upper(F.trim("text")), F.lit("CR")) | F.startswith(F.trim("text"), F.lit("-"))
    both = _has_role("paid_in") & _has_role("paid_out")
    credit = counted & F.when(both, F.col("role") == "paid_in").otherwise(marked)
    words = F.array_sort(F.collect_list(F.when(F.col("role") == "description", F.struct("row_id", "y0", "x0", "seq", "text"))))
    return grouped.groupBy(*PAGE, "group_id").agg(
        F.trim(F.array_join(F.transform(words, lambda s: s.text), " ")).alias("description"),
        F.coalesce(first("paid_out"), first("paid_in"), F.lit(0).cast("decimal(18,2)")).alias("amount"),
        F.max(credit).alias("is_credit"),
        F.max("dated").alias("dated"),
        F.collect_list(F.struct("seq", "role", "x0", "y0", "x1", "y1")).alias("cells"),
    )
