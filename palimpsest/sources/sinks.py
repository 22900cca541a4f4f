"""Sinks: result tables, append logs, file names, response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators.decide import destroyed_text


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_redacted(spans: DataFrame, boxes: DataFrame, path: str) -> None:
    """path/redactions, the boxes, and path/redacted_spans: spans with the text that the boxes leave, none empty.

    A span whose text is destroyed in whole is left out, so what is written holds nothing of what was redacted.
    """
    write_result(boxes, f"{path}/redactions")
    left = destroyed_text(spans, boxes).withColumn("text", F.col("left")).where(F.trim("text") != "")
    write_result(left.select(*spans.columns), f"{path}/redacted_spans")


def append_log(values: DataFrame, path: str, value: str) -> None:
    """`ISO timestamp,value` lines; never any content of a document."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    values.select(log_line(stamp, F.col(value)).alias("value")).write.mode("append").text(path)


def log_line(stamp: Column, value: Column) -> Column:
    return F.concat_ws(",", stamp, value.cast("string"))


def output_name(stem: Column, total: Column) -> Column:
    return F.format_string("redacted_%s_£%.2f.pdf", stem, total.cast("double"))


def response(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def total_annotations(section_ends: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per document of more than one page: the total, 15 points below the left column's end on the last page, else at 545."""
    last = section_ends.groupBy("doc_id").agg(F.max("page_no").alias("_last"), F.max_by("end_y", "page_no").alias("_end"))
    return last.where("_last > 0").join(totals, "doc_id").select("doc_id", F.lit(1).alias("page_no"), F.coalesce(F.col("_end") + 15, F.lit(545.0)).alias("y"), F.format_string("%.2f", F.col("total").cast("double")).alias("text"))
