"""Span sources: Parquet or JSON tables of spans, structured-text JSON, text logs, raw documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palimpsest.types import SPANS

LINES = "array<struct<lines: array<struct<text: string, bbox: struct<x: double, y: double, w: double, h: double>>>>>"


def read_spans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(SPANS).load(path)


def spans_from_json(pages: DataFrame, json: str = "json") -> DataFrame:
    """Line spans of structured-text JSON ({"blocks": [{"lines": [{"text", "bbox": {x, y, w, h}}]}]}), trimmed, none empty."""
    blocks = F.from_json(json, f"blocks {LINES}")["blocks"]
    lines = F.flatten(F.transform(blocks, lambda b: F.coalesce(b.lines, F.array().cast("array<struct<text:string,bbox:struct<x:double,y:double,w:double,h:double>>>"))))
    flat = pages.select("doc_id", "page_no", F.posexplode(lines).alias("seq", "l"))
    out = flat.select("doc_id", "page_no", "seq", F.trim("l.text").alias("text"), F.col("l.bbox.x").alias("x0"), F.col("l.bbox.y").alias("y0"), (F.col("l.bbox.x") + F.col("l.bbox.w")).alias("x1"), (F.col("l.bbox.y") + F.col("l.bbox.h")).alias("y1"))
    return out.where("text <> ''")


def documents(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, content) of the files in a folder; doc_id is the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.col("path").alias("doc_id"), "content")


def entries(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id) of what stands in a folder, a table kept as a folder of parts included; nothing is opened. As for Spark, names with a leading `_` or `.` are hidden."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at, jvm.org.apache.hadoop.fs.GlobFilter(glob))
    # all paths in one call: one call a path takes half a millisecond
    joined = jvm.scala.runtime.ScalaRunTime.genericWrapArray(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)).mkString("\0")
    paths = [p for p in joined.split("\0") if p and not p.rpartition("/")[2].startswith(("_", "."))]
    return spark.createDataFrame(pa.table({"doc_id": pa.array(paths, pa.string())}))


def file_order(files: DataFrame) -> DataFrame:
    """(doc_id, name, place): file names in lexicographic order, from 1; one task, for a folder's names only."""
    names = files.select("doc_id", F.element_at(F.split("doc_id", "/"), -1).alias("name"))
    return names.withColumn("place", F.row_number().over(Window.orderBy("name")))


def extract_spans(files: DataFrame, extractor: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Spans by a caller's extractor: bytes to (page_no, text, x0, y0, x1, y1) tuples, in reading order."""
    names = SPANS.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [(doc, p, k, t, x0, y0, x1, y1) for k, (p, t, x0, y0, x1, y1) in enumerate(extractor(raw))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in found], schema=pa.schema([(n, pa.string() if n in ("doc_id", "text") else pa.int32() if n in ("page_no", "seq") else pa.float64()) for n in names]))

    return files.select("doc_id", "content").mapInArrow(run, SPANS)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, value) of an append log of `timestamp,value` lines; blank lines are left out."""
    return parse_log(spark.read.text(path))


def parse_log(lines: DataFrame) -> DataFrame:
    line = lines.where("trim(value) <> ''")
    return line.select(F.split("value", ",", 2)[0].cast("timestamp").alias("ts"), F.split("value", ",", 2)[1].alias("value"))


def text_in_box(spans: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, pad: float = 1.0) -> DataFrame:
    """(doc_id, page_no, text): the spans that meet the padded box, white space squeezed."""
    meets = (F.col("x0") < x1 + pad) & (F.col("x1") > x0 - pad) & (F.col("y0") < y1 + pad) & (F.col("y1") > y0 - pad)
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    joined = F.array_join(F.transform(parts, lambda s: s.text), " ")
    return spans.where(meets).groupBy("doc_id", "page_no").agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))
