"""Personal data of a folder of spans: `python -m palimpsest.report SPANS [--enforce OUT] [--landlord]`.

Prints the counts by type of every page and document, never any matched text. With --enforce the findings are redacted
and written, too; --landlord leaves out what shows whose account it is.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import layout as L, pii as I
from palimpsest.operators.layout import PAGE
from palimpsest.sources import sinks, spans as src


def findings_of(spans: DataFrame, landlord: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, regions) of statement spans: regions by the header of each page and of those before it."""
    spans = L.clean_spans(spans)
    regions = L.seen_header(spans.select(*PAGE).distinct(), L.detect_columns(spans))
    return I.page_findings(spans, regions, exclude=I.LANDLORD_PRESERVED if landlord else ()), regions


def run(spark: SparkSession, path: str, out: str | None = None, landlord: bool = False) -> Iterator[str]:
    """The report's lines by document and page, a document's own line last; rows come partition by partition."""
    spans = src.read_spans(spark, path)
    findings, regions = findings_of(spans, landlord)
    if out is not None:
        sinks.save_redacted(spans, I.enforced(findings), out)
    lines = I.report(findings, regions).selectExpr("doc_id", "line", "page_no IS NULL AS last", "page_no")
    for r in lines.orderBy("doc_id", "last", "page_no").toLocalIterator():
        yield f"{r['doc_id']} {r['line']}"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest.report", description=__doc__.splitlines()[0])
    parser.add_argument("spans", help="folder of spans in Parquet")
    parser.add_argument("--enforce", metavar="OUT", help="write the redactions and what they leave to OUT")
    parser.add_argument("--landlord", action="store_true", help="preserve name, account number, sort code and IBAN")
    args = parser.parse_args(argv)
    for line in run(SparkSession.builder.getOrCreate(), args.spans, args.enforce, args.landlord):
        print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
