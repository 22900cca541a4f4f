"""The bank statement plan: spans to decisions, redactions and totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from palimpsest.operators import decide as D, groups as G, layout as L


@dataclass(frozen=True)
class Statement:
    spans: DataFrame
    columns: DataFrame
    cells: DataFrame
    grouped: DataFrame
    transactions: DataFrame

    def decided(self, params: D.Params, verdicts: DataFrame | None = None) -> DataFrame:
        return D.decide(self.transactions, params, verdicts)

    def redactions(self, params: D.Params, verdicts: DataFrame | None = None) -> DataFrame:
        return D.redactions(self.cells, self.decided(params, verdicts), params)

    def survivors(self, params: D.Params, verdicts: DataFrame | None = None) -> DataFrame:
        return D.surviving_spans(self.spans, self.redactions(params, verdicts))


def read_statement(spans: DataFrame, pages: DataFrame | None = None, columns: DataFrame | None = None) -> Statement:
    """columns: those of another detector, such as judged_columns; by labels if not given."""
    spans = L.clean_spans(spans)
    columns = L.detect_columns(spans, pages) if columns is None else columns
    cells = L.assign_roles(L.cluster_rows(spans), columns)
    grouped = G.group_rows(cells)
    return Statement(spans, columns, cells, grouped, G.transactions(grouped))
