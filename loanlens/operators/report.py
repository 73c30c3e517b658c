"""HTML pages of small result tables."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


def _cell(value) -> str:
    if value is None:
        return "<td></td>"
    return f"<td>{escape(f'{value:.6g}' if isinstance(value, float) else str(value))}</td>"


def table(df: DataFrame) -> str:
    """A table with the frame's own columns; the rows reach the driver, so pass k-row results."""
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    rows = ["".join(map(_cell, r)) for r in df.collect()]
    return "<table>" + "".join(f"<tr>{r}</tr>" for r in [head, *rows]) + "</table>"


def page(title: str, sections: dict[str, DataFrame]) -> str:
    """One section a table, in the order given."""
    parts = [f"<section><h2>{escape(name)}</h2>{table(df)}</section>" for name, df in sections.items()]
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1>' + "\n".join(parts)
