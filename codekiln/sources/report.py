"""A short HTML report of a few summary tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def _table(df: DataFrame, most: int) -> str:
    rows = df.limit(most).collect()  # a report shows a few rows
    cells = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape('' if x is None else str(x), quote=True)}</{tag}>" for x in xs) + "</tr>"
    return "<table>" + cells("th", df.columns) + "".join(cells("td", r) for r in rows) + "</table>"


def render_report(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """A page with one table for each section, at most `most` rows each, in the order that the tables have."""
    parts = [f"<h2>{html.escape(name)}</h2>{_table(df, most)}" for name, df in sections.items()]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"
