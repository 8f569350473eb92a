"""Sinks: JSON documents and Markdown tables.

Reports are bounded by their definition (a row per language or a top list); MAX_ROWS
guards against rendering a large table on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, into a folder of its own (overwritten)."""
    df.write.mode("overwrite").json(path)


def _rows(df: DataFrame) -> list:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a report holds at most {MAX_ROWS} rows")
    return rows


def json_document(df: DataFrame, **head: object) -> str:
    """A report as one document, indented by two, with the table under rows."""
    rows = [json.loads(r[0]) for r in _rows(df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})))]
    return json.dumps(head | {"rows": rows}, indent=2, ensure_ascii=False)


def cell(value: object) -> str:
    if value is None:
        return "n/a"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:g}" if value == int(value) else repr(value)
    if isinstance(value, list):
        return ", ".join(map(cell, value)) or "none"
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, headings: dict[str, str] | None = None) -> str:
    """The rows in their order as a Markdown table; numbers are aligned to the right."""
    headings = headings or {c: c.replace("_", " ").capitalize() for c in df.columns}
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")}
    lines = ["| " + " | ".join(headings.values()) + " |", "|" + "|".join("--:" if c in numeric else "---" for c in headings) + "|"]
    lines += ["| " + " | ".join(cell(r[c]) for c in headings) + " |" for r in _rows(df.select(*headings))]
    return "\n".join(lines) + "\n"


def markdown_summary(df: DataFrame) -> str:
    """The single row of a summary as a list."""
    return "".join(f"- {c.replace('_', ' ').capitalize()}: {cell(v)}\n" for c, v in df.first().asDict().items())


def write_text(df_text: str, path: str, spark) -> None:
    """A rendered report, as one text file in a folder of its own."""
    spark.createDataFrame([(df_text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
