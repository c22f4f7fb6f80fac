"""Text forms of small ordered results: Markdown tables, text tables and trace trees."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def markdown_cell(value: object) -> str:
    return ("" if value is None else str(value)).replace("\\", "\\\\").replace("|", "\\|").replace("\r", "").replace("\n", "<br>")


def markdown(df: DataFrame) -> str:
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join(map(markdown_cell, row))} |" for row in df.toLocalIterator())])


def json_lines(df: DataFrame) -> Iterable[str]:
    return (json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) for row in df.toLocalIterator())


def width(text: str) -> int:
    """Columns that a text takes on a terminal."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def text_table(df: DataFrame) -> str:
    rows = [df.columns, *(["" if v is None else str(v) for v in row] for row in df.toLocalIterator())]
    sizes = [max(width(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(c + " " * (n - width(c)) for c, n in zip(row, sizes)).rstrip() for row in rows)


def tree(rows: Sequence[tuple[int, str]]) -> str:
    """(depth, label) rows in depth-first order as a tree."""
    out, more = [], []
    for k, (depth, label) in enumerate(rows):
        later = next((d for d, _ in rows[k + 1 :] if d <= depth), -1) == depth
        more[depth:] = [later]
        out.append(label if not depth else "".join("│  " if m else "   " for m in more[1:depth]) + ("├─ " if later else "└─ ") + label)
    return "\n".join(out)


def nested(rows: Iterable[tuple[int, dict]]) -> list[dict]:
    """(depth, fields) rows in depth-first order as nested objects, each with its ``children``."""
    top: list[dict] = []
    open_: list[dict] = []
    for depth, fields in rows:
        node = {**fields, "children": []}
        (open_[depth - 1]["children"] if depth else top).append(node)
        open_[depth:] = [node]
    return top
