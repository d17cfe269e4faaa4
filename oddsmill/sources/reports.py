"""Reports: small result tables as Markdown, HTML, spreadsheets and bundles of CSV.

Only result tables are written here: each is cut at ``MOST`` rows, which is an
error unless the caller asks for the first rows, so nothing large is gathered.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table in a report.
MOST = 10_000


def rows_of(df: DataFrame, first: int | None = None) -> tuple[list[str], list[list[str]]]:
    """Column names and cells as text; a table that is too long is an error unless ``first`` rows are asked for."""
    found = df.limit(first if first is not None else MOST + 1).collect()
    if first is None and len(found) > MOST:
        raise ValueError(f"a report's table has at most {MOST} rows")
    text = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return df.columns, [[text(v) for v in r] for r in found]


def markdown(df: DataFrame, title: str | None = None, first: int | None = None) -> str:
    names, rows = rows_of(df, first)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    head = [f"## {title}", ""] if title else []
    return "\n".join([*head, line(names), line(["---"] * len(names)), *map(line, rows)]) + "\n"


def html_table(df: DataFrame, title: str | None = None, first: int | None = None) -> str:
    names, rows = rows_of(df, first)
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in values) + "</tr>"
    head = f"<h2>{html.escape(title)}</h2>" if title else ""
    return f"{head}<table>{cells('th', names)}{''.join(cells('td', r) for r in rows)}</table>"


def page(title: str, sections: dict[str, DataFrame]) -> str:
    """One HTML page, a section a table: a report, or the state of a monitor."""
    body = "".join(html_table(df, name) for name, df in sections.items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def spreadsheet(sections: dict[str, DataFrame], path: str) -> None:
    """A sheet a table; the library ``openpyxl`` must be installed."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("spreadsheets need the library openpyxl") from e
    book = Workbook()
    book.remove(book.active)
    for name, df in sections.items():
        names, rows = rows_of(df)
        sheet = book.create_sheet(name[:31])
        for row in (names, *rows):
            sheet.append(row)
    book.save(path)


def bundle(sections: dict[str, DataFrame], folder: str, title: str = "report") -> list[str]:
    """CSV a table, one Markdown and one HTML page and an index of them; the paths written."""
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    out = []

    def put(name: str, text: str) -> None:
        (where / name).write_text(text, encoding="utf-8")
        out.append(str(where / name))

    for name, df in sections.items():
        names, rows = rows_of(df)
        quoted = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set(',"\n') else v
        put(f"{name}.csv", "\n".join(",".join(map(quoted, r)) for r in (names, *rows)) + "\n")
    put("report.md", f"# {title}\n\n" + "\n".join(markdown(df, name) for name, df in sections.items()))
    put("report.html", page(title, sections))
    put("index.json", json.dumps({"title": title, "tables": {n: df.columns for n, df in sections.items()}}, sort_keys=True))
    return out


def first_bins(df: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Rows of the first ``most`` bins of each group, in the order of the key, as a chart shows them."""
    order = df.select(group, key).distinct()
    kept = order.groupBy(F.col(group).alias("_g")).agg(F.slice(F.array_sort(F.collect_set(key)), 1, most).alias("_keys"))  # bins of a feature, a few dozen
    return df.join(kept, F.col(group).eqNullSafe(F.col("_g"))).where(F.array_contains("_keys", F.col(key))).drop("_g", "_keys")
