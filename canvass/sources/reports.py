"""Reports of small results: JSON, CSV and Markdown files in any store that Spark knows."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

#: Rows a report may have: reports are for people, and their rows come to the driver.
MOST_ROWS = 10_000


def _rows(rows: DataFrame) -> list[dict]:
    found = rows.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows are too many for a report; write them with export()")
    return [r.asDict(recursive=True) for r in found]


def markdown_value(value: object) -> str:
    """A cell: bars escaped, line ends as spaces, null as nothing."""
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def as_json(rows: DataFrame) -> str:
    return json.dumps(_rows(rows), indent=2, default=str, ensure_ascii=False) + "\n"


def as_csv(rows: DataFrame) -> str:
    out = io.StringIO()
    writer = csv.DictWriter(out, rows.columns, lineterminator="\n")
    writer.writeheader()
    writer.writerows(_rows(rows))
    return out.getvalue()


def as_markdown(rows: DataFrame, title: str) -> str:
    """A heading and a table; cells are escaped, nulls are empty."""
    head = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    body = ["| " + " | ".join(markdown_value(v) for v in r.values()) + " |" for r in _rows(rows)]
    return "\n".join([f"# {title}", "", *head, *body]) + "\n"


def write_report(rows: DataFrame, path: str, title: str = "Report") -> None:
    """Write a report by the ending of ``path``: .json, .csv or .md; a file that is there is replaced."""
    kind = path.rsplit(".", 1)[-1]
    makers = {"json": as_json, "csv": as_csv, "md": lambda r: as_markdown(r, title)}
    if kind not in makers:
        raise ValueError(f"no reports of kind {kind}")
    text = makers[kind](rows)
    context = rows.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
    stream.write(text.encode())
    stream.close()
