"""Where records go: checked, redacted, and written in one of six formats.

Executors write folders of files. Files of one piece (SQLite, and JSON, CSV and Markdown
where ``merged`` is asked for) stream partition by partition through the driver.
"""

from __future__ import annotations

import csv
import json
import sqlite3
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redaction import redact_frame
from ..functions.text import markdown_cell

#: File endings and their formats.
FORMATS = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".md": "md", ".sqlite": "sqlite", ".parquet": "parquet"}


def resolve_format(path: str, explicit: str | None = None) -> str:
    """The named format, else that of the file ending; an error before anything is written."""
    if explicit is not None:
        if explicit not in FORMATS.values():
            raise ValueError(f"unknown output format {explicit!r}")
        return explicit
    ending = Path(path).suffix.lower()
    if ending not in FORMATS:
        raise ValueError(f"no output format known for {path!r}")
    return FORMATS[ending]


def checked(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared fields in declared order and type, or an error before any write."""
    have, want = set(records.columns), [f.name for f in schema]
    if have != set(want):
        raise ValueError(f"fields differ: missing {sorted(set(want) - have)}, unexpected {sorted(have - set(want))}")
    kinds = {f.name: f.dataType for f in records.schema}
    for f in schema:
        if kinds[f.name] != f.dataType and not isinstance(kinds[f.name], T.NullType):
            raise ValueError(f"field {f.name!r} is {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return records.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))


def write_records(records: DataFrame, schema: T.StructType, path: str, explicit: str | None = None, merged: bool = False) -> str:
    """Check, redact and write; returns the format.

    Executors write a folder of files, each whole in its format (JSON: one array a file;
    Markdown: one table a file). ``merged`` makes one local file of it instead, row by row on the
    driver; SQLite is always that.
    """
    kind = resolve_format(path, explicit)
    rows = redact_frame(checked(records, schema))
    if not merged and kind in ("json", "csv", "md"):
        {"json": _json_files, "csv": _csv_files, "md": _markdown_files}[kind](rows, path)
        return kind
    {"json": _json, "jsonl": _jsonl, "csv": _csv, "md": _markdown, "sqlite": _sqlite, "parquet": _parquet}[kind](rows, path)
    return kind


def _part(rows: DataFrame, path: str, line: Column, before: str, between: str, after: str) -> None:
    """Text files of a partition's lines each, with a head and an end."""

    def walk(batches):
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([(before if first and i == 0 else between) + x for i, x in enumerate(lines)])], names=["value"])
                first = False
        if not first and after:
            yield pa.RecordBatch.from_arrays([pa.array([after])], names=["value"])

    rows.select(line.alias("line")).mapInArrow(walk, "value string").write.mode("overwrite").text(path)


def _json_files(rows: DataFrame, path: str) -> None:
    _part(rows, path, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), "[", ",", "]")


def _csv_files(rows: DataFrame, path: str) -> None:
    kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.write.mode("overwrite").options(header="true", escape='"', emptyValue="", **kept).csv(path)


def _markdown_files(rows: DataFrame, path: str) -> None:
    head = "| " + " | ".join(rows.columns) + " |\n| " + " | ".join("---" for _ in rows.columns) + " |\n"
    _part(rows, path, F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.col(f"`{c}`")) for c in rows.columns)), F.lit(" |")), head, "", "")


def _json(rows: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(rows.toLocalIterator()):
            body = json.dumps(row.asDict(recursive=True), indent=2, default=str)
            f.write(("," if i else "") + "\n  " + body.replace("\n", "\n  "))
        f.write("\n]" if rows.columns else "]")


def _jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _csv(rows: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(rows.columns)
        writer.writerows(["" if v is None else v for v in row] for row in rows.toLocalIterator())


def markdown_lines(rows: DataFrame) -> DataFrame:
    """One line of a Markdown table per row."""
    cells = [markdown_cell(F.col(f"`{c}`")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def _markdown(rows: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("| " + " | ".join(rows.columns) + " |\n| " + " | ".join("---" for _ in rows.columns) + " |\n")
        for row in markdown_lines(rows).toLocalIterator():
            f.write(row["line"] + "\n")


def _sqlite(rows: DataFrame, path: str) -> None:
    Path(path).unlink(missing_ok=True)
    kinds = ", ".join(f'"{f.name}" {"REAL" if isinstance(f.dataType, T.DoubleType) else "TEXT"}' for f in rows.schema)
    names = ", ".join(f'"{c}"' for c in rows.columns)
    conn = sqlite3.connect(path)
    try:
        conn.execute(f"CREATE TABLE records ({kinds})")
        conn.executemany(f"INSERT INTO records ({names}) VALUES ({', '.join('?' for _ in rows.columns)})", (tuple(r) for r in rows.toLocalIterator()))
        conn.commit()
    finally:
        conn.close()


def _parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
