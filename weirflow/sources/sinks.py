"""Out: exports and reports."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.text import csv_line
from weirflow.operators.reports import AUDIT_COLUMNS
from weirflow.sources.store import Files


def write_text(path: str | Path, text: str) -> None:
    """The whole file or none: a temporary file, renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.tmp")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


def export_json(delta: DataFrame, root: str, day: str) -> bool:
    """The delta as JSON under provider, account and day; a later run of the day replaces it. Nothing is written for no rows."""
    if delta.isEmpty():
        return False
    parts = ["provider", "provider_account_id", "export_date"]
    delta.withColumn("export_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).json(root)
    return True


def export_file(delta: DataFrame, path: str) -> None:
    """One pretty-printed array, for deltas that a person reads: rows come a partition at a time."""
    rows = ",\n".join(json.dumps(json.loads(r.j), indent=2, ensure_ascii=False) for r in delta.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator())
    write_text(path, f"[\n{rows}\n]" if rows else "[]")


def csv_rows(rows: DataFrame, columns: list[str] = AUDIT_COLUMNS) -> DataFrame:
    """A CSV line for each row."""
    return rows.select(csv_line([F.col(c) for c in columns]).alias("line"))


def write_csv(rows: DataFrame, path: str, columns: list[str] = AUDIT_COLUMNS) -> None:
    """A folder of CSV files with a header each."""
    rows.select(*columns).write.mode("overwrite").options(header=True, quote='"', escape='"', nullValue="", emptyValue="").csv(path)


def _pretty(columns: list[str]) -> Column:
    """A row as the JSON text of an object that stands in a list, two levels in."""
    value = lambda c: F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    inner = lambda c: F.substr(value(c), F.lit(6), F.char_length(value(c)) - 6)
    lines = F.array(*[F.concat(F.lit(f"      {json.dumps(c)}: "), inner(c)) for c in columns])
    return F.concat(F.lit("    {\n"), F.array_join(lines, ",\n"), F.lit("\n    }"))


def write_report(audit: DataFrame, summary: dict[str, Any], run_id: str, folder: str, one_file: bool = True) -> tuple[str, str]:
    """The audit report of a run as JSON and CSV, on any file system; (json path, csv path).

    The executors write the rows as text, in order. As one file each, their files are put together stream by stream; no row comes
    to the driver's Python. With ``one_file`` false they stay folders (JSON lines, CSV with headers), with a summary beside them.
    """
    base, files = f"{folder}/finance-sync-{run_id}", Files(audit.sparkSession)
    said = json.dumps({"runId": run_id, "summary": summary}, indent=2, ensure_ascii=False)
    if not one_file:
        audit.select(F.to_json(F.struct(*AUDIT_COLUMNS), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{base}.json")
        write_csv(audit, f"{base}.csv")
        files.create(f"{base}-summary.json", said, replace=True)
        return f"{base}.json", f"{base}.csv"
    parts = f"{base}.parts-{uuid.uuid4().hex}"
    try:
        audit.select(_pretty(AUDIT_COLUMNS).alias("value")).write.option("lineSep", ",\n").text(f"{parts}/json")
        csv_rows(audit).write.option("lineSep", "\n").text(f"{parts}/csv")
        names = {kind: [f"{parts}/{kind}/{x}" for x in files.names(f"{parts}/{kind}") if x.startswith("part-")] for kind in ("json", "csv")}
        some = not audit.isEmpty()
        files.assemble(f"{base}.json", said[:-2] + ',\n  "transactions": [' + ("\n" if some else ""), names["json"], "\n  ]\n}" if some else "]\n}", cut=2)
        files.assemble(f"{base}.csv", ",".join(AUDIT_COLUMNS) + "\n", names["csv"], "")
    finally:
        files.delete(parts)
    return f"{base}.json", f"{base}.csv"
