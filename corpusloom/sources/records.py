"""Corpus records as JSON lines, single JSON documents and workbooks."""

from __future__ import annotations

import io
import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.report import column_widths
from corpusloom.sources import files
from corpusloom.sources.snapshots import SnapshotTable, Version
from corpusloom.sources.unknown import as_lines, parsed
from corpusloom.sources.workbooks import SHEET_ROWS, write_book


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a malformed line is an error.

    With a schema only its fields are parsed. Without, the schema is inferred from all lines.
    """
    files.recover(spark, path)
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """One column v, a VARIANT of the whole record: unknown keys, and the difference between a missing and a null one, stay."""
    return spark.read.option("mode", "FAILFAST").option("singleVariantColumn", "v").json(path)


def variant_text(v: str | Column, path: str, missing: Column) -> Column:
    """A text of a variant: ``missing`` where the key isn't there, null where it is null."""
    v = F.col(v) if isinstance(v, str) else v
    found = F.try_variant_get(v, path, "variant")
    return F.when(found.isNull(), missing).otherwise(F.try_variant_get(v, path, "string"))


def record_table(spark: SparkSession, path: str) -> SnapshotTable:
    """Records as JSON lines in a table of versions; a plain file or folder of JSON lines is its first."""
    return SnapshotTable(spark, path, "text")


def read_records(spark: SparkSession, path: str, schema: T.StructType, version: Version | int | None = None) -> DataFrame:
    """Records with the fields of ``schema``, and what else they have in ``unknown.UNKNOWN``; of one version of a
    ``record_table`` or of plain JSON lines. Blank lines are skipped, a malformed line is an error."""
    lines = record_table(spark, path).read(version, "value string")
    return parsed(lines.where(F.trim("value", F.lit(" \t\r\n")) != ""), schema)


def lines_of(df: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """The JSON text of each record in ``order``, unknown keys where they were."""
    out = df.orderBy(*order) if order else df
    return as_lines(out)


def write_jsonl(df: DataFrame, path: str, order: tuple[str, ...] = (), *, single: bool = False) -> None:
    """JSON lines in ``order``, nulls written, text not escaped. A folder is written beside the target, then
    renamed, so input and target may be the same path; after a crash ``read_jsonl`` finds the old data or all of the new.

    ``single`` makes one file instead of a folder of parts, by one task: for exports of known size.
    """
    beside = stage_jsonl(df, path, order, single=single)
    if single:
        files.move(df.sparkSession, files.only_part(df.sparkSession, beside), path)
        files.delete(df.sparkSession, beside)
    else:
        files.move(df.sparkSession, beside, path)


def stage_jsonl(df: DataFrame, path: str, order: tuple[str, ...] = (), *, single: bool = False) -> str:
    """Writes JSON lines beside ``path``, where nobody looks; returns the folder, which ``files.move`` puts in place."""
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    out = lines_of(df, order)
    (out.coalesce(1) if single else out).write.text(beside)
    return beside


def write_json(spark: SparkSession, path: str, document: dict[str, Any]) -> None:
    """One document, indented, with a line feed at its end."""
    files.write_bytes(spark, path, (json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode())


def write_workbook(table: DataFrame, path: str, order: tuple[str, ...] = ()) -> int:
    """The table as one workbook, for people to read; returns its rows. It is made on the driver, so more than a sheet
    holds is refused: ``workbooks.write_workbooks`` writes a folder of them where the rows are."""
    out = table.orderBy(*order) if order else table
    rows = [list(r) for r in out.limit(SHEET_ROWS).collect()]
    if len(rows) >= SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS} rows with its header; write Parquet or CSV instead")
    widths = {r.name: r.width for r in column_widths(table).collect()}
    out = io.BytesIO()
    write_book(out, rows, table.columns, [widths[c] for c in table.columns])
    files.write_bytes(table.sparkSession, path, out.getvalue())
    return len(rows)
