"""Tables as files. Everything is written by the executors and put in place by Spark's commit, so that a lost executor
leaves no half-written file; nothing that is there already is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(rows: DataFrame, folder: str, by: str | list[str] = "doc_id", text: str = "text") -> None:
    """A UTF-8 file with LF line ends for each row, in a folder for each value of by. Null texts write nothing."""
    keys = [by] if isinstance(by, str) else by
    # the writer ends each row with a line end of its own
    lines = rows.where(F.col(text).isNotNull()).select(*keys, F.regexp_replace(text, r"\n\z", "").alias("value"))
    lines.write.partitionBy(*keys).option("lineSep", "\n").mode("errorifexists").text(folder)


def write_lines(rows: DataFrame, folder: str, order: str, text: str = "text") -> None:
    """One text of many rows: parts of a folder, to be read in the order of their names, sorted by a column."""
    rows.orderBy(order).select(text).write.option("lineSep", "\n").mode("errorifexists").text(folder)


def write_reports(reports: DataFrame, folder: str) -> None:
    """A line of JSON for each row of (doc_id, report): the report, with the id of its document."""
    one = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(","), F.expr("substring(report, 2)"))
    reports.select(one.alias("value")).write.mode("errorifexists").text(folder)


def write_version(rows: DataFrame, folder: str, version: int, by: str = "doc_id", text: str = "text") -> None:
    """A rewritten text for each row as one more version of a folder; earlier versions, and the input, stay as they are."""
    write_texts(rows, f"{folder}/version={version}", by, text)


def write_records(df: DataFrame, folder: str, columns: list[str]) -> None:
    """A tab-separated table with a header line, which opens with the mark of UTF-8, as spreadsheet programs expect."""
    first, *rest = columns
    out = df.select(F.col(first).alias("﻿" + first), *rest)
    out.write.csv(folder, sep="\t", header=True, quote='"', escape='"', mode="errorifexists", lineSep="\r\n")
