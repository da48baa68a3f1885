"""JSON and CSV outputs. A target that already exists is never overwritten."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagetab.functions.text import csv_guard, python_bool, utc_iso

# The exported document columns in their order.
DOCUMENT_COLUMNS = (
    "url", "title", "text", "content_sha256", "fetched_at", "http_status",
    "discovered_from", "depth", "text_truncated", "title_missing",
)


def document_cells(records: DataFrame) -> DataFrame:
    """Document records as guarded text cells."""
    shown = {
        "fetched_at": utc_iso(F.col("fetched_at")),
        "text_truncated": python_bool(F.col("text_truncated")),
        "title_missing": python_bool(F.col("title_missing")),
    }
    cells = [csv_guard(shown.get(c, F.col(c).cast("string"))).alias(c) for c in DOCUMENT_COLUMNS]
    return records.where(F.col("kind") == "document").select(*cells)


def write_documents_csv(records: DataFrame, path: str) -> None:
    """Documents as CSV with a header and CRLF row ends."""
    (
        document_cells(records).write.mode("errorifexists")
        .option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n")
        .csv(path)
    )


def write_records_json(records: DataFrame, path: str) -> None:
    """All records as JSON lines; a column that a kind of record does not have is left out."""
    shown = records.withColumn("fetched_at", utc_iso(F.col("fetched_at")))
    shown.write.mode("errorifexists").option("ignoreNullFields", True).json(path)


def write_reports_json(reports: DataFrame, path: str) -> None:
    reports.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


class TargetExists(FileExistsError):
    """The target of a run's outputs is there already; nothing was written."""


def write_together(spark: SparkSession, target: str, outputs: dict[str, Callable[[str], None]]) -> None:
    """All ``outputs`` (folder name to what writes it) as one new folder ``target``, or none of them.

    They are written to a folder beside the target, with a manifest of their
    files and bytes, and renamed in one step that fails if the target has come to be
    there meanwhile. A failed run leaves no target, and its own folder is removed.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    end, staging = path(target.rstrip("/")), path(f"{target.rstrip('/')}.unfinished-{uuid.uuid4().hex}")
    fs = end.getFileSystem(conf)
    if fs.exists(end):
        raise TargetExists(target)
    try:
        listed = {}
        for name, write in outputs.items():
            write(f"{staging}/{name}")
            size = fs.getContentSummary(path(f"{staging}/{name}"))
            listed[name] = {"files": size.getFileCount(), "bytes": size.getLength()}
        with_manifest = fs.create(path(f"{staging}/manifest.json"))
        with_manifest.write(bytearray(json.dumps(listed, sort_keys=True).encode()))
        with_manifest.close()
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        absolute = fs.makeQualified
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(absolute(end).toUri(), conf).rename(absolute(staging), absolute(end), options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise TargetExists(target) from error
            raise
    finally:
        fs.delete(staging, True)


def write_run(records: DataFrame, reports: DataFrame, target: str) -> None:
    """Documents as CSV, records and reports as JSON, together below ``target``: all of them or none."""
    write_together(records.sparkSession, target, {
        "documents": lambda at: write_documents_csv(records, at),
        "records": lambda at: write_records_json(records, at),
        "reports": lambda at: write_reports_json(reports, at),
    })
