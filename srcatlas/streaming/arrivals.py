"""Scan files as they arrive.

Extraction and detection look at one row at a time, so the batch operators run
on a stream as they are, without state. Only report order and ids need all
findings of a repository; number the written table when a report is due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from srcatlas.operators import detection, extraction


def findings_of_arrivals(files: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """Findings of a stream of ``source_files``."""
    return detection.scan_in_one_pass(extraction.extract_elements(files, ["call", "string"]), focus)


def start_scan(files: DataFrame, path: str, checkpoint: str, focus: list[str] | None = None, **trigger) -> StreamingQuery:
    """Append findings to a Parquet table, each arriving file exactly once."""
    writer = findings_of_arrivals(files, focus).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
