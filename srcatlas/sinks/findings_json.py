"""Findings as JSON: one array per repository, or one object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.sinks import documents as D

# Keys of a finding, in order, and the columns they come from.
KEYS = {
    "ID": "finding_id", "Class": "class", "Severity": "severity", "Title": "title",
    "Description": "description", "File": "file", "StartRow": "start_row", "StartCol": "start_col",
    "EndRow": "end_row", "EndCol": "end_col", "Language": "language", "NodeID": "node_id",
}


def finding_object() -> Column:
    return F.struct(*[F.col(column).alias(key) for key, column in KEYS.items()])


def json_documents(numbered: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """repo, section, seq, text: an array of findings, ``null`` where there are none."""
    totals = D.with_totals(numbered, repos)
    zero = F.lit(0)
    comma = F.when(F.col("seq") > 1, ",").otherwise("")
    return D.documents(
        D.pieces(totals, D.HEAD, zero, F.when(F.col("repo_findings") == 0, "null").otherwise("[")),
        D.pieces(numbered, D.FINDINGS, F.col("seq"), F.concat(comma, F.to_json(finding_object()))),
        D.pieces(totals.filter("repo_findings > 0"), D.FOOT, zero, F.lit("]")),
    )


def write_findings_json(
    numbered: DataFrame, path: str, repos: DataFrame | None = None, lines: bool = False, mode: str = "error"
) -> None:
    """``lines``: plain JSON lines instead of one array, for the largest results."""
    if lines:
        numbered.select("repo", "seq", finding_object().alias("f")).select("repo", "seq", "f.*").write.mode(mode).json(path)
    else:
        D.write_documents(json_documents(numbered, repos), path, mode)
