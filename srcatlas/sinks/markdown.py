"""Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.operators.summary import severity_summary
from srcatlas.sinks import documents as D

# Rows of the severity table, the place of a finding and the note on an empty report.
SEVERITY_ROW = "| %s | %d |"
PLACE = "`%s:%d:%d`"
NOTHING = "No vulnerabilities found."

TITLE = "# Findings of this scan\n"


def markdown_documents(numbered: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """repo, section, seq, text: counts per severity, then one list entry per finding."""
    totals = D.with_totals(numbered, repos)
    head = F.when(F.col("repo_findings") == 0, f"{TITLE}\n{NOTHING}").otherwise(F.concat(
        F.format_string(f"{TITLE}\n%d in all, by severity:\n\n", "repo_findings"), F.lit("| Severity | Count |\n|---|---|")))
    finding = F.format_string(
        f"1. **%s** (%s, %s) %s\n   at {PLACE}, language: %s\n\n   %s\n",
        "finding_id", "severity", "class", "title", "file", F.col("start_row") + 1, F.col("start_col") + 1, "language", "description",
    )
    return D.documents(
        D.pieces(totals, D.HEAD, F.lit(0), head),
        D.pieces(severity_summary(numbered), D.RULES, 4 - F.col("rank"), F.format_string(SEVERITY_ROW, "severity", "findings")),
        D.pieces(totals.filter("repo_findings > 0"), D.FINDINGS, F.lit(0), F.lit("\n## One by one\n")),
        D.pieces(numbered, D.FINDINGS, F.col("seq"), finding),
    )


def write_markdown(numbered: DataFrame, path: str, repos: DataFrame | None = None, mode: str = "error") -> None:
    D.write_documents(markdown_documents(numbered, repos), path, mode)
