"""HTML report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import columns as C
from srcatlas.operators.summary import severity_summary
from srcatlas.sinks import documents as D
from srcatlas.sinks.markdown import NOTHING

HEAD = """<!DOCTYPE html>
<html lang="en">
<meta charset="utf-8"><title>Findings</title>
<style>article{border-left:.3rem solid #888;margin:1rem 0;padding-left:1rem}table{border-collapse:collapse}td{padding:.2rem 1rem}</style>
<body><main>"""


def html_finding() -> Column:
    """One finding as an article; titles, files and descriptions are escaped."""
    place = F.concat(C.html_escape(F.col("file")), F.format_string(":%d:%d", F.col("start_row") + 1, F.col("start_col") + 1))
    return F.concat(
        F.lit('<article data-severity="'), "severity", F.lit('"><h3>'), "finding_id", F.lit(" "), C.html_escape(F.col("title")),
        F.lit("</h3><dl><dt>at</dt><dd><code>"), place, F.lit("</code></dd><dt>class</dt><dd>"), "class",
        F.lit("</dd><dt>severity</dt><dd>"), "severity", F.lit("</dd><dt>language</dt><dd>"), "language", F.lit("</dd></dl><p>"),
        C.html_escape(F.col("description")), F.lit("</p></article>"),
    )


def html_documents(numbered: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """repo, section, seq, text: the number of findings, a table of severities, an article per finding."""
    totals = D.with_totals(numbered, repos)
    count = F.format_string("\n<h1>%d findings</h1>\n", "repo_findings")
    rest = F.when(F.col("repo_findings") == 0, f"<p>{NOTHING}</p>").otherwise("<table>")
    row = F.format_string("<tr><td>%s</td><td>%d</td></tr>", "severity", "findings")
    return D.documents(
        D.pieces(totals, D.HEAD, F.lit(0), F.concat(F.lit(HEAD), count, rest)),
        D.pieces(severity_summary(numbered), D.RULES, 4 - F.col("rank"), row),
        D.pieces(totals.filter("repo_findings > 0"), D.FINDINGS, F.lit(0), F.lit("</table>")),
        D.pieces(numbered, D.FINDINGS, F.col("seq"), html_finding()),
        D.pieces(totals, D.FOOT, F.lit(0), F.lit("</main></body></html>")),
    )


def write_html(numbered: DataFrame, path: str, repos: DataFrame | None = None, mode: str = "error") -> None:
    D.write_documents(html_documents(numbered, repos), path, mode)
