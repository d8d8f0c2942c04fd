"""A report by the name of its format."""

from __future__ import annotations

from pyspark.sql import DataFrame

from srcatlas.sinks.findings_json import write_findings_json
from srcatlas.sinks.html import write_html
from srcatlas.sinks.markdown import write_markdown
from srcatlas.sinks.sarif import write_sarif

FORMATS = {"sarif": write_sarif, "json": write_findings_json, "markdown": write_markdown, "html": write_html}


def write_report(report_format: str, numbered: DataFrame, path: str, repos: DataFrame | None = None, **options) -> None:
    """Writes one of ``FORMATS``; another name is an error."""
    if report_format not in FORMATS:
        raise ValueError(f"unknown report format {report_format!r}; known are {', '.join(FORMATS)}")
    FORMATS[report_format](numbered, path, repos, **options)
