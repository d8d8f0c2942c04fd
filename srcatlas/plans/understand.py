"""Listings over a code base: call graph, entry points, statistics, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.operators import graph, summary
from srcatlas.sources import trees


def call_graph_lines(elements: DataFrame) -> DataFrame:
    """repo, line: ``from (file:line) -> to (file:line)`` per resolved call."""
    # Fixed value: the form of a line of the listing.
    text = F.format_string(
        "%s (%s:%d) → %s (%s:%d)", "from_name", "from_file", "from_line", "to_name", "to_file", "to_line"
    )
    return graph.call_graph(elements).select("repo", text.alias("line"))


def entry_point_lines(elements: DataFrame) -> DataFrame:
    """repo, line: ``name (file:line)`` per function without callers."""
    return graph.entry_points(elements).select("repo", F.format_string("%s (%s:%d)", "name", "file", "line").alias("line"))


def repo_summary(files: DataFrame, elements: DataFrame) -> DataFrame:
    """repo, measure, value: graph statistics and files per language."""
    stats = graph.graph_stats(files, elements)
    measures = ["files", "functions", "calls", "imports", "strings", "resolved_calls"]
    by_measure = stats.select(
        "repo",
        F.explode(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m))])).alias("measure", "value"),
    )
    languages = summary.language_stats(files).select(
        "repo", F.concat(F.lit("language:"), "language").alias("measure"), F.col("files").alias("value")
    )
    return by_measure.unionByName(languages)


def tree_info(roots: DataFrame) -> DataFrame:
    """repo, language, files of the trees at ``roots``; no file is opened."""
    return summary.language_stats(trees.read_source_files(roots, include_content=False))
