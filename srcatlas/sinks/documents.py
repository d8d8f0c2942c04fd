"""Report documents made of pieces, so that no task has to hold a whole one.

A sink turns numbered findings into pieces: repo, section, seq, text. A piece is one or more
whole lines, without the last line feed. In order of (section, seq) the pieces of a repository,
a line feed behind each, are its document, whatever its size. Sections are the head (0), the
rules (1), the findings (2) and the foot (3).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, RULES, FINDINGS, FOOT = range(4)


def with_totals(numbered: DataFrame, repos: DataFrame | None) -> DataFrame:
    """repo, repo_findings: every repository once, with its number of findings.

    ``repos`` adds repositories that have none.
    """
    totals = numbered.groupBy("repo").agg(F.max("repo_findings").alias("repo_findings"))
    if repos is None:
        return totals
    return (
        repos.select("repo").distinct().join(totals, "repo", "left").na.fill(0, ["repo_findings"])
    )


def pieces(rows: DataFrame, section: int, seq: Column, text: Column) -> DataFrame:
    return rows.select("repo", F.lit(section).alias("section"), seq.cast("bigint").alias("seq"), text.alias("text"))


def documents(*parts: DataFrame) -> DataFrame:
    """repo, section, seq, text."""
    return reduce(DataFrame.unionByName, parts)


def write_documents(docs: DataFrame, path: str, mode: str = "error") -> None:
    """One folder ``repo=...`` per repository with text files; in order of name they are the document."""
    (
        docs.repartitionByRange("repo", "section", "seq")
        .sortWithinPartitions("repo", "section", "seq")
        .select("repo", "text")
        .write.mode(mode).partitionBy("repo").text(path)
    )
