"""Counts over files and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas import model, rules
from srcatlas.functions import columns as C


def language_stats(files: DataFrame) -> DataFrame:
    """repo, language, files."""
    return files.groupBy("repo", "language").agg(F.count("*").alias("files"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """repo, severity, rank, findings; severities nobody knows are left out."""
    known = findings.filter(F.col("severity").isin(list(rules.SEVERITY_RANK)))
    return (
        known.groupBy("repo", "severity").agg(F.count("*").alias("findings"))
        .select("repo", "severity", C.severity_rank(F.col("severity")).alias("rank"), "findings")
    )


def ci_gate(findings: DataFrame, threshold: str = "critical", repos: DataFrame | None = None) -> DataFrame:
    """repo, findings at or above the threshold, and whether the gate fails.

    A threshold nobody knows ranks 0 and so counts every finding. ``repos`` adds
    repositories without findings.
    """
    floor = rules.SEVERITY_RANK.get(threshold, 0)
    gate = findings.groupBy("repo").agg(
        F.count_if(C.severity_rank(F.col("severity")) >= floor).alias("findings")
    )
    if repos is not None:
        gate = repos.select("repo").distinct().join(gate, "repo", "left").na.fill(0, ["findings"])
    return gate.withColumn("failed", F.col("findings") > 0)


def external_summary(findings: DataFrame) -> DataFrame:
    """repo, source, findings: which scanners contributed."""
    return (
        findings.filter(F.col("phase") >= model.PHASE_TRIVY)
        .groupBy("repo", "source").agg(F.count("*").alias("findings"))
    )


def scan_metrics(files: DataFrame, stats: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of run counters per repository with files.

    ``stats`` is the result of ``graph_stats``; ``external_tools`` lists the scanners
    that contributed.
    """
    found = findings.groupBy("repo").agg(
        F.count_if(F.col("phase") < model.PHASE_TRIVY).alias("findings"),
        F.count_if(F.col("phase") >= model.PHASE_TRIVY).alias("external_findings"),
        *[
            F.bool_or(F.col("phase") == phase).alias(tool)
            for tool, phase in [("trivy", model.PHASE_TRIVY), ("semgrep", model.PHASE_SEMGREP)]
        ],
    )
    tools = F.concat_ws(
        ", ", *[F.when(F.col(t), F.lit(t)) for t in ("trivy", "semgrep")]
    ).alias("external_tools")
    languages = files.groupBy("repo").agg(F.count_distinct("language").alias("languages"))
    return (
        stats.join(languages, "repo", "left").join(found, "repo", "left")
        .na.fill(0, ["findings", "external_findings"])
        .select(
            "repo", "files", "languages", "nodes", "edges", "resolved_calls",
            "findings", "external_findings", tools,
        )
    )
