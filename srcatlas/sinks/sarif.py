"""SARIF 2.1.0."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas import __version__
from srcatlas.functions import columns as C
from srcatlas.sinks import documents as D

# Fixed values.
SCHEMA_URI = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"


def sarif_results(numbered: DataFrame) -> DataFrame:
    """One row per finding: repo, repo_findings, seq, result (struct)."""
    region = F.struct(
        (F.col("start_row") + 1).alias("startLine"), (F.col("start_col") + 1).alias("startColumn"),
        (F.col("end_row") + 1).alias("endLine"), (F.col("end_col") + 1).alias("endColumn"),
    )
    place = F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region"))
    return numbered.select(
        "repo", "repo_findings", "seq",
        F.struct(
            F.col("class").alias("ruleId"),
            C.sarif_level(F.col("severity")).alias("level"),
            F.struct(F.concat("title", F.lit(": "), "description").alias("text")).alias("message"),
            F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        ).alias("result"),
    )


def sarif_rules(numbered: DataFrame) -> DataFrame:
    """One row per repository and class: its first finding gives title and level."""
    first = F.min_by(F.struct("title", "severity"), "seq").alias("first")
    return (
        numbered.groupBy("repo", "class")
        .agg(first, F.min("seq").alias("seq"), F.max("repo_findings").alias("repo_findings"))
        .select(
            "repo", "repo_findings", "seq",
            F.struct(
                F.col("class").alias("id"), F.col("class").alias("name"),
                F.struct(F.col("first.title").alias("text")).alias("shortDescription"),
                F.struct(C.sarif_level(F.col("first.severity")).alias("level")).alias("defaultConfiguration"),
            ).alias("rule"),
        )
    )


def sarif_documents(
    numbered: DataFrame,
    repos: DataFrame | None = None,
    tool: str = "srcatlas",
    version: str = __version__,
    information_uri: str = "",
) -> DataFrame:
    """repo, section, seq, text: the SARIF document of each repository."""
    head = (
        f'{{"$schema":{json.dumps(SCHEMA_URI)},"version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{'
        f'"name":{json.dumps(tool)},"version":{json.dumps(version)},'
        f'"informationUri":{json.dumps(information_uri)},"rules":['
    )
    # The first finding is the first of its class, so it starts both lists.
    comma = F.when(F.col("seq") > 1, ",").otherwise("")
    totals = D.with_totals(numbered, repos)
    zero = F.lit(0)
    return D.documents(
        D.pieces(totals, D.HEAD, zero, F.lit(head)),
        D.pieces(sarif_rules(numbered), D.RULES, F.col("seq"), F.concat(comma, F.to_json("rule"))),
        D.pieces(totals, D.FINDINGS, zero, F.lit(']}},"results":[')),
        D.pieces(sarif_results(numbered), D.FINDINGS, F.col("seq"), F.concat(comma, F.to_json("result"))),
        D.pieces(totals, D.FOOT, zero, F.lit("]}]}")),
    )


def write_sarif(numbered: DataFrame, path: str, repos: DataFrame | None = None, mode: str = "error", **options) -> None:
    D.write_documents(sarif_documents(numbered, repos, **options), path, mode)
