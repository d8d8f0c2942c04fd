"""Findings from code elements: dangerous calls, secrets, SQL put together in a literal.

Calls meet a small rule table, literals are looked at one by one: two passes over
``elements``, each reading the rows of its kind only, and no shuffle. ``scan_findings`` is a bag: one literal may give a secret and
an SQL finding. ``scan_in_one_pass`` gives the same from elements that are not stored and would be made twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas import model, rules
from srcatlas.functions import columns as C
from srcatlas.operators.graph import node_id


def _finding(elements: DataFrame, **values: Column) -> DataFrame:
    defaults = {
        "file": F.col("path"),
        "node_id": node_id(),
        "source": F.lit("code"),
        "position": F.lit(0).cast("bigint"),
        "def_ordinal": F.lit(0),
    }
    values = {**defaults, **values}
    names = model.FINDING_COLUMNS + model.ORDER_COLUMNS
    return elements.select(*[values.get(n, F.col(n)).alias(n) for n in names])


def match_sinks(
    elements: DataFrame, sink_rules: DataFrame | None = None, focus: list[str] | None = None
) -> DataFrame:
    """Calls whose language and exact name are a sink: one finding per matching definition."""
    calls = elements.filter(F.col("kind") == "call").select(
        "repo", "path", "language", "kind", "ordinal", "name", *model.POSITION_COLUMNS
    )
    if sink_rules is None:
        table = rules.sink_rules(elements.sparkSession)
        # The built-in table has a fixed size of about a hundred rows.
        table = F.broadcast(table if focus is None else table.filter(F.col("class").isin(focus)))
    else:
        # A caller's table may have any size: the optimiser decides from its statistics.
        table = sink_rules if focus is None else sink_rules.filter(F.col("class").isin(focus))
    hits = calls.join(table, ["language", "name"], "inner")
    return _finding(hits, phase=F.lit(model.PHASE_SINK), def_ordinal=F.col("def_ordinal"))


def _strings(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("kind") == "string").select(
        "repo", "path", "language", "kind", "ordinal", "name", *model.POSITION_COLUMNS
    )


def _match_strings(elements: DataFrame, secrets: list[tuple] | None, concat: bool) -> DataFrame:
    """Findings in string literals, all of a literal's from one look at it.

    ``secrets`` None leaves the secret check out, ``concat`` False the SQL one.
    """
    text = F.col("name")
    hits = _strings(elements)
    found = []  # an array entry per check: null, or what the check says

    def entry(when: Column, phase: int, cls: str, severity: Column, title: Column, description: str) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(phase).alias("phase"), F.lit(cls).alias("class"), severity.alias("severity"),
                title.alias("title"), F.lit(description).alias("description"),
            ),
        )

    if secrets is not None:
        hits = hits.withColumn("priority", C.secret_priority(text, secrets))
        priority = F.col("priority")
        title, severity = (
            F.element_at(F.array(*[F.lit(rule[field]) for rule in secrets]), priority) for field in (1, 2)
        )
        found.append(
            entry(priority.isNotNull(), model.PHASE_SECRET, rules.SECRET_CLASS, severity, title, rules.SECRET_DESCRIPTION)
        )
    if concat:
        found.append(
            entry(
                C.is_sql_concat(text), model.PHASE_CONCAT, rules.SQL_CLASS, F.lit("high"),
                F.lit(rules.CONCAT_TITLE), rules.CONCAT_DESCRIPTION,
            )
        )
    hits = hits.withColumn("found", F.explode(F.array_compact(F.array(*found))))
    values = {c: F.col(f"found.{c}") for c in ("phase", "class", "severity", "title", "description")}
    return _finding(hits, **values)


def match_secrets(elements: DataFrame, secrets: list[tuple] | None = None) -> DataFrame:
    """String literals that a secret rule matches; the first rule wins.

    ``secrets``: (pattern, title, severity, words), in order of priority; of the words, in
    lower case, one has to occur wherever the pattern matches. No words: always tried.
    """
    return _match_strings(elements, secrets or rules.SECRETS, concat=False)


def match_sql_concat(elements: DataFrame) -> DataFrame:
    """String literals that look like SQL built by concatenation or formatting."""
    return _match_strings(elements, None, concat=True)


def scan_findings(
    elements: DataFrame,
    focus: list[str] | None = None,
    sink_rules: DataFrame | None = None,
    secrets: list[tuple] | None = None,
) -> DataFrame:
    """All checks, or with ``focus`` those of the named classes only.

    A class nobody knows matches nothing. ``None`` and an empty list mean all.
    A check that cannot contribute is not planned at all.
    """
    focus = list(focus) if focus else None
    branches = []
    if focus is None or set(focus) - {rules.SECRET_CLASS}:
        branches.append(match_sinks(elements, sink_rules, focus))
    want_secrets = focus is None or rules.SECRET_CLASS in focus
    want_concat = focus is None or rules.SQL_CLASS in focus
    if want_secrets or want_concat:
        secrets = (secrets or rules.SECRETS) if want_secrets else None
        branches.append(_match_strings(elements, secrets, want_concat))
    return reduce(DataFrame.unionByName, branches)


def scan_in_one_pass(elements: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """``scan_findings`` with the built-in rules, reading ``elements`` once: for streams and other lazy input."""
    focus = list(focus) if focus else None
    text, is_string = F.col("name"), F.col("kind") == "string"
    fields = ["phase", "class", "severity", "title", "description", "def_ordinal"]
    table = rules.sink_rules(elements.sparkSession).withColumn("phase", F.lit(model.PHASE_SINK))
    if focus is not None:
        table = table.filter(F.col("class").isin(focus))
    sinks = table.groupBy("language", "name").agg(F.collect_list(F.struct(*fields)).alias("sinks")).withColumn("kind", F.lit("call"))
    rows = elements.filter(F.col("kind").isin("call", "string")).select(
        "repo", "path", "language", "kind", "ordinal", "name", *model.POSITION_COLUMNS
    )
    hits = rows.join(F.broadcast(sinks), ["language", "name", "kind"], "left")  # about a hundred rows
    hits = hits.withColumn("priority", F.when(is_string, C.secret_priority(text, rules.SECRETS)))
    title, severity = (F.element_at(F.array(*[F.lit(rule[i]) for rule in rules.SECRETS]), F.col("priority")) for i in (1, 2))

    def entry(when: Column, wanted: str, *values: Column) -> Column:
        if focus is not None and wanted not in focus:
            when = F.lit(False)
        return F.when(when, F.struct(*[v.alias(f) for v, f in zip(values, fields)]))

    secret = entry(F.col("priority").isNotNull(), rules.SECRET_CLASS, F.lit(model.PHASE_SECRET), F.lit(rules.SECRET_CLASS), severity, title,
                   F.lit(rules.SECRET_DESCRIPTION), F.lit(0))
    concat = entry(is_string & C.is_sql_concat(text), rules.SQL_CLASS, F.lit(model.PHASE_CONCAT), F.lit(rules.SQL_CLASS), F.lit("high"),
                   F.lit(rules.CONCAT_TITLE), F.lit(rules.CONCAT_DESCRIPTION), F.lit(0))
    none = F.array().cast("array<struct<phase:int,class:string,severity:string,title:string,description:string,def_ordinal:int>>")
    found = F.concat(F.coalesce("sinks", none), F.array_compact(F.array(secret, concat)))
    hits = hits.withColumn("found", F.explode(found))
    return _finding(hits, **{f: F.col(f"found.{f}") for f in fields})


def merge_external(findings: DataFrame, *external: DataFrame) -> DataFrame:
    """Append scanner findings; their phase puts them after the internal ones."""
    return reduce(DataFrame.unionByName, external, findings)


def filter_by_severity(findings: DataFrame, minimum: str) -> DataFrame:
    """Findings at or above ``minimum``; unknown severities rank 0 on either side."""
    floor = rules.SEVERITY_RANK.get(minimum, 0)
    return findings.filter(C.severity_rank(F.col("severity")) >= floor)
