"""Column expressions: language, severity, secret and SQL tests, scanner mappings, escapes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcatlas import rules


def _lookup(key: Column, table: dict) -> Column:
    pairs = ", ".join(repr(x) for kv in table.items() for x in kv)
    return F.element_at(F.expr(f"map({pairs})"), key)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def detect_language(path: Column) -> Column:
    """Language of a path from its base name, ``unknown`` if none fits."""
    base = base_name(path)
    by_ext = {ext: language for language, exts in rules.EXTENSIONS.items() for ext in exts}
    ext = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    return (
        F.when((base == "Dockerfile") | base.startswith("Dockerfile."), F.lit("dockerfile"))
        .otherwise(F.coalesce(_lookup(ext, by_ext), F.lit("unknown")))
    )


def severity_rank(severity: Column) -> Column:
    """Rank of a severity; an unknown one ranks 0."""
    return F.coalesce(_lookup(severity, rules.SEVERITY_RANK), F.lit(0))


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("critical", "high"), "error")
        .when(severity == "medium", "warning")
        .otherwise("note")
    )


def html_escape(text: Column) -> Column:
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def secret_priority(text: Column, secrets=None) -> Column:
    """1-based place of the first secret rule that matches, null if none does.

    The words a pattern needs are looked for first, in the text folded to lower
    case: that spares nearly all texts the regular expressions.
    """
    # The long s is a letter of its own to lower(), but an s to the patterns.
    folded = F.translate(F.lower(text), "\u017f", "s")

    def first_match(folded_text: Column) -> Column:
        chain = F
        for i, (pattern, _title, _severity, needs) in enumerate(secrets or rules.SECRETS, 1):
            hit = text.rlike(pattern)
            if needs:
                hit = _any(F.contains(folded_text, F.lit(n)) for n in needs) & hit
            chain = chain.when(hit, F.lit(i))
        return chain

    return _let(folded, first_match)


def is_sql_concat(text: Column) -> Column:
    """The literal holds an SQL verb and a sign of being put together at run time."""
    marks = _any(F.contains(text, F.lit(m)) for m in rules.CONCAT_MARKS)
    return marks & text.rlike(rules.SQL_PATTERN)


def trivy_severity(severity: Column) -> Column:
    upper = F.upper(severity)
    known = upper.isin("CRITICAL", "HIGH", "MEDIUM", "LOW")
    return F.when(known, F.lower(upper)).otherwise("info")


def semgrep_severity(severity: Column) -> Column:
    return F.coalesce(
        _lookup(F.upper(severity), {"ERROR": "high", "WARNING": "medium", "INFO": "low"}), F.lit("info")
    )


# Words in a rule id and the class they stand for; the first line with a hit wins.
SEMGREP_WORDS = [
    ("sql-injection", ["sql"]),
    ("command-injection", ["command", "exec", "subprocess", "shell"]),
    ("ssrf", ["ssrf"]),
    ("xss", ["xss"]),
    ("hardcoded-secret", ["secret", "password", "hardcoded"]),
    ("path-traversal", ["path", "traversal"]),
    ("insecure-deserialization", ["deseriali"]),
]


def semgrep_class(check_id: Column) -> Column:
    lower = F.lower(check_id)
    chain = F
    for cls, words in SEMGREP_WORDS:
        chain = chain.when(_any(F.contains(lower, F.lit(w)) for w in words), cls)
    return chain.otherwise(F.concat(F.lit("semgrep-"), check_id))
