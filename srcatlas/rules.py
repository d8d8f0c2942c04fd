"""Rule tables and small lookups, as data.

The values below are fixed: results only agree with other tools that use the
same catalogue if they are exactly these.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: languages, by file extension ---------------------------------
EXTENSIONS = {
    "python": [".py", ".pyw"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "go": [".go"],
    "sql": [".sql"],
    "yaml": [".yaml", ".yml"],
    "json": [".json"],
    "hcl": [".tf", ".tfvars", ".hcl"],
    "java": [".java"],
    "csharp": [".cs"],
    "rust": [".rs"],
    "php": [".php"],
}
LANGUAGES = [
    "python", "javascript", "typescript", "go", "java", "csharp", "rust", "php",
    "sql", "yaml", "json", "hcl", "dockerfile",
]
EXTRACTABLE = ["python", "javascript", "typescript", "go", "java", "csharp", "rust", "php"]

# ---- fixed values: directory names left out of a scan ---------------------------
IGNORED_DIRS = [
    ".git", "node_modules", "vendor", "__pycache__", ".venv", "venv", "dist", "build",
    ".next", ".cache", "target",
]

# ---- fixed values: severities, most severe first, with their rank ---------------
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}

# ---- fixed values: vulnerability classes ----------------------------------------
SECRET_CLASS = "hardcoded-secret"
SQL_CLASS = "sql-injection"
CLASSES = [
    "sql-injection", "command-injection", "ssrf", "xss", "hardcoded-secret",
    "path-traversal", "insecure-deserialization",
]

# ---- fixed values: dangerous calls ----------------------------------------------
# (language, names, class, severity, title, description); the place in the list is
# the definition ordinal.
_DB_EXEC = "Call to database execution function. Verify parameterized queries are used."
_DB_QUERY = "Call to database query function. Verify parameterized queries are used."
_OS_EXEC = "Call to OS command execution function."
_HTTP = "HTTP request function called. Verify URL is not user-controlled."
SINKS = [
    ("python", ["execute", "executemany", "raw"], "sql-injection", "high", "Potential SQL injection", _DB_EXEC),
    ("go", ["Exec", "Query", "QueryRow"], "sql-injection", "high", "Potential SQL injection", _DB_QUERY),
    ("javascript", ["query", "execute", "raw"], "sql-injection", "high", "Potential SQL injection", _DB_QUERY),
    ("python", ["popen", "system", "call", "check_output", "run"], "command-injection", "critical", "Potential command injection", _OS_EXEC),
    ("go", ["Command", "CommandContext"], "command-injection", "critical", "Potential command injection", "Call to exec.Command. Verify input is sanitized."),
    ("javascript", ["exec", "execSync", "spawn", "execFile"], "command-injection", "critical", "Potential command injection", "Call to child_process execution function."),
    ("python", ["get", "post", "put", "delete", "request", "urlopen"], "ssrf", "high", "Potential SSRF", _HTTP),
    ("go", ["Get", "Post", "Do", "NewRequest"], "ssrf", "high", "Potential SSRF", _HTTP),
    ("javascript", ["fetch", "get", "post", "request", "axios"], "ssrf", "high", "Potential SSRF", _HTTP),
    ("javascript", ["innerHTML", "outerHTML", "write", "writeln"], "xss", "high", "Potential XSS", "DOM manipulation with potentially unsanitized input."),
    ("go", ["Fprintf", "Fprintln"], "xss", "medium", "Potential XSS", "Writing to response writer. Verify output is escaped."),
    ("python", ["open"], "path-traversal", "medium", "Potential path traversal", "File open with potentially user-controlled path."),
    ("go", ["Open", "ReadFile", "WriteFile"], "path-traversal", "medium", "Potential path traversal", "File operation with potentially user-controlled path."),
    ("java", ["executeQuery", "executeUpdate", "execute", "prepareStatement"], "sql-injection", "high", "Potential SQL injection", "Call to JDBC execution function. Verify parameterized queries are used."),
    ("java", ["exec", "getRuntime"], "command-injection", "critical", "Potential command injection", "Call to Runtime.exec. Verify input is sanitized."),
    ("java", ["openConnection", "openStream"], "ssrf", "high", "Potential SSRF", "HTTP connection opened. Verify URL is not user-controlled."),
    ("java", ["write", "println"], "xss", "medium", "Potential XSS", "Writing to response. Verify output is escaped."),
    ("csharp", ["ExecuteNonQuery", "ExecuteReader", "ExecuteScalar"], "sql-injection", "high", "Potential SQL injection", "Call to ADO.NET execution function. Verify parameterized queries are used."),
    ("csharp", ["Start"], "command-injection", "critical", "Potential command injection", "Call to Process.Start. Verify input is sanitized."),
    ("csharp", ["GetAsync", "PostAsync", "SendAsync", "GetStringAsync"], "ssrf", "high", "Potential SSRF", _HTTP),
    ("rust", ["query", "execute"], "sql-injection", "high", "Potential SQL injection", _DB_EXEC),
    ("rust", ["Command", "spawn", "output"], "command-injection", "critical", "Potential command injection", "Call to process execution function. Verify input is sanitized."),
    ("rust", ["get", "post", "send"], "ssrf", "high", "Potential SSRF", _HTTP),
    ("php", ["mysql_query", "mysqli_query", "query", "exec", "prepare"], "sql-injection", "high", "Potential SQL injection", _DB_QUERY),
    ("php", ["exec", "system", "passthru", "shell_exec", "popen", "proc_open"], "command-injection", "critical", "Potential command injection", _OS_EXEC),
    ("php", ["file_get_contents", "curl_exec", "fopen"], "ssrf", "high", "Potential SSRF", "Function may make HTTP requests. Verify URL is not user-controlled."),
    ("php", ["echo", "print"], "xss", "high", "Potential XSS", "Output function called. Verify output is escaped with htmlspecialchars."),
    ("php", ["include", "require", "include_once", "require_once"], "path-traversal", "medium", "Potential path traversal / file inclusion", "File inclusion with potentially user-controlled path."),
    ("php", ["unserialize"], "insecure-deserialization", "critical", "Insecure deserialization", "unserialize() with untrusted data enables arbitrary object injection."),
    ("python", ["loads", "load"], "insecure-deserialization", "high", "Potential insecure deserialization", "Pickle/YAML load with potentially untrusted data."),
    ("java", ["readObject", "readUnshared"], "insecure-deserialization", "critical", "Insecure deserialization", "Java ObjectInputStream deserialization of untrusted data."),
    ("php", ["raw", "selectRaw", "whereRaw", "orderByRaw", "groupByRaw", "havingRaw"], "sql-injection", "high", "Laravel raw SQL query", "DB::raw() or raw query method bypasses Eloquent parameterization."),
    ("php", ["fromSub", "selectSub"], "sql-injection", "medium", "Laravel raw subquery", "Raw subquery may contain unsanitized input."),
    ("php", ["executeQuery", "executeStatement"], "sql-injection", "high", "Symfony/Doctrine raw query", "Doctrine DBAL direct query execution. Verify parameterized queries."),
]

# ---- fixed values: secrets in string literals -----------------------------------
# (pattern, title, severity, lower-case words of which one occurs wherever the pattern matches).
# Java regular expressions; the long s, the Kelvin sign and the explicit blank class
# keep the case folding and the blanks of RE2. The first pattern that matches wins.
_BLANK = r"[\t\n\f\r ]*"
_ASSIGN = _BLANK + "[:=]" + _BLANK + r"""['\"]"""
SECRETS = [
    (r"(?i)(pa[s\u017F][s\u017F]word|pa[s\u017F][s\u017F]wd|pwd)" + _ASSIGN + r"""[^'\"]{4,}""", "Hardcoded password", "high", ["password", "passwd", "pwd"]),
    (r"(?i)(api[_-]?[k\u212A]ey|api[k\u212A]ey)" + _ASSIGN + r"""[^'\"]{8,}""", "Hardcoded API key", "high", ["api_key", "api-key", "apikey"]),
    (r"(?i)([s\u017F]ecret|to[k\u212A]en)" + _ASSIGN + r"""[^'\"]{8,}""", "Hardcoded secret/token", "high", ["secret", "token"]),
    (r"(?i)(aw[s\u017F]_acce[s\u017F][s\u017F]_[k\u212A]ey_id|aw[s\u017F]_[s\u017F]ecret_acce[s\u017F][s\u017F]_[k\u212A]ey)" + _ASSIGN + r"""[^'\"]+""", "Hardcoded AWS credential", "critical", ["aws_access_key_id", "aws_secret_access_key"]),
    (r"AKIA[0-9A-Z]{16}", "AWS Access Key ID", "critical", ["akia"]),
    (r"(?i)-----BEGIN (R[s\u017F]A |EC |D[s\u017F]A )?PRIVATE [k\u212A]EY-----", "Private key in source", "critical", ["-----begin "]),
    (r"ghp_[0-9a-zA-Z]{36}", "GitHub personal access token", "critical", ["ghp_"]),
    (r"(?i)(connection_[s\u017F]tring|conn_[s\u017F]tr)" + _ASSIGN + r"""[^'\"]{10,}""", "Hardcoded connection string", "high", ["connection_string", "conn_str"]),
]
SECRET_DESCRIPTION = "Hardcoded secret detected in string literal."

# ---- fixed values: SQL text put together in a literal ---------------------------
SQL_PATTERN = r"(?i)([s\u017F]ELECT|IN[s\u017F]ERT|UPDATE|DELETE|DROP|ALTER|CREATE)[\t\n\f\r ]+"
CONCAT_MARKS = [" + ", "% ", ".format(", 'f"', "f'"]
CONCAT_TITLE = "SQL query built with string concatenation"
CONCAT_DESCRIPTION = (
    "SQL query appears to use string concatenation instead of parameterized queries."
)


def _table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A local relation: Catalyst folds filters and projections over it while planning."""
    return spark.createDataFrame(pa.table(columns))


def sink_rules(spark: SparkSession) -> DataFrame:
    """One row per definition and name: def_ordinal, language, name, class, severity, title, description."""
    rows = [
        (i, language, name, cls, severity, title, description)
        for i, (language, names, cls, severity, title, description) in enumerate(SINKS)
        for name in names
    ]
    cols = list(zip(*rows))
    fields = ["def_ordinal", "language", "name", "class", "severity", "title", "description"]
    return _table(
        spark,
        {f: pa.array(c, pa.int32() if f == "def_ordinal" else pa.string()) for f, c in zip(fields, cols)},
    )


def secret_rules(spark: SparkSession) -> DataFrame:
    """priority, pattern, title, severity; priority 1 is tried first."""
    return _table(
        spark,
        {
            "priority": pa.array(range(1, len(SECRETS) + 1), pa.int32()),
            "pattern": pa.array([r[0] for r in SECRETS]),
            "title": pa.array([r[1] for r in SECRETS]),
            "severity": pa.array([r[2] for r in SECRETS]),
        },
    )


def language_ext(spark: SparkSession) -> DataFrame:
    """ext, language."""
    rows = [(ext, language) for language, exts in EXTENSIONS.items() for ext in exts]
    return _table(spark, {"ext": pa.array([r[0] for r in rows]), "language": pa.array([r[1] for r in rows])})


def ignored_dir_names(overrides: dict[str, bool] | None = None) -> list[str]:
    """The default names with ``overrides`` merged over them; False re-admits a default."""
    merged = dict.fromkeys(IGNORED_DIRS, True) | (overrides or {})
    return [name for name, ignored in merged.items() if ignored]


def ignored_dirs(spark: SparkSession, overrides: dict[str, bool] | None = None) -> DataFrame:
    """name."""
    return _table(spark, {"name": pa.array(ignored_dir_names(overrides), pa.string())})


def severity_rank(spark: SparkSession) -> DataFrame:
    """severity, rank."""
    return _table(
        spark,
        {"severity": pa.array(list(SEVERITY_RANK)), "rank": pa.array(list(SEVERITY_RANK.values()), pa.int32())},
    )


def supported_languages(spark: SparkSession) -> DataFrame:
    """language, extractable (has element extraction), parseable (has a parse status)."""
    return _table(
        spark,
        {
            "language": pa.array(LANGUAGES), "extractable": pa.array([x in EXTRACTABLE for x in LANGUAGES]),
            "parseable": pa.array([True] * len(LANGUAGES)),
        },
    )
