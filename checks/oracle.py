"""What the registered queries must give, in DuckDB SQL over the given tables."""

from __future__ import annotations

from checks import inputs as I
from checks import templates


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _pick(values: list[str], index: str) -> str:
    return f"{_list(values)}[1 + ({index})]"


_KIND = """CASE WHEN event_type IN ('view', 'click') THEN 'call' WHEN event_type = 'signup' THEN 'function'
    WHEN event_type = 'purchase' THEN 'string' ELSE 'import' END"""

ELEMENTS = f"""
ev AS (SELECT *, event_id // 64 AS file_no, {_KIND} AS kind FROM events),
el0 AS (SELECT
    CASE WHEN file_no % 3 = 0 THEN 'mono' ELSE 'r' || (event_id // 1920) END AS repo,
    'src/m' || file_no || {_pick(I.EXTENSIONS, 'file_no % 8')} AS path,
    {_pick(templates.LANGUAGES, 'file_no % 8')} AS language, kind,
    (event_id % 64)::INTEGER AS ordinal, '' AS node_type,
    CASE WHEN kind = 'string' THEN {_pick(I.LITERALS, f'event_id % {len(I.LITERALS)}')}
         WHEN kind = 'import' THEN 'pkg.mod_' || (user_id % 50)
         WHEN (kind = 'function' AND user_id % 10 = 0) OR (kind = 'call' AND event_id % 40 = 39) THEN 'main_' || (event_id // 1920)
         WHEN kind = 'call' AND user_id % 2 = 0 THEN {_pick(I.CALL_NAMES, f'event_id % {len(I.CALL_NAMES)}')}
         ELSE 'fn_' || (event_id // 16) END AS name,
    (user_id % 200)::INTEGER AS start_row, (event_id % 40)::INTEGER AS start_col
  FROM ev),
el AS (SELECT *, start_row AS end_row, (start_col + length(name))::INTEGER AS end_col FROM el0)"""

FILES = "fi AS (SELECT DISTINCT repo, path, language FROM el)"

_NODE_ID = """CASE kind WHEN 'function' THEN 'func:' || path || ':' || name || ':' || ordinal
    WHEN 'string' THEN 'str:' || path || ':' || ordinal
    ELSE kind || ':' || path || ':' || name || ':' || ordinal END"""

NODES = f"""
nid AS (SELECT *, {_NODE_ID} AS node_id FROM el),
no AS (
  SELECT repo, 'file:' || path AS node_id, 'file' AS kind, path AS name, path AS file, language,
         0 AS start_row, 0 AS start_col, 0 AS end_row, 0 AS end_col FROM fi
  UNION ALL
  SELECT repo, node_id, kind, name, path, language, start_row, start_col, end_row, end_col FROM nid)"""

EDGES = """
ed AS (
  SELECT repo, CASE WHEN kind = 'import' THEN 'file:' || path ELSE node_id END AS src,
         CASE WHEN kind = 'import' THEN node_id ELSE 'file:' || path END AS dst,
         CASE kind WHEN 'import' THEN 'imports' WHEN 'function' THEN 'defined_in' ELSE 'contains' END AS kind
  FROM nid
  UNION ALL
  SELECT c.repo, c.node_id, f.node_id, 'calls' FROM nid c JOIN nid f
  ON c.repo = f.repo AND c.language = f.language AND c.name = f.name
  WHERE c.kind = 'call' AND f.kind = 'function')"""

# ---- fixed values, typed out here so that a wrong row in the package does not pass ----
# Dangerous calls: language, names, class, severity, title, description.
SINK_VALUES = [
    ("python", ["execute", "executemany", "raw"], "sql-injection", "high", "Potential SQL injection", "Call to database execution function. Verify parameterized queries are used."),
    ("go", ["Exec", "Query", "QueryRow"], "sql-injection", "high", "Potential SQL injection", "Call to database query function. Verify parameterized queries are used."),
    ("javascript", ["query", "execute", "raw"], "sql-injection", "high", "Potential SQL injection", "Call to database query function. Verify parameterized queries are used."),
    ("python", ["popen", "system", "call", "check_output", "run"], "command-injection", "critical", "Potential command injection", "Call to OS command execution function."),
    ("go", ["Command", "CommandContext"], "command-injection", "critical", "Potential command injection", "Call to exec.Command. Verify input is sanitized."),
    ("javascript", ["exec", "execSync", "spawn", "execFile"], "command-injection", "critical", "Potential command injection", "Call to child_process execution function."),
    ("python", ["get", "post", "put", "delete", "request", "urlopen"], "ssrf", "high", "Potential SSRF", "HTTP request function called. Verify URL is not user-controlled."),
    ("go", ["Get", "Post", "Do", "NewRequest"], "ssrf", "high", "Potential SSRF", "HTTP request function called. Verify URL is not user-controlled."),
    ("javascript", ["fetch", "get", "post", "request", "axios"], "ssrf", "high", "Potential SSRF", "HTTP request function called. Verify URL is not user-controlled."),
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
    ("csharp", ["GetAsync", "PostAsync", "SendAsync", "GetStringAsync"], "ssrf", "high", "Potential SSRF", "HTTP request function called. Verify URL is not user-controlled."),
    ("rust", ["query", "execute"], "sql-injection", "high", "Potential SQL injection", "Call to database execution function. Verify parameterized queries are used."),
    ("rust", ["Command", "spawn", "output"], "command-injection", "critical", "Potential command injection", "Call to process execution function. Verify input is sanitized."),
    ("rust", ["get", "post", "send"], "ssrf", "high", "Potential SSRF", "HTTP request function called. Verify URL is not user-controlled."),
    ("php", ["mysql_query", "mysqli_query", "query", "exec", "prepare"], "sql-injection", "high", "Potential SQL injection", "Call to database query function. Verify parameterized queries are used."),
    ("php", ["exec", "system", "passthru", "shell_exec", "popen", "proc_open"], "command-injection", "critical", "Potential command injection", "Call to OS command execution function."),
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
# Title and severity of the secret rules, in their order.
SECRET_VALUES = [
    ("Hardcoded password", "high"),
    ("Hardcoded API key", "high"),
    ("Hardcoded secret/token", "high"),
    ("Hardcoded AWS credential", "critical"),
    ("AWS Access Key ID", "critical"),
    ("Private key in source", "critical"),
    ("GitHub personal access token", "critical"),
    ("Hardcoded connection string", "high"),
]
# Languages by file extension.
EXTENSION_VALUES = {
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
LANGUAGE_VALUES = ["python", "javascript", "typescript", "go", "java", "csharp", "rust", "php", "sql", "yaml", "json", "hcl", "dockerfile"]
# Directory names left out of a scan.
IGNORED_VALUES = [".git", "node_modules", "vendor", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".cache", "target"]

_SINK_ROWS = ",\n".join(
    f"({i}, {_q(lang)}, {_q(name)}, {_q(cls)}, {_q(sev)}, {_q(title)}, {_q(desc)})"
    for i, (lang, names, cls, sev, title, desc) in enumerate(SINK_VALUES)
    for name in names
)
SINKS = f"si(def_ordinal, language, name, class, severity, title, description) AS (VALUES {_SINK_ROWS})"

# The rules as written for RE2, whose classes and case folding are the measure.
SECRET_PATTERNS = [
    r"""(?i)(password|passwd|pwd)\s*[:=]\s*['\"][^'\"]{4,}""",
    r"""(?i)(api[_-]?key|apikey)\s*[:=]\s*['\"][^'\"]{8,}""",
    r"""(?i)(secret|token)\s*[:=]\s*['\"][^'\"]{8,}""",
    r"""(?i)(aws_access_key_id|aws_secret_access_key)\s*[:=]\s*['\"][^'\"]+""",
    r"""AKIA[0-9A-Z]{16}""",
    r"""(?i)-----BEGIN (RSA |EC |DSA )?PRIVATE KEY-----""",
    r"""ghp_[0-9a-zA-Z]{36}""",
    r"""(?i)(connection_string|conn_str)\s*[:=]\s*['\"][^'\"]{10,}""",
]
_SECRET_NO = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(name, {_q(p)}) THEN {i}" for i, p in enumerate(SECRET_PATTERNS, 1))
    + " END"
)
_IS_CONCAT = (
    r"regexp_matches(name, '(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE)\s+') AND ("
    + " OR ".join(f"contains(name, {_q(m)})" for m in [" + ", "% ", ".format(", 'f"', "f'"])
    + ")"
)
_TITLES = [r[0] for r in SECRET_VALUES]
_SEVERITIES = [r[1] for r in SECRET_VALUES]

_AT = "path AS file, start_row, start_col, end_row, end_col, language, node_id, 'code' AS source"


def _findings(nodes: str) -> str:
    return f"""
f_sink AS (SELECT n.repo, s.class, s.severity, s.title, s.description, path AS file, start_row, start_col, end_row, end_col,
    n.language, node_id, 'code' AS source, 0 AS phase, 0::BIGINT AS position, s.def_ordinal
  FROM {nodes} n JOIN si s ON n.language = s.language AND n.name = s.name WHERE n.kind = 'call'),
sec AS (SELECT *, {_SECRET_NO} AS no FROM {nodes} WHERE kind = 'string'),
f_secret AS (SELECT repo, 'hardcoded-secret' AS class, {_list(_SEVERITIES)}[no] AS severity, {_list(_TITLES)}[no] AS title,
    'Hardcoded secret detected in string literal.' AS description, {_AT}, 1 AS phase, 0::BIGINT AS position, 0 AS def_ordinal
  FROM sec WHERE no IS NOT NULL),
f_concat AS (SELECT repo, 'sql-injection' AS class, 'high' AS severity, 'SQL query built with string concatenation' AS title,
    'SQL query appears to use string concatenation instead of parameterized queries.' AS description,
    {_AT}, 2 AS phase, 0::BIGINT AS position, 0 AS def_ordinal
  FROM {nodes} WHERE kind = 'string' AND {_IS_CONCAT}),
fd AS (SELECT * FROM f_sink UNION ALL SELECT * FROM f_secret UNION ALL SELECT * FROM f_concat)"""


FINDINGS = f"""nid AS (SELECT *, {_NODE_ID} AS node_id FROM el),
{SINKS},{_findings('nid')}"""

_DOCS = f"""
dl AS (SELECT source AS repo, 'd' || doc_id || '.py' AS path, 'python' AS language, 'string' AS kind,
    '"' || text || ' " ' || {_pick(I.LITERALS, f'doc_id % {len(I.LITERALS)}')} AS name,
    'str:d' || doc_id || '.py:0' AS node_id, 0 AS start_row, 0 AS start_col, 0 AS end_row, 0 AS end_col FROM documents)"""

_EXTERNAL = f"""
tv AS (SELECT p_partkey, 'r' || (p_partkey % 6) AS repo, p_brand || '.lock' AS file, n, p_name, p_size, p_type,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE {_pick(I.TRIVY_SEVERITIES, '(p_partkey + n) % 5')} END AS sev
  FROM part, (VALUES (0), (1)) v(n) WHERE p_partkey % 17 > 3),
f_trivy AS (SELECT repo, 'sca-' || lower(sev) AS class,
    CASE WHEN upper(sev) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN lower(sev) ELSE 'info' END AS severity,
    '[Trivy] CVE-' || p_partkey || '-' || n || ' in ' || p_name || '@' || p_size AS title, p_type AS description, file,
    0 AS start_row, 0 AS start_col, 0 AS end_row, 0 AS end_col, '' AS language, '' AS node_id, 'trivy' AS source,
    3 AS phase, n::BIGINT AS position, 0 AS def_ordinal FROM tv),
sg AS (SELECT *, {_pick(I.CHECK_IDS, f'c_custkey % {len(I.CHECK_IDS)}')} AS id FROM customer WHERE c_custkey % 19 <> 0),
f_semgrep AS (SELECT 'r' || (c_custkey % 6) AS repo,
    CASE WHEN contains(lower(id), 'sql') THEN 'sql-injection' WHEN regexp_matches(lower(id), 'command|exec|subprocess|shell') THEN 'command-injection'
      WHEN contains(lower(id), 'ssrf') THEN 'ssrf' WHEN contains(lower(id), 'xss') THEN 'xss'
      WHEN regexp_matches(lower(id), 'secret|password|hardcoded') THEN 'hardcoded-secret'
      WHEN regexp_matches(lower(id), 'path|traversal') THEN 'path-traversal'
      WHEN contains(lower(id), 'deseriali') THEN 'insecure-deserialization' ELSE 'semgrep-' || id END AS class,
    ['high', 'medium', 'low', 'info'][1 + c_custkey % 4] AS severity, '[Semgrep] ' || id AS title, c_name AS description,
    lower(c_mktsegment) || '.py' AS file,
    CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_nationkey END::INTEGER AS start_row,
    CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE 5 END::INTEGER AS start_col,
    (c_nationkey + 2)::INTEGER AS end_row, 7 AS end_col, '' AS language, '' AS node_id, 'semgrep' AS source,
    4 AS phase, 0::BIGINT AS position, 0 AS def_ordinal FROM sg)"""

MERGED_ONLY = f"""{_EXTERNAL},
me AS (SELECT * FROM fd UNION ALL SELECT * FROM f_trivy UNION ALL SELECT * FROM f_semgrep)"""
MERGED = f"{FINDINGS},{MERGED_ONLY}"

_ORDER = "phase, position, file, start_row, start_col, node_id, def_ordinal, end_row, end_col, class, title, description"


def _numbered(source: str) -> str:
    return f"""
nu0 AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER})::BIGINT AS seq,
    count(*) OVER (PARTITION BY repo)::BIGINT AS repo_findings FROM {source}),
nu AS (SELECT *, CASE WHEN phase > 2 THEN '' ELSE 'F-' || CASE WHEN seq < 1000 THEN lpad(seq::VARCHAR, 4, '0') ELSE seq::VARCHAR END END AS finding_id FROM nu0)"""


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_LEVEL = "CASE WHEN {0} IN ('critical', 'high') THEN 'error' WHEN {0} = 'medium' THEN 'warning' ELSE 'note' END"

_EXT_CASES = " ".join(
    f"WHEN ext IN ({', '.join(map(_q, exts))}) THEN {_q(language)}" for language, exts in EXTENSION_VALUES.items()
)
PATHS = f"""
pa0 AS (SELECT 'r' || (l_suppkey % 20) AS repo,
    {_pick(I.DIRS, f'l_suppkey % {len(I.DIRS)}')} || '/d' || (l_partkey % 50) || '/' ||
    {_pick(I.BASES, f'(l_orderkey + l_linenumber) % {len(I.BASES)}')} AS path, l_orderkey AS size FROM lineitem),
pa1 AS (SELECT *, split_part(path, '/', -1) AS base, string_split(path, '/') AS parts FROM pa0),
pa2 AS (SELECT *, lower(regexp_extract(base, '(\\.[^.]*)$', 1)) AS ext FROM pa1),
pa AS (SELECT repo, path, size, parts, ext, CASE WHEN base = 'Dockerfile' OR starts_with(base, 'Dockerfile.') THEN 'dockerfile'
    {_EXT_CASES} ELSE 'unknown' END AS language FROM pa2)"""


def _kept(names: list[str]) -> str:
    return f"NOT list_has_any(parts[1:len(parts) - 1], {_list(names)})"


_DEFAULT_DIRS = IGNORED_VALUES
_CHANGED_DIRS = [d for d in IGNORED_VALUES if d != "build"] + ["deploy"]


def _templated() -> str:
    rows = []
    for language in templates.LANGUAGES:
        for kind, ordinal, name, row, col, keys in templates.expected(language):
            rows.append(f"({_q(language)}, {_q(kind)}, {ordinal}, {_q(name)}, {row}, {col}, {keys})")
    return f"""
te(language, kind, ordinal, mark, start_row, col, keys) AS (VALUES {', '.join(rows)}),
tf AS (SELECT 'r' || (o_custkey % 9) AS repo, o_orderkey::VARCHAR AS key,
    'o/' || o_orderkey || {_pick(I.EXTENSIONS, 'o_orderkey % 8')} AS path,
    {_pick(templates.LANGUAGES, 'o_orderkey % 8')} AS language FROM orders),
tx AS (SELECT repo, path, t.language, kind, ordinal, replace(mark, '~', key) AS name, start_row,
    (col + keys * length(key))::INTEGER AS start_col, start_row AS end_row,
    (col + keys * length(key) + strlen(replace(mark, '~', key)))::INTEGER AS end_col
  FROM te t JOIN tf ON t.language = tf.language)"""


_RULE_JSON = f"""to_json({{'id': class, 'name': class, 'shortDescription': {{'text': title}},
    'defaultConfiguration': {{'level': {_LEVEL.format('severity')}}}}})::VARCHAR"""
_RESULT_JSON = f"""to_json({{'ruleId': class, 'level': {_LEVEL.format('severity')}, 'message': {{'text': title || ': ' || description}},
    'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': file}}, 'region': {{'startLine': start_row + 1,
    'startColumn': start_col + 1, 'endLine': end_row + 1, 'endColumn': end_col + 1}}}}}}]}})::VARCHAR"""
_RULES = f"""
ru AS (SELECT repo, seq, repo_findings, {_RULE_JSON} AS rule FROM
  (SELECT *, row_number() OVER (PARTITION BY repo, class ORDER BY seq) AS first FROM nu) WHERE first = 1)"""
_NUMBERED = f"WITH {ELEMENTS},{FINDINGS},{_numbered('fd')}"


def _totals(repos: str) -> str:
    return f"""
re AS ({repos}),
tot AS (SELECT re.repo, coalesce(max(repo_findings), 0)::BIGINT AS repo_findings FROM re LEFT JOIN nu ON nu.repo = re.repo GROUP BY re.repo)"""


_SOME_REPOS = "SELECT DISTINCT repo FROM (SELECT repo FROM el UNION ALL SELECT 'r' || n_nationkey FROM nation)"
_SARIF_HEAD = (
    '{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json",'
    '"version":"2.1.0","runs":[{"tool":{"driver":{"name":"srcatlas","version":"1.0","informationUri":"","rules":['
)
_NL = "chr(10)"
_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_SEVERITY_ROWS = f"sv AS (SELECT repo, severity, 4 - {_RANK} AS place, count(*) AS c FROM nu GROUP BY repo, severity)"
_PIECES = "SELECT repo, section, seq::BIGINT AS seq, text FROM pieces"

SARIF = f"""{_NUMBERED},{_RULES},{_totals("SELECT DISTINCT repo FROM (SELECT repo FROM el UNION ALL SELECT 'empty' || n_nationkey FROM nation)")},
pieces AS (
  SELECT repo, 0 AS section, 0 AS seq, {_q(_SARIF_HEAD)} AS text FROM tot
  UNION ALL SELECT repo, 1, seq, CASE WHEN seq > 1 THEN ',' ELSE '' END || rule FROM ru
  UNION ALL SELECT repo, 2, 0, ']}}}},"results":[' FROM tot
  UNION ALL SELECT repo, 2, seq, CASE WHEN seq > 1 THEN ',' ELSE '' END || {_RESULT_JSON} FROM nu
  UNION ALL SELECT repo, 3, 0, ']}}]}}' FROM tot)
{_PIECES}"""

JSON = f"""{_NUMBERED},{_totals(_SOME_REPOS)},
pieces AS (
  SELECT repo, 0 AS section, 0 AS seq, CASE WHEN repo_findings = 0 THEN 'null' ELSE '[' END AS text FROM tot
  UNION ALL SELECT repo, 2, seq, CASE WHEN seq > 1 THEN ',' ELSE '' END || to_json({{'ID': finding_id, 'Class': class,
    'Severity': severity, 'Title': title, 'Description': description, 'File': file, 'StartRow': start_row, 'StartCol': start_col,
    'EndRow': end_row, 'EndCol': end_col, 'Language': language, 'NodeID': node_id}})::VARCHAR FROM nu
  UNION ALL SELECT repo, 3, 0, ']' FROM tot WHERE repo_findings > 0)
{_PIECES}"""

MARKDOWN = f"""{_NUMBERED},{_SEVERITY_ROWS},{_totals(_SOME_REPOS)},
pieces AS (
  SELECT repo, 0 AS section, 0 AS seq, '# Findings of this scan' || {_NL} || {_NL} || CASE WHEN repo_findings = 0
    THEN 'No vulnerabilities found.' ELSE repo_findings || ' in all, by severity:' || {_NL} || {_NL} || '| Severity | Count |' || {_NL} || '|---|---|' END AS text FROM tot
  UNION ALL SELECT repo, 1, place, '| ' || severity || ' | ' || c || ' |' FROM sv
  UNION ALL SELECT repo, 2, 0, {_NL} || '## One by one' || {_NL} FROM tot WHERE repo_findings > 0
  UNION ALL SELECT repo, 2, seq, '1. **' || finding_id || '** (' || severity || ', ' || class || ') ' || title || {_NL}
    || '   at `' || file || ':' || (start_row + 1) || ':' || (start_col + 1) || '`, language: ' || language || {_NL} || {_NL}
    || '   ' || description || {_NL} FROM nu)
{_PIECES}"""

_HTML_HEAD = """<!DOCTYPE html>
<html lang="en">
<meta charset="utf-8"><title>Findings</title>
<style>article{border-left:.3rem solid #888;margin:1rem 0;padding-left:1rem}table{border-collapse:collapse}td{padding:.2rem 1rem}</style>
<body><main>
<h1>"""
HTML = f"""{_NUMBERED},{_SEVERITY_ROWS},{_totals("SELECT DISTINCT repo FROM nu")},
pieces AS (
  SELECT repo, 0 AS section, 0 AS seq, {_q(_HTML_HEAD)} || repo_findings || ' findings</h1>' || {_NL} || '<table>' AS text FROM tot
  UNION ALL SELECT repo, 1, place, '<tr><td>' || severity || '</td><td>' || c || '</td></tr>' FROM sv
  UNION ALL SELECT repo, 2, 0, '</table>' FROM tot
  UNION ALL SELECT repo, 2, seq, '<article data-severity="' || severity || '"><h3>' || finding_id || ' ' || {_ESCAPED.format('title')}
    || '</h3><dl><dt>at</dt><dd><code>' || {_ESCAPED.format('file')} || ':' || (start_row + 1) || ':' || (start_col + 1)
    || '</code></dd><dt>class</dt><dd>' || class || '</dd><dt>severity</dt><dd>' || severity || '</dd><dt>language</dt><dd>' || language
    || '</dd></dl><p>' || {_ESCAPED.format('description')} || '</p></article>' FROM nu
  UNION ALL SELECT repo, 3, 0, '</main></body></html>' FROM tot)
{_PIECES}"""

_GRAPH = f"WITH {ELEMENTS},{FILES},{NODES},{EDGES}"
_REACH = f"WITH RECURSIVE {ELEMENTS},{FILES},{NODES},{EDGES},{SINKS}" + """,
reach(repo, start, node_id) AS (
  SELECT DISTINCT n.repo, n.node_id, n.node_id FROM nid n JOIN nid c ON c.repo = n.repo AND c.path = n.path
    JOIN si ON c.language = si.language AND c.name = si.name WHERE n.kind = 'call' AND c.kind = 'call' AND si.severity = 'critical'
  UNION
  SELECT r.repo, r.start, e.dst FROM reach r JOIN ed e ON e.repo = r.repo AND e.src = r.node_id
  WHERE e.kind IN ('calls', 'defined_in', 'imports'))
SELECT r.repo, r.start, r.node_id, no.kind FROM reach r JOIN no ON no.repo = r.repo AND no.node_id = r.node_id
WHERE r.node_id <> r.start"""

_STATS = """
st AS (SELECT repo, count(*) AS nodes, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'function') AS functions,
    count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'import') AS imports, count(*) FILTER (kind = 'string') AS strings
  FROM no GROUP BY repo),
es AS (SELECT repo, count(*) AS edges, count(*) FILTER (kind = 'calls') AS resolved_calls FROM ed GROUP BY repo),
gs AS (SELECT st.repo, nodes, edges, files, functions, calls, imports, strings, resolved_calls FROM st JOIN es ON st.repo = es.repo)"""

_CG = f"""WITH {ELEMENTS}, cg AS (SELECT c.repo, c.name AS from_name, c.path AS from_file, c.start_row + 1 AS from_line,
    f.name AS to_name, f.path AS to_file, f.start_row + 1 AS to_line
  FROM el c JOIN el f ON c.repo = f.repo AND c.language = f.language AND c.name = f.name
  WHERE c.kind = 'call' AND f.kind = 'function')"""
_EP = f"""WITH {ELEMENTS}, nid AS (SELECT *, {_NODE_ID} AS node_id FROM el),
ep AS (SELECT repo, name, path AS file, start_row + 1 AS line, node_id FROM nid f WHERE kind = 'function' AND NOT EXISTS (
  SELECT 1 FROM el c WHERE c.kind = 'call' AND c.repo = f.repo AND c.language = f.language AND c.name = f.name))"""
_NEIGHBOUR = """ SELECT repo, of, node_id, kind, name, file, language, start_row, start_col, end_row, end_col
    FROM (SELECT repo, {0} AS of, {1} AS node_id FROM ed WHERE kind = 'calls') x JOIN no USING (repo, node_id)"""

_STORED = """, ask AS (SELECT DISTINCT repo, node_id FROM no WHERE kind = '{0}' ORDER BY node_id, repo LIMIT 25)
    SELECT x.repo, x.{1} AS "of", x.{2} AS node_id, n.name, n.file AS path, n.start_row
    FROM ed x JOIN ask ON ask.repo = x.repo AND ask.node_id = x.{1} JOIN no n ON n.repo = x.repo AND n.node_id = x.{2} WHERE x.kind = 'calls'"""


_RUN_BASE = f"WITH {_templated()}, el AS (SELECT * FROM tx), fi AS (SELECT DISTINCT repo, path, language FROM tf)"
_RUN = f"{_RUN_BASE}, nid AS (SELECT *, {_NODE_ID} AS node_id FROM el), {FINDINGS.split('FROM el),', 1)[1]},{MERGED_ONLY},{_numbered('me')}"

_FILTERED_RUN = _RUN.replace("el AS (SELECT * FROM tx)", "el AS (SELECT * FROM tx WHERE language IN ('python', 'go'))").replace(
    "SELECT * FROM fd UNION ALL", "SELECT * FROM fd WHERE class IN ('sql-injection', 'xss') UNION ALL")


def statements() -> dict[str, str]:
    elements, findings = f"WITH {ELEMENTS}", f"WITH {ELEMENTS},{FINDINGS}"
    summary = f"""{_RUN_BASE}, k AS (SELECT repo, kind || 's' AS measure, count(*) AS value FROM el GROUP BY ALL),
            kinds AS (SELECT r.repo, v.measure, coalesce(k.value, 0) AS value FROM (SELECT DISTINCT repo FROM fi) r
              CROSS JOIN (VALUES ('functions'), ('calls'), ('imports'), ('strings')) v(measure) LEFT JOIN k ON k.repo = r.repo AND k.measure = v.measure),
            pairs AS (SELECT c.repo, sum(c.n * f.n)::BIGINT AS resolved FROM
              (SELECT repo, language, name, count(*) AS n FROM el WHERE kind = 'call' GROUP BY ALL) c JOIN
              (SELECT repo, language, name, count(*) AS n FROM el WHERE kind = 'function' GROUP BY ALL) f USING (repo, language, name) GROUP BY c.repo)
            SELECT repo, measure, value FROM kinds
            UNION ALL SELECT repo, 'files', count(*) FROM fi GROUP BY repo
            UNION ALL SELECT repo, 'language:' || language, count(*) FROM fi GROUP BY repo, language
            UNION ALL SELECT r.repo, 'resolved_calls', coalesce(resolved, 0) FROM (SELECT DISTINCT repo FROM fi) r LEFT JOIN pairs USING (repo)"""
    merged, paths = f"WITH {ELEMENTS},{MERGED}", f"WITH {PATHS}"
    columns = "repo, path, language, kind, ordinal, name, start_row, start_col, end_row, end_col"
    inventory = f"FROM pa WHERE language <> 'unknown' AND {_kept(_DEFAULT_DIRS)}"
    docs = f"WITH {_DOCS},{SINKS},{_findings("dl")}"
    templated = f"WITH {_templated()}"
    extracted = {
        f"extract_{kind}s": f"{templated} SELECT {columns} FROM tx WHERE kind = '{kind}'"
        for kind in ("function", "call", "import", "string")
    }
    return {
        "detect_language": f"{paths} SELECT path, language, count(*) AS n FROM pa GROUP BY path, language",
        "prune_dirs": f"{paths} SELECT repo, path, size FROM pa WHERE {_kept(_DEFAULT_DIRS)}",
        "filter_languages": f"{paths} SELECT repo, path, size, language {inventory} AND language IN ('python', 'go', 'cobol')",
        "scan_inventory": f"{paths} SELECT repo, path, size, language FROM pa WHERE language <> 'unknown' AND {_kept(_CHANGED_DIRS)}",
        "ignored_dirs": f"""{paths}, fo AS (SELECT unnest(parts) AS name FROM pa)
            SELECT d.name, (SELECT count(*) FROM fo WHERE fo.name = d.name) AS n FROM (SELECT unnest({_list(_CHANGED_DIRS)}) AS name) d""",
        "language_stats": f"{paths} SELECT repo, language, count(*) AS files {inventory} GROUP BY repo, language",
        "language_ext": f"""{paths}, ex(ext, language) AS (VALUES {', '.join(f'({_q(e)}, {_q(x)})' for x, es in EXTENSION_VALUES.items() for e in es)})
            SELECT ext, ex.language, (SELECT count(*) FROM pa WHERE pa.ext = ex.ext) AS n FROM ex""",
        "supported_languages": f"""{paths}, la AS (SELECT language, count(*) AS files {inventory} GROUP BY language)
            SELECT x.language, x.language IN ({', '.join(map(_q, templates.LANGUAGES))}) AS extractable, true AS parseable, coalesce(files, 0) AS files
            FROM (SELECT unnest({_list(LANGUAGE_VALUES)}) AS language) x LEFT JOIN la ON la.language = x.language""",
        "read_source_files": """WITH t AS (SELECT ['a', 'a/b/_c', 'node_modules/x', '.github', 'd/build'][1 + page_id % 5] AS dir,
              ['.py', '.js', '.txt', '.go'][1 + page_id % 4] AS ext, ['p', '__init__', '.p'][1 + page_id % 3] AS base, page_id, html FROM pages)
            SELECT 'web' AS repo, dir || '/' || page_id || '/' || base || ext AS path,
              CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'go' END AS language,
              strlen(html)::BIGINT AS size, md5(html) AS digest
            FROM t WHERE ext <> '.txt' AND dir NOT IN ('node_modules/x', 'd/build')""",
        **extracted,
        "extract_whole_documents": """WITH d AS (SELECT *, '\"\"\"' || text || chr(10) || '\"\"\"' AS lit FROM documents)
            SELECT source AS repo, 'd' || doc_id || '.py' AS path, 'python' AS language, 'function' AS kind, 0 AS ordinal,
              'identifier' AS node_type, md5('doc_' || doc_id) AS name, 0 AS start_row, 4 AS start_col, 0 AS end_row,
              (8 + length(doc_id::VARCHAR))::INTEGER AS end_col FROM d
            UNION ALL SELECT source, 'd' || doc_id || '.py', 'python', 'string', 0, 'string', md5(lit), 1, 11,
              (1 + length(lit) - length(replace(lit, chr(10), '')))::INTEGER, 3 FROM d""",
        "extract_page_scripts": r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1) AS js FROM pages),
            s AS (SELECT 'p' || page_id || '-' || (n - 1) || '.js' AS path, js[n] AS js FROM (SELECT *, unnest(generate_series(1, len(js))) AS n FROM a)),
            m AS (SELECT *, regexp_extract(js, '("[^"]*")', 1) AS lit FROM s)
            SELECT 'web' AS repo, path, 'javascript' AS language, 'call' AS kind, 0 AS ordinal,
              'identifier' AS node_type, 'track' AS name, 0 AS start_row, (strpos(js, 'track(') - 1)::INTEGER AS start_col, 0 AS end_row,
              (strpos(js, 'track(') + 4)::INTEGER AS end_col FROM m WHERE contains(js, 'track(')
            UNION ALL SELECT 'web', path, 'javascript', 'string', 0, 'string', lit, 0, (strpos(js, lit) - 1)::INTEGER, 0,
              (strpos(js, lit) - 1 + strlen(lit))::INTEGER FROM m WHERE lit <> ''""",
        "scan_run": f"""{_RUN} SELECT repo, seq, finding_id, class, severity, title, file, start_row, start_col, source FROM nu""",
        "scan_run_metrics": f"""{_RUN}, es AS (SELECT repo, count(*) AS elements FROM el GROUP BY repo),
            pairs AS (SELECT c.repo, sum(c.n * f.n)::BIGINT AS resolved FROM
              (SELECT repo, language, name, count(*) AS n FROM el WHERE kind = 'call' GROUP BY ALL) c JOIN
              (SELECT repo, language, name, count(*) AS n FROM el WHERE kind = 'function' GROUP BY ALL) f USING (repo, language, name) GROUP BY c.repo),
            fs AS (SELECT repo, count(*) AS files, count(DISTINCT language) AS languages FROM fi GROUP BY repo),
            mc AS (SELECT repo, count(*) FILTER (phase < 3) AS findings, count(*) FILTER (phase > 2) AS external_findings,
              bool_or(phase = 3) AS t, bool_or(phase = 4) AS s FROM me GROUP BY repo)
            SELECT fs.repo, files, languages, files + elements AS nodes, elements + coalesce(resolved, 0) AS edges, coalesce(resolved, 0)::BIGINT AS resolved_calls,
              coalesce(findings, 0) AS findings, coalesce(external_findings, 0) AS external_findings,
              CASE WHEN t AND s THEN 'trivy, semgrep' WHEN t THEN 'trivy' WHEN s THEN 'semgrep' ELSE '' END AS external_tools
            FROM fs JOIN es USING (repo) LEFT JOIN pairs USING (repo) LEFT JOIN mc USING (repo)""",
        "scan_run_filtered": f"""{_FILTERED_RUN} SELECT repo, seq, finding_id, class, severity, title, file, start_row, start_col, source FROM nu WHERE severity IN ('critical', 'high')""",
        "tree_listing": """WITH t AS (SELECT ['a', 'a/b/_c', 'node_modules/x', '.github', 'd/build'][1 + page_id % 5] AS dir, ['.py', '.js', '.txt', '.go'][1 + page_id % 4] AS ext FROM pages)
            SELECT 'web' AS repo, CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'go' END AS language, count(*) AS files
            FROM t WHERE ext <> '.txt' AND dir NOT IN ('node_modules/x', 'd/build') GROUP BY ALL""",
        "tree_info": summary,
        "stored_summary": summary,
        "parse_status": f"{templated} SELECT repo, path, language, language <> 'php' AND length(path) % 3 = 0 AS has_errors FROM tf",
        "sink_rules": f"{elements}, {SINKS} SELECT si.*, (SELECT count(*) FROM el WHERE kind = 'call' AND el.language = si.language AND el.name = si.name) AS calls FROM si",
        "secret_rules": f"""{findings}, sr AS (SELECT unnest(range(1, 9))::INTEGER AS priority)
            SELECT priority, {_list(_TITLES)}[priority] AS title, {_list(_SEVERITIES)}[priority] AS severity,
              (SELECT count(*) FROM sec WHERE no = priority) AS literals FROM sr""",
        "match_sinks": f"{findings} SELECT * FROM f_sink",
        "match_secrets": f"{findings} SELECT * FROM f_secret",
        "match_secrets_documents": f"{docs} SELECT * FROM f_secret",
        "match_sql_concat": f"{findings} SELECT * FROM f_concat",
        "match_sql_concat_documents": f"{docs} SELECT * FROM f_concat",
        "scan_findings": f"{findings} SELECT * FROM fd",
        "scan_findings_focused": f"{findings} SELECT * FROM fd WHERE class IN ('sql-injection', 'xss')",
        "filter_by_severity": f"{merged} SELECT * FROM me WHERE severity IN ('critical', 'high', 'medium')",
        "number_findings": f"{_NUMBERED} SELECT * FROM nu",
        "severity_summary": f"{merged} SELECT repo, severity, {_RANK} AS rank, count(*) AS findings FROM me GROUP BY repo, severity",
        "ci_gate": f"""{merged} SELECT repo, count(m.severity) AS findings, count(m.severity) > 0 AS failed
            FROM (SELECT DISTINCT repo FROM el) r LEFT JOIN (SELECT * FROM me WHERE severity IN ('critical', 'high')) m USING (repo) GROUP BY repo""",
        "ci_gate_unknown_threshold": f"{merged} SELECT repo, count(*) AS findings, true AS failed FROM me GROUP BY repo",
        "ingest_trivy": f"WITH {_EXTERNAL} SELECT * FROM f_trivy",
        "ingest_semgrep": f"WITH {_EXTERNAL} SELECT * FROM f_semgrep",
        "bad_reports": """SELECT 'trivy' AS tool, 'r' || (p_partkey % 6) AS repo, count(*) AS reports FROM part
            WHERE p_partkey % 17 IN (0, 1, 3) GROUP BY ALL
            UNION ALL SELECT 'semgrep', 'r' || (c_custkey % 6), count(*) FROM customer WHERE c_custkey % 19 = 0 GROUP BY ALL""",
        "merge_external": f"{merged},{_numbered('me')} SELECT repo, finding_id, class, severity, title, file, source, phase, position FROM nu",
        "external_summary": f"{merged} SELECT repo, source, count(*) AS findings FROM me WHERE phase > 2 GROUP BY repo, source",
        "build_nodes": f"{_GRAPH} SELECT * FROM no",
        "build_edges": f"{_GRAPH} SELECT * FROM ed",
        "resolve_calls": f"{_GRAPH} SELECT * FROM ed WHERE kind = 'calls'",
        "calls_from": _GRAPH + _NEIGHBOUR.format("src", "dst"),
        "callers_of": _GRAPH + _NEIGHBOUR.format("dst", "src"),
        "reachable": _REACH,
        "entry_points": f"{_EP} SELECT * FROM ep",
        "call_graph": f"{_CG} SELECT * FROM cg",
        "nodes_of_kind": f"{_GRAPH} SELECT * FROM no WHERE kind = 'import'",
        "functions_by_name": f"{_GRAPH} SELECT * FROM no WHERE kind = 'function' AND name = 'main_0'",
        "strings_containing": f"{_GRAPH} SELECT * FROM no WHERE kind = 'string' AND contains(name, '% v')",
        "strings_containing_patterns": f"""{_GRAPH}, ss AS (SELECT repo, node_id, name FROM no WHERE kind = 'string'),
            pt AS (SELECT DISTINCT unnest(['', substr(name, 3, 1), substr(name, 3, 2), substr(name, 4, 3), substr(name, 2, 9), name]) AS pattern FROM ss UNION SELECT n_name FROM nation)
            SELECT pattern, repo, node_id FROM pt JOIN ss ON contains(name, pattern)""",
        "stored_calls_from": _GRAPH + _STORED.format("call", "src", "dst"),
        "stored_callers_of": _GRAPH + _STORED.format("function", "dst", "src"),
        "graph_stats": f"{_GRAPH},{_STATS} SELECT * FROM gs",
        "repo_summary": f"""{_GRAPH},{_STATS}
            SELECT repo, measure, value FROM (UNPIVOT gs ON files, functions, calls, imports, strings, resolved_calls INTO NAME measure VALUE value)
            UNION ALL SELECT repo, 'language:' || language, count(*) FROM fi GROUP BY repo, language""",
        "call_graph_lines": f"{_CG} SELECT repo, from_name || ' (' || from_file || ':' || from_line || ') → ' || to_name || ' (' || to_file || ':' || to_line || ')' AS line FROM cg",
        "entry_point_lines": f"{_EP} SELECT repo, name || ' (' || file || ':' || line || ')' AS line FROM ep",
        "scan_metrics": f"""WITH {ELEMENTS},{FILES},{MERGED},{NODES.split('FROM el),', 1)[1]},{EDGES},{_STATS},
            mc AS (SELECT repo, count(*) FILTER (phase < 3) AS findings, count(*) FILTER (phase > 2) AS external_findings,
              bool_or(phase = 3) AS t, bool_or(phase = 4) AS s FROM me GROUP BY repo)
            SELECT gs.repo, files, (SELECT count(DISTINCT language) FROM fi WHERE fi.repo = gs.repo) AS languages, nodes, edges, resolved_calls,
              coalesce(findings, 0) AS findings, coalesce(external_findings, 0) AS external_findings,
              CASE WHEN t AND s THEN 'trivy, semgrep' WHEN t THEN 'trivy' WHEN s THEN 'semgrep' ELSE '' END AS external_tools
            FROM gs LEFT JOIN mc ON mc.repo = gs.repo""",
        "sarif_results": f"{_NUMBERED} SELECT repo, seq, {_RESULT_JSON} AS result FROM nu",
        "sarif_rules": f"{_NUMBERED},{_RULES} SELECT repo, seq, rule FROM ru",
        "write_sarif": SARIF,
        "write_findings_json": JSON,
        "write_markdown": MARKDOWN,
        "write_html": HTML,
        "html_escape": f"SELECT page_id, md5({_ESCAPED.format('html')}) AS digest FROM pages",
        "sarif_level": f"{merged} SELECT severity, {_LEVEL.format('severity')} AS level, count(*) AS findings FROM me GROUP BY severity",
    }
