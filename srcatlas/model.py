"""Schemas of the tables that the operators exchange.

Every table carries ``repo``; one repository is one value of it. Rows and
columns are 0-based, columns are byte offsets in the line. Missing values are
``''`` or 0, never null.
"""

SOURCE_FILES = "repo string, path string, language string, size bigint, content binary"

ELEMENTS = (
    "repo string, path string, language string, kind string, ordinal int, node_type string, "
    "name string, start_row int, start_col int, end_row int, end_col int"
)

NODES = (
    "repo string, node_id string, kind string, name string, file string, language string, "
    "start_row int, start_col int, end_row int, end_col int"
)

EDGES = "repo string, src string, dst string, kind string"

# What a finding means.
FINDING_COLUMNS = [
    "repo", "class", "severity", "title", "description", "file", "start_row", "start_col",
    "end_row", "end_col", "language", "node_id", "source",
]
# Where a finding stands in its repository's report (see operators.numbering).
ORDER_COLUMNS = ["phase", "position", "def_ordinal"]

POSITION_COLUMNS = ["start_row", "start_col", "end_row", "end_col"]

# Report phases, in report order.
PHASE_SINK, PHASE_SECRET, PHASE_CONCAT, PHASE_TRIVY, PHASE_SEMGREP = range(5)
