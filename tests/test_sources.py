import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from srcatlas.plans import understand
from srcatlas.sources import scanner_reports, trees

TREE = {
    "service/run.py": "import sys\n", "service/jobs/clean.pyw": "x = 1\n", "service/api/server.go": "package api\n",
    "ui/panel.jsx": "let a = 1\n", "ui/store.mts": "export const s = 1\n", "ui/legacy/old.cjs": "var b\n", "ui/menu.tsx": "let m\n",
    "core/src/lib.rs": "fn a() {}\n", "core/Store.java": "class Store {}\n", "core/Tool.cs": "class Tool {}\n", "shop/cart.php": "<?php\n",
    "sql/01_init.sql": "SELECT 1\n", "ops/values.yml": "a: 1\n", "ops/net.tfvars": "b = 2\n", "ops/Dockerfile.dev": "FROM scratch\n",
    "settings.json": "{}\n", "NOTES.txt": "text", "LICENSE": "text",
    "ui/node_modules/left/pad.js": "no", "service/.venv/lib/z.py": "no", "core/target/gen.rs": "no", "ui/dist/app.js": "no",
}
KEPT = {p for p in TREE if TREE[p] not in ("no", "text")}


def write(folder, tree):
    for path, content in tree.items():
        full = os.path.join(folder, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as out:
            out.write(content)
    return str(folder)


@pytest.fixture
def roots(spark):
    return lambda *pairs: spark.createDataFrame(list(pairs), "repo string, root string")


def languages(df):
    return {r["language"]: r["count"] for r in df.groupBy("language").count().collect()}


def test_tree(tmp_path, roots):
    root = roots(("r", write(tmp_path, TREE)))
    files = trees.read_source_files(root)
    rows = {r["path"]: r for r in files.collect()}
    assert set(rows) == KEPT
    assert languages(files) == {
        "python": 2, "go": 1, "javascript": 2, "typescript": 2, "rust": 1, "java": 1, "csharp": 1, "php": 1,
        "sql": 1, "yaml": 1, "hcl": 1, "dockerfile": 1, "json": 1,
    }
    for path, row in rows.items():
        assert bytes(row["content"]).decode() == TREE[path] and row["size"] == len(TREE[path])
    assert trees.read_source_files(root, ["go", "python"]).count() == 3
    assert trees.read_source_files(root, ["cobol"]).count() == 0
    assert "hcl" not in languages(trees.read_source_files(root, ignore_dirs={"ops": True}))
    assert trees.read_source_files(root, ignore_dirs={"dist": False}).count() == len(KEPT) + 1
    assert sum(r["files"] for r in understand.tree_info(root).collect()) == len(KEPT)


def test_hidden_names_rounds_and_links(tmp_path, roots):
    deep = {f"d{i % 7}/e{i % 3}/f{i}/a{i}.py": "x" for i in range(60)}
    tree = {".eslintrc.json": "{}", "pkg/__init__.py": "", ".github/ci.yml": "a: b", "build/x.py": "no", "a/_b/c.py": "y"} | deep
    write(tmp_path, tree)
    os.symlink(tmp_path / "pkg", tmp_path / "loop.py")
    os.symlink(tmp_path, tmp_path / "pkg" / "self")
    os.chmod(tmp_path / "a" / "_b" / "c.py", 0)
    for budget in (1, 10_000):
        listed = trees.list_files(roots(("r", str(tmp_path))), entries_per_task=budget)
        assert {r["path"] for r in listed.collect()} == set(tree) - {"build/x.py"} | {"loop.py", "pkg/self"}
    read = {r["path"] for r in trees.read_source_files(roots(("r", str(tmp_path)))).collect()}
    assert {".eslintrc.json", "pkg/__init__.py", ".github/ci.yml"} <= read
    assert "loop.py" not in read  # a folder, so it cannot be read
    left_out = {r["path"]: r["reason"] for r in trees.skipped_files(roots(("r", str(tmp_path))), most_bytes=3).collect()}
    assert left_out["loop.py"] == "Is a directory" and left_out[".github/ci.yml"] == "more than 3 bytes"


def test_one_reading_tells_both(tmp_path, roots):
    root = write(tmp_path / "t", {"a.py": "x", "b.py": "long", "c.go": "y", "d.txt": "z"})
    files, skipped = trees.read_once(roots(("r", root)), most_bytes=3)
    for name in ("a.py", "b.py", "c.go"):
        (tmp_path / "t" / name).unlink()  # neither table goes back to the tree
    assert sorted((r["path"], bytes(r["content"])) for r in files.collect()) == [("a.py", b"x"), ("c.go", b"y")]
    assert [tuple(r) for r in skipped.collect()] == [("r", "b.py", "more than 3 bytes")]


def test_missing_and_empty_root(tmp_path, roots):
    with pytest.raises(PySparkException):
        trees.read_source_files(roots(("r", str(tmp_path / "none")))).count()
    (tmp_path / "empty").mkdir()
    assert trees.read_source_files(roots(("r", str(tmp_path / "empty")))).count() == 0


def test_many_roots(tmp_path, roots):
    a, b = write(tmp_path / "a", {"x.py": "1"}), write(tmp_path / "b", {"x.py": "22", "build/y.py": ""})
    got = trees.read_source_files(roots(("a", a), ("b", b), ("c", b + "/build"))).collect()
    assert sorted((r["repo"], r["path"], r["size"]) for r in got) == [("a", "x.py", 1), ("b", "x.py", 2), ("c", "y.py", 0)]


def test_table_source(tmp_path, spark):
    rows = [("r", p, bytearray(c.encode())) for p, c in TREE.items()]
    spark.createDataFrame(rows, "repo string, path string, content binary").write.parquet(str(tmp_path / "t"))
    files = trees.read_source_table(spark, str(tmp_path / "t"))
    assert files.count() == len(KEPT)
    assert trees.read_source_table(spark, str(tmp_path / "t"), ["go"]).agg(F.sum("size")).first()[0] == len(TREE["service/api/server.go"])


TRIVY = (
    '{"Results": [{"Target": "yarn.lock", "Vulnerabilities": [{"VulnerabilityID": "CVE-2031-0007", "PkgName": "left-shift",'
    ' "InstalledVersion": "0.1.0", "Severity": "HIGH", "Title": "Reads past the end", "CVSS": {"x": [1]}}]}, {"Target": "none"}]}'
)
SEMGREP = (
    '{"results": [{"check_id": "audit.own.dangerous-sql-query", "path": "till.py",'
    ' "start": {"line": 10, "col": 5, "offset": 7}, "end": {"line": 10, "col": 40}, "extra": {"message": "m", "severity": "ERROR",'
    ' "metadata": {"cwe": ["x"]}}}, {"check_id": "x"}], "errors": []}'
)


def test_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(TRIVY)
    (tmp_path / "b.json").write_text("{")
    reports = scanner_reports.read_reports(spark, str(tmp_path), F.regexp_extract("path", r"([^/]+)\.json$", 1))
    rows = scanner_reports.ingest_trivy(reports).collect()
    assert len(rows) == 1
    found = rows[0].asDict()
    assert (found["repo"], found["class"], found["severity"], found["file"], found["source"]) == ("a", "sca-high", "high", "yarn.lock", "trivy")
    assert found["title"] == "[Trivy] CVE-2031-0007 in left-shift@0.1.0" and found["description"] == "Reads past the end"
    assert [r["repo"] for r in scanner_reports.bad_reports(reports, "trivy").collect()] == ["b"]


def test_semgrep(spark):
    reports = spark.createDataFrame(
        [("r", SEMGREP), ("bad", '{"results": [{"start": {"line": "ten"}}]}'), ("clean", '{"results": []}'), ("none", "")],
        "repo string, report string",
    )
    rows = scanner_reports.ingest_semgrep(reports).orderBy("position").collect()
    place = ["start_row", "start_col", "end_row", "end_col"]
    assert [tuple(r[c] for c in place) for r in rows] == [(9, 4, 9, 39), (-1, -1, -1, -1)]
    assert [(r["class"], r["severity"], r["description"]) for r in rows] == [("sql-injection", "high", "m"), ("semgrep-x", "info", "")]
    assert sorted(r["repo"] for r in scanner_reports.bad_reports(reports, "semgrep").collect()) == ["bad", "none"]


def test_few_rounds_of_listing(tmp_path, roots, monkeypatch):
    """Rounds grow with the logarithm of the folders."""
    tree = {f"d{i}/a.py": "x" for i in range(400)}
    write(tmp_path, tree)
    rounds, cut = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda df: rounds.append(1) or cut(df))
    found = trees.list_files(roots(("r", str(tmp_path))), entries_per_task=1)
    assert {r["path"] for r in found.collect()} == set(tree)
    assert len(rounds) <= 11
