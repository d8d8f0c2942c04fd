import json
import os

import pytest

from srcatlas import model
from srcatlas.operators import numbering
from srcatlas.sinks import findings_json, html, markdown, reports, sarif

COLUMNS = "repo class severity title description file start_row start_col end_row end_col language".split()
SAMPLE = [
    ("r", "sql-injection", "high", "Potential SQL injection", "Call to <b> & \"q\".", "shop/cart.py", 17, 2, 17, 19, "python"),
    ("r", "command-injection", "critical", "Potential command injection", "Call to OS.", "jobs/render.py", 5, 0, 5, 9, "python"),
    ("r", "hardcoded-secret", "high", "Hardcoded <script> password", "Secret — é.", "keys.py", 8, 1, 8, 30, "python"),
    ("r", "sql-injection", "low", "Other title", "", "z.py", 0, 0, 0, 0, ""),
    ("s", "xss", "odd", "T", "D", "a", 0, 0, 0, 0, "go"),
]


@pytest.fixture(scope="module")
def numbered(spark):
    rows = [(*r, f"n{i}", "code", 0, i, 0) for i, r in enumerate(SAMPLE)]
    types = {c: "int" for c in [*model.POSITION_COLUMNS, "phase", "def_ordinal"]} | {"position": "bigint"}
    names = COLUMNS + ["node_id", "source", "phase", "position", "def_ordinal"]
    schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
    return numbering.number_findings(spark.createDataFrame(rows, schema)).cache()


@pytest.fixture(scope="module")
def repos(spark):
    return spark.createDataFrame([("r",), ("empty",)], "repo string")


def text_of(docs, repo):
    rows = docs.filter(docs["repo"] == repo).orderBy("section", "seq").collect()
    return "".join(r["text"] + "\n" for r in rows)


def test_sarif(numbered, repos):
    docs = sarif.sarif_documents(numbered, repos)
    doc = json.loads(text_of(docs, "r"))
    assert doc["version"] == "2.1.0" and doc["$schema"].endswith("sarif-schema-2.1.0.json") and len(doc["runs"]) == 1
    run = doc["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["sql-injection", "command-injection", "hardcoded-secret", "sql-injection"]
    first = run["results"][0]
    assert first["level"] == "error" and first["message"]["text"] == 'Potential SQL injection: Call to <b> & "q".'
    assert first["locations"][0]["physicalLocation"] == {
        "artifactLocation": {"uri": "shop/cart.py"},
        "region": {"startLine": 18, "startColumn": 3, "endLine": 18, "endColumn": 20},
    }
    rules = run["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules] == ["sql-injection", "command-injection", "hardcoded-secret"]
    assert rules[0] == {
        "id": "sql-injection", "name": "sql-injection", "shortDescription": {"text": "Potential SQL injection"},
        "defaultConfiguration": {"level": "error"},
    }
    assert run["results"][3]["level"] == "note"
    empty = json.loads(text_of(docs, "empty"))["runs"][0]
    assert empty["results"] == [] and empty["tool"]["driver"]["rules"] == []


def test_json(numbered, repos):
    docs = findings_json.json_documents(numbered, repos)
    found = json.loads(text_of(docs, "r"))
    assert [f["ID"] for f in found] == ["F-0001", "F-0002", "F-0003", "F-0004"]
    assert list(found[0]) == "ID Class Severity Title Description File StartRow StartCol EndRow EndCol Language NodeID".split()
    assert found[0]["StartRow"] == 17 and found[2]["Description"] == "Secret — é."
    assert json.loads(text_of(docs, "empty")) is None


def test_markdown(numbered, repos):
    docs = markdown.markdown_documents(numbered, repos)
    text = text_of(docs, "r")
    lines = text.split("\n")
    assert lines.index("| critical | 1 |") < lines.index("| high | 2 |") < lines.index("| low | 1 |")
    at = lines.index("1. **F-0001** (high, sql-injection) Potential SQL injection")
    assert lines[at + 1] == "   at `shop/cart.py:18:3`, language: python"
    assert "| medium" not in text
    assert "No vulnerabilities found" in text_of(docs, "empty")
    assert "| odd" not in text_of(markdown.markdown_documents(numbered), "s")


def test_html(numbered, repos):
    docs = html.html_documents(numbered, repos)
    text = text_of(docs, "r")
    assert text.startswith("<!DOCTYPE html>") and text.endswith("</main></body></html>\n")
    assert "<h1>4 findings</h1>" in text and "shop/cart.py:18:3" in text and "<script>" not in text
    assert "Hardcoded &lt;script&gt; password" in text and text.count("<article ") == text.count("</article>") == 4
    assert "<tr><td>high</td><td>2</td></tr>" in text
    assert "No vulnerabilities found" in text_of(docs, "empty")


def test_written_files_are_the_documents(numbered, repos, tmp_path):
    def read(folder, repo):
        folder = os.path.join(folder, f"repo={repo}")
        names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
        return "".join(open(os.path.join(folder, n), encoding="utf8").read() for n in names)

    out = str(tmp_path / "sarif")
    sarif.write_sarif(numbered, out, repos)
    assert len(json.loads(read(out, "r"))["runs"][0]["results"]) == 4
    assert json.loads(read(out, "empty"))["runs"][0]["results"] == []
    findings_json.write_findings_json(numbered, str(tmp_path / "json"), repos)
    assert len(json.loads(read(str(tmp_path / "json"), "r"))) == 4
    findings_json.write_findings_json(numbered, str(tmp_path / "lines"), lines=True)
    assert numbered.sparkSession.read.json(str(tmp_path / "lines")).count() == 5
    markdown.write_markdown(numbered, str(tmp_path / "md"), repos)
    assert read(str(tmp_path / "md"), "r") == text_of(markdown.markdown_documents(numbered, repos), "r")
    html.write_html(numbered, str(tmp_path / "html"), repos)
    assert read(str(tmp_path / "html"), "r").endswith("</body></html>\n")
    reports.write_report("json", numbered, str(tmp_path / "named"), repos)
    assert read(str(tmp_path / "named"), "r") == read(str(tmp_path / "json"), "r")
    with pytest.raises(ValueError, match="unknown report format"):
        reports.write_report("pdf", numbered, str(tmp_path / "pdf"))


def test_a_large_document_parses(spark, tmp_path):
    """Many findings over many partitions and files have the same layout as few."""
    rows = spark.range(30_000).selectExpr(
        "'big' as repo", "'xss' as class", "'low' as severity", "'T' as title", "'D' as description", "concat('f', id) as file", "cast(id as int) as start_row",
        "0 as start_col", "0 as end_row", "0 as end_col", "'go' as language", "concat('n', id) as node_id", "'code' as source", "0 as phase", "id as position", "0 as def_ordinal")
    rows = numbering.number_findings(rows.repartition(7)).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for name in ("sarif", "json"):
        reports.write_report(name, rows, str(tmp_path / name))
        folder = tmp_path / name / "repo=big"
        files = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
        doc = json.loads("".join((folder / p).read_text() for p in files))
        found = doc["runs"][0]["results"] if name == "sarif" else doc
        assert len(files) > 1 and len(found) == 30_000
        if name == "json":
            assert [f["StartRow"] for f in found] == list(range(30_000))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
