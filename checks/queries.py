"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from srcatlas import rules
from srcatlas.functions import columns as C
from srcatlas.operators import detection, extraction, graph, lookups, numbering, summary
from srcatlas.plans import scan, understand
from srcatlas.session import new_shared_path
from srcatlas.sinks import findings_json, html, markdown, sarif
from srcatlas.sources import scanner_reports, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def numbered(spark, sf):
    return numbering.number_findings(detection.scan_findings(I.elements(spark, sf)))


def merged(spark, sf):
    return detection.merge_external(
        detection.scan_findings(I.elements(spark, sf)),
        scanner_reports.ingest_trivy(I.trivy_reports(spark, sf)),
        scanner_reports.ingest_semgrep(I.semgrep_reports(spark, sf)),
    )


def nodes_and_edges(spark, sf):
    elements = I.elements(spark, sf)
    return graph.build_nodes(I.files(spark, sf), elements), graph.build_edges(elements)


# ---- discovery -------------------------------------------------------------------


@query
def detect_language(spark, sf):
    return I.paths(spark, sf).select("path", C.detect_language(F.col("path")).alias("language")).groupBy("path", "language").agg(F.count("*").alias("n"))


@query
def prune_dirs(spark, sf):
    return trees.prune_dirs(I.paths(spark, sf))


@query
def filter_languages(spark, sf):
    return trees.scan_inventory(I.paths(spark, sf), ["python", "go", "cobol"])


@query
def scan_inventory(spark, sf):
    """With a folder added to the ignored ones and a default let in again."""
    return trees.scan_inventory(I.paths(spark, sf), None, {"deploy": True, "build": False})


@query
def ignored_dirs(spark, sf):
    """Per effective ignored name, how many files lie below such a folder."""
    names = rules.ignored_dirs(spark, {"deploy": True, "build": False})
    folder = I.paths(spark, sf).select(F.explode(F.split("path", "/")).alias("name"))
    return names.join(folder.groupBy("name").agg(F.count("*").alias("n")), "name", "left").na.fill(0)


@query
def language_stats(spark, sf):
    return summary.language_stats(trees.scan_inventory(I.paths(spark, sf)))


@query
def language_ext(spark, sf):
    """Per extension of the table, how many files have it."""
    ext = F.lower(F.regexp_extract(C.base_name(F.col("path")), r"(\.[^.]*)$", 1))
    counts = I.paths(spark, sf).groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))
    return rules.language_ext(spark).join(counts, "ext", "left").na.fill(0)


@query
def supported_languages(spark, sf):
    known = summary.language_stats(trees.scan_inventory(I.paths(spark, sf))).groupBy("language").agg(F.sum("files").alias("files"))
    return rules.supported_languages(spark).join(known, "language", "left").na.fill(0)


def _write_tree(spark: SparkSession, sf: str) -> str:
    """Each page as a file below a new folder: the source tree to list."""
    root = new_shared_path(spark, "tree")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/{row['path']}"
                filesystem.create_dir(name.rpartition("/")[0], recursive=True)
                with filesystem.open_output_stream(name) as out:
                    out.write(row["html"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    folder = I.pick(["a", "a/b/_c", "node_modules/x", ".github", "d/build"], F.col("page_id") % 5)
    base = I.pick(["p", "__init__", ".p"], F.col("page_id") % 3)
    ext = I.pick([".py", ".js", ".txt", ".go"], F.col("page_id") % 4)
    pages = I.table(spark, sf, "pages").select(
        F.concat(folder, F.lit("/"), I.text("page_id"), F.lit("/"), base, ext).alias("path"), "html"
    )
    pages.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


@query
def read_source_files(spark, sf):
    """Write the pages as a source tree, then list and read it; small rounds of listing."""
    root = _write_tree(spark, sf)
    roots = spark.range(1).select(F.lit("web").alias("repo"), F.lit(root).alias("root"))
    found = trees.read_source_files(roots, entries_per_task=50)
    return found.select("repo", "path", "language", "size", F.md5("content").alias("digest"))


# ---- extraction ------------------------------------------------------------------


@query
def extract_functions(spark, sf):
    return extraction.extract_functions(I.templated_files(spark, sf)).drop("node_type")


@query
def extract_calls(spark, sf):
    return extraction.extract_calls(I.templated_files(spark, sf)).drop("node_type")


@query
def extract_imports(spark, sf):
    return extraction.extract_imports(I.templated_files(spark, sf)).drop("node_type")


@query
def extract_strings(spark, sf):
    return extraction.extract_strings(I.templated_files(spark, sf)).drop("node_type")


@query
def extract_whole_documents(spark, sf):
    return extraction.extract_elements(I.document_files(spark, sf)).withColumn("name", F.md5("name"))


@query
def extract_page_scripts(spark, sf):
    return extraction.extract_elements(I.page_scripts(spark, sf))


@query
def parse_status(spark, sf):
    """Some files have an open bracket put behind them (behind PHP's closing tag that is just text)."""
    files = I.templated_files(spark, sf)
    opened = F.concat("content", F.encode(F.lit("("), "utf-8"))
    content = F.when(F.length("path") % 3 == 0, opened).otherwise(F.col("content"))
    return extraction.parse_status(files.withColumn("content", content))


# ---- whole runs ------------------------------------------------------------------


def _scan(spark, sf):
    files = I.templated_files(spark, sf)
    return scan.scan_files(files, trivy=I.trivy_reports(spark, sf), semgrep=I.semgrep_reports(spark, sf))


@query
def scan_run(spark, sf):
    """A whole scan from the bytes of source files to numbered findings, scanner reports merged."""
    return _scan(spark, sf).findings.select("repo", "seq", "finding_id", "class", "severity", "title", "file", "start_row", "start_col", "source")


@query
def scan_run_metrics(spark, sf):
    """Counters of a whole scan."""
    return _scan(spark, sf).metrics().filter("files > 0")


@query
def scan_run_filtered(spark, sf):
    """A whole scan of two languages, of two classes of findings, from a severity on."""
    files = trees.filter_languages(I.templated_files(spark, sf), ["python", "go"])
    found = scan.scan_files(files, ["sql-injection", "xss"], trivy=I.trivy_reports(spark, sf), semgrep=I.semgrep_reports(spark, sf)).findings
    return detection.filter_by_severity(found, "high").select("repo", "seq", "finding_id", "class", "severity", "title", "file", "start_row", "start_col", "source")


def _summary(spark, sf):
    files, elements = scan.store(I.templated_files(spark, sf))
    return understand.repo_summary(files, elements)


@query
def tree_info(spark, sf):
    """Files and elements of a whole code base: statistics and languages, from the bytes."""
    return _summary(spark, sf)


@query
def tree_listing(spark, sf):
    """Files per language of a source tree, which is listed only."""
    roots = spark.range(1).select(F.lit("web").alias("repo"), F.lit(_write_tree(spark, sf)).alias("root"))
    return understand.tree_info(roots)


@query
def stored_summary(spark, sf):
    """The same summary under its other name."""
    return _summary(spark, sf)


# ---- detection -------------------------------------------------------------------


@query
def sink_rules(spark, sf):
    """Per rule row, how many calls it matches."""
    calls = I.elements(spark, sf).filter("kind = 'call'").groupBy("language", "name").agg(F.count("*").alias("calls"))
    return rules.sink_rules(spark).join(calls, ["language", "name"], "left").na.fill(0)


@query
def secret_rules(spark, sf):
    """Per secret rule, how many literals it decides."""
    hits = detection.match_secrets(I.elements(spark, sf)).groupBy("title").agg(F.count("*").alias("literals"))
    return rules.secret_rules(spark).select("priority", "title", "severity").join(hits, "title", "left").na.fill(0)


@query
def match_sinks(spark, sf):
    return detection.match_sinks(I.elements(spark, sf))


@query
def match_secrets(spark, sf):
    return detection.match_secrets(I.elements(spark, sf))


@query
def match_secrets_documents(spark, sf):
    return detection.match_secrets(I.document_literals(spark, sf))


@query
def match_sql_concat(spark, sf):
    return detection.match_sql_concat(I.elements(spark, sf))


@query
def match_sql_concat_documents(spark, sf):
    return detection.match_sql_concat(I.document_literals(spark, sf))


@query
def scan_findings(spark, sf):
    return detection.scan_findings(I.elements(spark, sf))


@query
def scan_findings_focused(spark, sf):
    return detection.scan_findings(I.elements(spark, sf), ["sql-injection", "xss", "nonsense"])


@query
def filter_by_severity(spark, sf):
    return detection.filter_by_severity(merged(spark, sf), "medium")


@query
def number_findings(spark, sf):
    return numbered(spark, sf)


@query
def severity_summary(spark, sf):
    return summary.severity_summary(merged(spark, sf))


@query
def ci_gate(spark, sf):
    repos = I.files(spark, sf).select("repo")
    return summary.ci_gate(merged(spark, sf), "high", repos)


@query
def ci_gate_unknown_threshold(spark, sf):
    return summary.ci_gate(merged(spark, sf), "severe")


# ---- scanner reports -------------------------------------------------------------


@query
def ingest_trivy(spark, sf):
    return scanner_reports.ingest_trivy(I.trivy_reports(spark, sf))


@query
def ingest_semgrep(spark, sf):
    return scanner_reports.ingest_semgrep(I.semgrep_reports(spark, sf))


@query
def bad_reports(spark, sf):
    bad = [
        scanner_reports.bad_reports(reports(spark, sf), tool).select(F.lit(tool).alias("tool"), "repo")
        for tool, reports in [("trivy", I.trivy_reports), ("semgrep", I.semgrep_reports)]
    ]
    return bad[0].unionByName(bad[1]).groupBy("tool", "repo").agg(F.count("*").alias("reports"))


@query
def merge_external(spark, sf):
    """Scanner findings behind the internal ones, without ids."""
    return numbering.number_findings(merged(spark, sf)).select(
        "repo", "finding_id", "class", "severity", "title", "file", "source", "phase", "position"
    )


@query
def external_summary(spark, sf):
    return summary.external_summary(merged(spark, sf))


# ---- graph -----------------------------------------------------------------------


@query
def build_nodes(spark, sf):
    return nodes_and_edges(spark, sf)[0]


@query
def build_edges(spark, sf):
    return nodes_and_edges(spark, sf)[1]


@query
def resolve_calls(spark, sf):
    return graph.resolve_calls(I.elements(spark, sf))


@query
def calls_from(spark, sf):
    nodes, _ = nodes_and_edges(spark, sf)
    return graph.calls_from(nodes, I.elements(spark, sf), graph.nodes_of_kind(nodes, "call"))


@query
def callers_of(spark, sf):
    nodes, _ = nodes_and_edges(spark, sf)
    return graph.callers_of(nodes, I.elements(spark, sf), graph.nodes_of_kind(nodes, "function"))


@query
def reachable(spark, sf):
    """From the calls in files with a critical sink finding, over the compact edges."""
    elements = I.elements(spark, sf)
    nodes = graph.build_nodes(I.files(spark, sf), elements)
    critical = detection.match_sinks(elements).filter("severity = 'critical'").select("repo", F.col("file").alias("path")).distinct()
    starts = elements.filter("kind = 'call'").join(critical, ["repo", "path"], "left_semi").select("repo", graph.node_id().alias("node_id"))
    found = graph.reachable(nodes, graph.traversal_edges(elements), starts, ["calls", "defined_in", "imports"])
    return found.select("repo", "start", "node_id", "kind")


@query
def entry_points(spark, sf):
    return graph.entry_points(I.elements(spark, sf))


@query
def call_graph(spark, sf):
    return graph.call_graph(I.elements(spark, sf))


@query
def nodes_of_kind(spark, sf):
    return graph.nodes_of_kind(nodes_and_edges(spark, sf)[0], "import")


@query
def functions_by_name(spark, sf):
    return graph.functions_by_name(nodes_and_edges(spark, sf)[0], "main_0")


@query
def strings_containing(spark, sf):
    return graph.strings_containing(nodes_and_edges(spark, sf)[0], "% v")


@query
def strings_containing_patterns(spark, sf):
    """Parts of the strings' own texts, of several lengths, and names that are in none of them."""
    nodes, path = nodes_and_edges(spark, sf)[0], new_shared_path(spark, "strings")
    lookups.write_string_index(nodes, path)
    parts = F.expr("array('', substring(name, 3, 1), substring(name, 3, 2), substring(name, 4, 3), substring(name, 2, 9), name)")
    patterns = nodes.filter("kind = 'string'").select(F.explode(parts).alias("pattern")).unionByName(I.table(spark, sf, "nation").select(F.col("n_name").alias("pattern")))
    return lookups.strings_containing(spark, path, patterns).select("pattern", "repo", "node_id")


def _asked(spark, sf, kind):
    """A stored code base, and the first ids of a kind in it."""
    nodes, path = nodes_and_edges(spark, sf)[0], new_shared_path(spark, "elements")
    lookups.write_elements(I.elements(spark, sf), path)
    ids = graph.nodes_of_kind(nodes, kind).select("repo", "node_id").distinct().orderBy("node_id", "repo").limit(25)
    return lookups.read_elements(spark, path), [tuple(r) for r in ids.collect()]


@query
def stored_calls_from(spark, sf):
    """The 25 first calls by id are asked for."""
    return lookups.calls_from(*_asked(spark, sf, "call")).select("repo", "of", "node_id", "name", "path", "start_row")


@query
def stored_callers_of(spark, sf):
    """The 25 first functions by id are asked for."""
    return lookups.callers_of(*_asked(spark, sf, "function")).select("repo", "of", "node_id", "name", "path", "start_row")


@query
def graph_stats(spark, sf):
    return graph.graph_stats(I.files(spark, sf), I.elements(spark, sf))


@query
def repo_summary(spark, sf):
    return understand.repo_summary(I.files(spark, sf), I.elements(spark, sf))


@query
def call_graph_lines(spark, sf):
    return understand.call_graph_lines(I.elements(spark, sf))


@query
def entry_point_lines(spark, sf):
    return understand.entry_point_lines(I.elements(spark, sf))


@query
def scan_metrics(spark, sf):
    files, elements = I.files(spark, sf), I.elements(spark, sf)
    return summary.scan_metrics(files, graph.graph_stats(files, elements), merged(spark, sf))


# ---- reports ---------------------------------------------------------------------


@query
def sarif_results(spark, sf):
    return sarif.sarif_results(numbered(spark, sf)).select("repo", "seq", F.to_json("result").alias("result"))


@query
def sarif_rules(spark, sf):
    return sarif.sarif_rules(numbered(spark, sf)).select("repo", "seq", F.to_json("rule").alias("rule"))


@query
def write_sarif(spark, sf):
    repos = I.files(spark, sf).select("repo").unionByName(I.table(spark, sf, "nation").select(F.concat(F.lit("empty"), I.text("n_nationkey")).alias("repo")))
    return sarif.sarif_documents(numbered(spark, sf), repos, version="1.0")


@query
def write_findings_json(spark, sf):
    repos = I.table(spark, sf, "nation").select(F.concat(F.lit("r"), I.text("n_nationkey")).alias("repo"))
    repos = repos.unionByName(I.files(spark, sf).select("repo"))
    return findings_json.json_documents(numbered(spark, sf), repos)


@query
def write_markdown(spark, sf):
    repos = I.table(spark, sf, "nation").select(F.concat(F.lit("r"), I.text("n_nationkey")).alias("repo"))
    repos = repos.unionByName(I.files(spark, sf).select("repo"))
    return markdown.markdown_documents(numbered(spark, sf), repos)


@query
def write_html(spark, sf):
    return html.html_documents(numbered(spark, sf))


@query
def html_escape(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", F.md5(C.html_escape(F.col("html"))).alias("digest"))


@query
def sarif_level(spark, sf):
    found = merged(spark, sf)
    return found.groupBy("severity", C.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("findings"))
