import pytest
from pyspark.sql import functions as F

from srcatlas.operators import graph
from srcatlas.plans import understand


@pytest.fixture(scope="module")
def two_files(elements):
    a, b = ("r", "orders.py", "python"), ("r", "mail.py", "python")
    rows = elements(
        (*a, "function", "place_order", 3, 0, 5, 20), (*a, "function", "check_stock", 7, 0, 9, 15),
        (*a, "call", "check_stock", 4, 4), (*a, "call", "popen", 5, 4), (*a, "import", "os"),
        (*a, "string", '"SELECT price FROM items WHERE sku = "', 4, 12),
        (*b, "function", "render", 1, 0, 3, 10), (*b, "call", "place_order", 5, 0), (*b, "import", "orders"),
        (*b, "string", '"smtp secret"', 2, 8),
    ).cache()
    files = rows.select("repo", "path", "language").distinct()
    return files, rows, graph.build_nodes(files, rows), graph.build_edges(rows)


def ids(df, column="node_id"):
    return sorted(r[column] for r in df.collect())


def test_stats(two_files):
    files, rows, nodes, edges = two_files
    stats = graph.graph_stats(files, rows).first().asDict()
    assert stats == {
        "repo": "r", "nodes": 12, "edges": 12, "files": 2, "functions": 3, "calls": 3, "imports": 2, "strings": 2,
        "resolved_calls": 2,
    }
    assert nodes.count() == 12
    assert {r["kind"]: r["count"] for r in edges.groupBy("kind").count().collect()} == {
        "defined_in": 3, "contains": 5, "imports": 2, "calls": 2,
    }


def test_ids_and_direction(two_files):
    _, _, nodes, edges = two_files
    assert "str:orders.py:0" in ids(nodes) and "call:orders.py:popen:1" in ids(nodes)
    imports = edges.filter("kind = 'imports'").select("src", "dst").collect()
    assert ("file:orders.py", "import:orders.py:os:0") in [tuple(r) for r in imports]


def test_lookups(spark, two_files):
    _, rows, nodes, _ = two_files
    one = lambda i: spark.createDataFrame([("r", i)], "repo string, node_id string")
    target = "func:orders.py:place_order:0"
    assert ids(graph.callers_of(nodes, rows, one(target))) == ["call:mail.py:place_order:0"]
    assert ids(graph.calls_from(nodes, rows, one("call:mail.py:place_order:0"))) == [target]
    assert graph.strings_containing(nodes, "SELECT").count() == 1
    assert graph.strings_containing(nodes, "smtp").count() == 1
    assert graph.strings_containing(nodes, "nonexistent_xyz_123").count() == 0
    assert graph.strings_containing(nodes, "%").count() == 0
    assert ids(graph.functions_by_name(nodes, "render")) == ["func:mail.py:render:0"]
    assert graph.nodes_of_kind(nodes, "file").count() == 2


def test_entry_points_and_lines(two_files):
    _, rows, _, _ = two_files
    assert [r["line"] for r in understand.entry_point_lines(rows).collect()] == ["render (mail.py:2)"]
    assert sorted(r["line"] for r in understand.call_graph_lines(rows).collect()) == [
        "check_stock (orders.py:5) → check_stock (orders.py:8)",
        "place_order (mail.py:6) → place_order (orders.py:4)",
    ]


def test_languages_and_repositories_do_not_mix(elements):
    rows = elements(
        ("r", "a.py", "python", "function", "process"), ("r", "b.go", "go", "call", "process"),
        ("s", "c.py", "python", "call", "process"),
    )
    assert graph.resolve_calls(rows).count() == 0
    assert graph.entry_points(rows).count() == 1


def test_empty(spark, elements):
    rows = elements(("r", "a", "go", "call", "x")).filter("false")
    files = spark.createDataFrame([("r", "a.yaml", "yaml")], "repo string, path string, language string")
    stats = graph.graph_stats(files, rows).first().asDict()
    assert stats.pop("repo") == "r" and stats.pop("files") == stats.pop("nodes") == 1
    assert set(stats.values()) == {0}
    assert graph.graph_stats(files.filter("false"), rows).count() == 0


def test_shared_ids_are_kept_once(spark, elements):
    rows = elements(
        ("r", "p", "rust", "import", "a:b"), ("r", "p:a", "rust", "import", "b"), ("r", "q", "rust", "import", "std::io"),
    )
    files = rows.select("repo", "path", "language").distinct()
    nodes = graph.build_nodes(files, rows)
    assert nodes.filter("node_id = 'import:p:a:b:0'").count() == 1
    assert nodes.count() == 5
    stats = graph.graph_stats(files, rows).first()
    assert (stats["nodes"], stats["imports"], stats["edges"]) == (5, 2, 3)


def test_duplicate_paths(spark):
    files = spark.createDataFrame([("r", "a"), ("r", "a"), ("s", "a")], "repo string, path string")
    assert [tuple(r) for r in graph.duplicate_paths(files).collect()] == [("r", "a", 2)]


def walk(edges, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for dst in edges.get(at, []):
            if dst not in seen:
                seen.add(dst)
                todo.append(dst)
    return seen - {start}


@pytest.mark.parametrize("limit", [3, 100_000])
def test_reachable_against_brute_force(spark, limit):
    """A hub with many targets, a cycle, a chain and a dangling target."""
    pairs = [("hub", f"t{i}") for i in range(40)] + [(f"t{i}", "c0") for i in range(5)]
    pairs += [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("c3", "ghost"), ("ghost", "z")]
    pairs += [("x", "hub"), ("x", "x"), ("z", "z2")]
    rows = [("r", a, b, "calls") for a, b in pairs] + [("r", "z2", "hub", "other"), ("s", "z2", "hub", "calls")]
    edges = spark.createDataFrame(rows, "repo string, src string, dst string, kind string")
    names = sorted({n for p in pairs for n in p} - {"ghost"})
    nodes = spark.createDataFrame([("r", n) for n in names], "repo string, node_id string")
    found = graph.reachable(nodes, edges, nodes, ["calls"], fan_out_limit=limit)
    got = {}
    for r in found.collect():
        got.setdefault(r["start"], []).append(r["node_id"])
    step = {}
    for a, b in pairs:
        step.setdefault(a, []).append(b)
    want = {n: sorted(walk(step, n) - {"ghost"}) for n in names}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_compact_edges_reach_the_same(two_files):
    _, rows, nodes, edges = two_files
    kinds = ["calls", "defined_in", "imports", "contains"]
    full = graph.reachable(nodes, edges, nodes, kinds).select("start", "node_id")
    compact = graph.reachable(nodes, graph.traversal_edges(rows), nodes, kinds).select("start", "node_id")
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, compact.collect()))
    start = nodes.filter("node_id = 'call:orders.py:check_stock:0'")
    assert ids(graph.reachable(nodes, edges, start, ["calls"])) == ["func:orders.py:check_stock:1"]


def test_hot_name(spark):
    """A third of all calls and functions share one name: counts need no pairs."""
    n = 30_000
    df = spark.range(n).select(
        F.lit("r").alias("repo"), F.concat(F.lit("f"), (F.col("id") % 500).cast("string")).alias("path"),
        F.lit("go").alias("language"), F.when(F.col("id") % 2 == 0, "call").otherwise("function").alias("kind"),
        F.col("id").cast("int").alias("ordinal"), F.lit("").alias("node_type"),
        F.when(F.col("id") % 3 == 0, "get").otherwise(F.concat(F.lit("f"), (F.col("id") % 1000).cast("string"))).alias("name"),
        *[F.lit(0).alias(c) for c in ("start_row", "start_col", "end_row", "end_col")],
    )
    files = df.select("repo", "path", "language").distinct()
    stats = graph.graph_stats(files, df).first()
    assert stats["resolved_calls"] == (n // 6) ** 2
    assert stats["edges"] == n + (n // 6) ** 2
    called = df.filter("kind = 'call'").select("name").distinct()
    assert graph.entry_points(df).count() == df.filter("kind = 'function'").join(called, "name", "left_anti").count()


def test_hot_names_are_split(spark, elements):
    """More calls than functions, more functions than calls, and a name that is not hot."""
    rows = []
    for name, calls, functions in [("a", 50, 7), ("b", 6, 40), ("c", 1, 2), ("d", 3, 0)]:
        rows += [("r", f"f{i % 5}", "go", "call", name) for i in range(calls)]
        rows += [("r", f"f{i % 3}", "go", "function", name) for i in range(functions)]
    df = elements(*rows)
    whole = graph.resolve_calls(df)
    split = graph.resolve_calls(df, rows_per_share=3)
    assert whole.count() == 50 * 7 + 6 * 40 + 2
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
    assert "share" in split._jdf.queryExecution().optimizedPlan().toString()


def test_free_hot_name_is_work_for_many_tasks(spark, elements):
    rows = [("r", f"f{i % 50}", "go", "function", "handle") for i in range(4000)] + [("r", "f1", "go", "call", "other"), ("r", "f1", "go", "function", "other")]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = graph.entry_points(elements(*rows))
        assert found.count() == 4000 and found.filter("name <> 'handle'").count() == 0
        assert found.groupBy(F.spark_partition_id()).count().count() >= 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
