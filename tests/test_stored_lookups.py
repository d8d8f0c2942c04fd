import random

from pyspark.sql import functions as F

from srcatlas import model
from srcatlas.operators import graph, lookups


def rows_read(df):
    """Rows that the scan of a plan without exchanges took out of files."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def code_base(spark, n):
    kind = F.when(F.col("id") % 3 == 0, "function").otherwise("call")
    return spark.range(n).select(
        F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("repo"), F.concat(F.lit("p"), (F.col("id") % 1009).cast("string")).alias("path"),
        F.lit("go").alias("language"), kind.alias("kind"), F.col("id").cast("int").alias("ordinal"), F.lit("").alias("node_type"),
        F.concat(F.lit("name_"), F.md5((F.col("id") % 20_011).cast("string"))).alias("name"), *[F.lit(0).alias(c) for c in model.POSITION_COLUMNS])


def test_few_ids_read_few_row_groups(spark, tmp_path):
    n = 200_000
    elements = code_base(spark, n)
    path = str(tmp_path / "elements")
    lookups.write_elements(elements, path, row_group=200_000)
    stored = lookups.read_elements(spark, path)
    ten = [tuple(r) for r in elements.filter("kind = 'call'").select("repo", graph.node_id().alias("node_id")).limit(10).collect()]
    found = stored.filter(lookups._among("node_id", [i[1] for i in ten]))
    assert rows_read(found) < n / 2 and found.count() == 10
    names = [r["name"] for r in elements.filter("kind = 'function'").select("name").limit(3).collect()]
    named = lookups.functions_named(stored, names)
    assert rows_read(named) < n / 2
    assert sorted(r["node_id"] for r in named.collect()) == sorted(r[0] for r in elements.filter("kind = 'function'").filter(F.col("name").isin(names)).select(graph.node_id()).collect())
    many = lookups.functions_named(stored, [r["name"] for r in elements.select("name").distinct().limit(57).collect()])
    assert many.count() == elements.filter("kind = 'function'").join(many.select("name").distinct(), "name", "left_semi").count()


def test_stored_lookups_agree_with_the_graph(spark, tmp_path):
    elements = code_base(spark, 3000).withColumn("name", F.concat(F.lit("f"), (F.col("ordinal") % 700).cast("string")))
    path = str(tmp_path / "elements")
    lookups.write_elements(elements, path)
    stored = lookups.read_elements(spark, path)
    nodes = stored.select("repo", "node_id", "kind")
    for stored_lookup, lookup, kind in ((lookups.calls_from, graph.calls_from, "call"), (lookups.callers_of, graph.callers_of, "function")):
        ids = nodes.filter(F.col("kind") == kind).orderBy("node_id").limit(30)
        got = stored_lookup(stored, [tuple(r) for r in ids.select("repo", "node_id").collect()] + [("r0", "call:nowhere:x:1")])
        want = lookup(nodes, elements, ids)
        assert sorted(map(tuple, got.select("repo", "of", "node_id").collect())) == sorted(map(tuple, want.select("repo", "of", "node_id").collect())) != []
    assert lookups.calls_from(stored, [("r9", "none")]).count() == 0


def test_strings_against_a_loop(spark, tmp_path):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("ab\n 😀é%_") for _ in range(n))
    texts = [say(rng.randint(0, 30)) for _ in range(400)] + ["same text"] * 300 + ["", "ab" * 5000 + "needle"]
    nodes = spark.createDataFrame([("r", f"n{i}", "string", t) for i, t in enumerate(texts)] + [("r", "x", "call", "aab")], "repo string, node_id string, kind string, name string").repartition(4)
    path = str(tmp_path / "strings")
    lookups.write_string_index(nodes, path)
    patterns = ["", "a", "é", "ab", "😀a", "% ", "_", "a\n", "aba", "same", "e t", "needle", "zzz", "z", "bneedle", None] + [say(rng.randint(1, 6)) for _ in range(40)]
    found = lookups.strings_containing(spark, path, spark.createDataFrame([(p,) for p in patterns + patterns], "pattern string"))
    got = sorted((r["pattern"], r["node_id"]) for r in found.collect())
    assert got == sorted((p, f"n{i}") for p in set(patterns) - {None} for i, t in enumerate(texts) if p in t)
    assert found.columns == ["pattern", *nodes.columns]


def test_hot_run_is_many_rows(spark, tmp_path):
    """A run that all strings have is a posting for each 64 of them, not one list."""
    nodes = spark.range(20_000).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("node_id"), F.lit("string").alias("kind"), F.concat(F.lit("abc"), F.col("id")).alias("name"))
    path = str(tmp_path / "strings")
    lookups.write_string_index(nodes, path)
    runs = {r["run"]: r["words"] for r in spark.read.parquet(f"{path}/runs").filter("run in ('abc', '')").collect()}
    assert runs["abc"] == runs[""] >= 20_000 // 64
    pattern = spark.createDataFrame([("abc12345",)], "pattern string")
    assert [r["node_id"] for r in lookups.strings_containing(spark, path, pattern).collect()] == ["12345"]
