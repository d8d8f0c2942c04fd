"""Stored lookups: elements that few row groups answer for, and a posting index over strings.

``write_elements`` sorts elements by repository, language and name and puts Bloom filters on ids
and names, so that a question for some ids or names opens only the row groups that may hold
them. ``write_string_index`` keeps, for every run of up to three characters, which strings hold
it, as words of 64 bits; many patterns are answered in one pass that opens the candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.operators.graph import CALL_KEY, node_id, resolved_pairs
from srcatlas.session import cut

#: Bytes of a row group of the stored elements.
ROW_GROUP = 8 << 20
#: Values of one list that a scan compares with row groups; longer lists are put together from such.
LISTED = 10
#: Runs of a pattern whose postings are intersected, the rarest ones; what is left is verified.
RUNS = 4
#: Characters of the longest runs that are indexed.
LONGEST = 3


# ---- elements by id and name -----------------------------------------------------


def write_elements(elements: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    """Store elements with their node ids, in order of repository, language and name."""
    order = [*CALL_KEY, "node_id"]
    rows = elements.withColumn("node_id", node_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.write.option("parquet.block.size", row_group)
    for column in ("node_id", "name"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _among(column: str, values: list[str]) -> Column:
    """A filter that the scan can hold against row groups, however many values there are."""
    values = sorted(set(values))
    out = F.lit(False)
    for i in range(0, len(values), LISTED):
        part = F.col(column).isin(values[i:i + LISTED])
        out = part if i == 0 else out | part
    return out


def functions_named(stored: DataFrame, names: list[str]) -> DataFrame:
    """The functions of some names in all repositories."""
    return stored.filter((F.col("kind") == "function") & _among("name", names))


def _resolved(stored: DataFrame, ids: list[tuple[str, str]], at: str, to: str) -> DataFrame:
    asked = stored.sparkSession.createDataFrame([*set(ids)], "repo string, node_id string")
    some = stored.filter((F.col("kind") == at) & _among("repo", [i[0] for i in ids]) & _among("node_id", [i[1] for i in ids]))
    here = cut(some.join(asked, ["repo", "node_id"], "left_semi"))  # as many rows as the caller's list has, about
    names = here.select(*CALL_KEY).distinct()
    listed = [r["name"] for r in names.select("name").distinct().collect()]
    there = stored.filter((F.col("kind") == to) & _among("repo", [i[0] for i in ids]) & _among("name", listed)).join(names, CALL_KEY, "left_semi")
    pairs = resolved_pairs(here.unionByName(there))
    found = pairs.select("repo", F.col(f"{at}.node_id").alias("of"), F.col(f"{to}.node_id").alias("node_id"))
    return found.join(there, ["repo", "node_id"])


def calls_from(stored: DataFrame, ids: list[tuple[str, str]]) -> DataFrame:
    """Functions that some calls (repo, node_id) can mean, with the call as ``of``."""
    return _resolved(stored, ids, "call", "function")


def callers_of(stored: DataFrame, ids: list[tuple[str, str]]) -> DataFrame:
    """Calls that can mean some functions (repo, node_id), which come back as ``of``."""
    return _resolved(stored, ids, "function", "call")


# ---- strings by what they hold ---------------------------------------------------


def _runs(text: str) -> Column:
    """The distinct runs of up to LONGEST characters of a text, and the empty one, which all texts have."""
    parts = ", ".join(f"regexp_extract_all({text}, '(?s)(?=(.{{{k}}}))', 1)" for k in range(1, LONGEST + 1))
    return F.expr(f"array_distinct(concat(array(''), {parts}))")


def write_string_index(nodes: DataFrame, path: str) -> None:
    """Under ``path``: the strings among the nodes with numbers, postings of runs, and how long each is.

    Strings of one text stand side by side, so that their bits fall in the same words. A posting is a
    row for each 64 numbers, so no run has a list that has to fit anywhere.
    """
    spark = nodes.sparkSession
    strings = nodes.filter("kind = 'string'").repartitionByRange("name", "repo", "node_id").sortWithinPartitions("name", "repo", "node_id")
    strings.withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{path}/strings")
    numbered = spark.read.parquet(f"{path}/strings").select("name", "number")
    # Equal texts of a word have equal runs: they are cut up once.
    words = numbered.groupBy("name", F.shiftright("number", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(number & 63 as int))")).alias("bits"))
    postings = words.select(F.explode(_runs("name")).alias("run"), "word", "bits").groupBy("run", "word").agg(F.bit_or("bits").alias("bits"))
    postings.repartitionByRange("run", "word").sortWithinPartitions("run", "word").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("run").agg(F.count("*").alias("words")).write.parquet(f"{path}/runs")


def strings_containing(spark: SparkSession, path: str, patterns: DataFrame) -> DataFrame:
    """pattern and the string nodes that hold it literally, case-sensitive; ``patterns`` has a column pattern.

    Postings of a pattern's rarest runs are intersected, and the strings left are verified. A null
    pattern is in no string, the empty one in all.
    """
    asked = cut(patterns.select("pattern").filter("pattern IS NOT NULL").distinct())
    # A pattern shorter than the longest runs is a run itself.
    whole = f"regexp_extract_all(pattern, '(?s)(?=(.{{{LONGEST}}}))', 1)"
    wanted = asked.select("pattern", F.explode(F.expr(f"IF(length(pattern) < {LONGEST}, array(pattern), array_distinct({whole}))")).alias("run"))
    known = wanted.join(spark.read.parquet(f"{path}/runs"), "run", "left")  # a run that no string has: no words
    rarest = known.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("words", F.lit(0).cast("long")).alias("words"), "run"))).alias("runs"))
    chosen = cut(rarest.select("pattern", F.explode(F.slice("runs", 1, RUNS)).alias("r"), F.least(F.size("runs"), F.lit(RUNS)).alias("need")).select("pattern", "need", "r.run"))
    met = chosen.join(spark.read.parquet(f"{path}/postings"), "run").groupBy("pattern", "word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"), F.first("need").alias("need"))
    bits = F.expr("transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> shiftleft(word, 6) + i)")
    candidates = met.filter("n = need AND bits <> 0").select("pattern", F.explode(bits).alias("number"))
    strings = spark.read.parquet(f"{path}/strings")
    return candidates.join(strings, "number").filter(F.contains("name", F.col("pattern"))).drop("number")
