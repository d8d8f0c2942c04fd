"""The code graph: nodes, edges, call resolution, lookups, reachability, statistics.

``elements`` is the compact form of the graph. Call edges pair every call with
every function of its name and language in the repository, so their number can
grow with the product of both. Whatever needs only counts, membership or
reachability works on the (repo, language, name) key instead and never forms
the pairs: ``entry_points``, ``graph_stats``, ``traversal_edges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas import model
from srcatlas.session import cut

CALL_KEY = ["repo", "language", "name"]

# Calls or functions of one name that meet in one share of the join.
ROWS_PER_SHARE = 3000

# Tasks that functions of one name go to, where free names are looked for.
SALTS = 16

# Above this many edges a source node is fanned out over intermediate nodes.
FAN_OUT = 100_000


# The forms of node ids.
def file_id(path: Column | str = "path") -> Column:
    return F.concat(F.lit("file:"), path if isinstance(path, Column) else F.col(path))


def node_id(prefix: str = "") -> Column:
    """Node id of an element row: its kind, path, name (not for strings) and ordinal."""
    kind, path, name, ordinal = (F.col(prefix + c) for c in ("kind", "path", "name", "ordinal"))
    tag = F.when(kind == "function", "func").when(kind == "string", "str").otherwise(kind)
    # A literal's text is not part of its id.
    middle = F.when(kind == "string", F.lit(":")).otherwise(F.concat(F.lit(":"), name, F.lit(":")))
    return F.concat(tag, F.lit(":"), path, middle, ordinal.cast("string"))


def _element_nodes(elements: DataFrame) -> DataFrame:
    return elements.select(
        "repo", node_id().alias("node_id"), "kind", "name", F.col("path").alias("file"),
        "language", *model.POSITION_COLUMNS,
    )


def _file_nodes(files: DataFrame) -> DataFrame:
    zero = [F.lit(0).alias(c) for c in model.POSITION_COLUMNS]
    return files.select(
        "repo", file_id().alias("node_id"), F.lit("file").alias("kind"), F.col("path").alias("name"),
        F.col("path").alias("file"), "language", *zero,
    )


def _may_share_id(path: Column, name: Column, kind: Column) -> Column:
    """Ids run together only where a colon stands in a path or in a name that is part of the id."""
    return F.contains(path, F.lit(":")) | ((kind != "string") & F.contains(name, F.lit(":")))


def build_nodes(files: DataFrame, elements: DataFrame) -> DataFrame:
    """One node per file and per element; an id that occurs twice is kept once.

    Only the rows whose id may be shared are shuffled to look for duplicates.
    ``files`` must be unique by (repo, path), see ``duplicate_paths``.
    """
    nodes = _element_nodes(elements)
    risky = _may_share_id(F.col("file"), F.col("name"), F.col("kind"))
    values = [c for c in nodes.columns if c not in ("repo", "node_id")]
    once = (
        nodes.filter(risky)
        .groupBy("repo", "node_id")
        .agg(F.max_by(F.struct(*values), F.struct("file", "name")).alias("n"))
        .select("repo", "node_id", *[F.col(f"n.{c}").alias(c) for c in values])
    )
    return _file_nodes(files).unionByName(nodes.filter(~risky)).unionByName(once)


def duplicate_paths(files: DataFrame) -> DataFrame:
    """(repo, path) values that occur more than once: repo, path, copies."""
    return files.groupBy("repo", "path").agg(F.count("*").alias("copies")).filter("copies > 1")


def structure_edges(elements: DataFrame) -> DataFrame:
    """Edges between an element and its file; a file points at its imports."""
    is_import = F.col("kind") == "import"
    return elements.select(
        "repo",
        F.when(is_import, file_id()).otherwise(node_id()).alias("src"),
        F.when(is_import, node_id()).otherwise(file_id()).alias("dst"),
        F.when(is_import, "imports")
        .when(F.col("kind") == "function", "defined_in")
        .otherwise("contains")
        .alias("kind"),
    )


def _heavy_names(elements: DataFrame, rows_per_share: int) -> DataFrame:
    """Names with more calls or functions than a share, and into how many shares each side is split; a written table."""
    counts = (
        elements.filter(F.col("kind").isin("call", "function"))
        .groupBy(*CALL_KEY)
        .agg(
            F.count_if(F.col("kind") == "call").alias("calls"),
            F.count_if(F.col("kind") == "function").alias("functions"),
        )
    )
    heavy = counts.filter((F.col("calls") > rows_per_share) | (F.col("functions") > rows_per_share))
    return cut(heavy.select(
        *CALL_KEY, F.ceil(F.col("calls") / rows_per_share).alias("call_shares"),
        F.ceil(F.col("functions") / rows_per_share).alias("function_shares"),
    ))


def resolved_pairs(elements: DataFrame, rows_per_share: int = ROWS_PER_SHARE) -> DataFrame:
    """Every call with every function of its name and language in its repository.

    Columns ``repo``, ``language``, ``name``, then ``call`` and ``function`` structs
    (node_id, path, start_row). Names with more than ``rows_per_share`` calls or functions
    are heavy: both their sides are split into shares by their counts, and every call share
    meets every function share, so no key has more than about that many rows of a side. Heavy names without
    a call or without a function have no share on that side and go no further. All other names meet in one plain join.
    """
    side = F.struct(node_id().alias("node_id"), F.col("path"), F.col("start_row"))
    heavy = _heavy_names(elements, rows_per_share)

    def rows(kind: str) -> DataFrame:
        return elements.filter(F.col("kind") == kind).select(*CALL_KEY, side.alias(kind)).join(heavy, CALL_KEY, "left")

    def light(kind: str) -> DataFrame:
        return rows(kind).filter("call_shares IS NULL").drop("call_shares", "function_shares")

    def shared(kind: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(f"{kind}.node_id"), F.col(f"{own}_shares"))
        parts = F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_shares") - 1)
        return rows(kind).filter("call_shares > 0 AND function_shares > 0").select(
            *CALL_KEY, kind, part.alias(f"{own}_share"), F.explode(parts).alias(f"{other}_share"))

    key = [*CALL_KEY, "call_share", "function_share"]
    split = shared("call", "call", "function").join(shared("function", "function", "call"), key).drop("call_share", "function_share")
    return light("call").join(light("function"), CALL_KEY).unionByName(split)


def resolve_calls(elements: DataFrame, rows_per_share: int = ROWS_PER_SHARE) -> DataFrame:
    """``calls`` edges: repo, src (call node), dst (function node), kind."""
    return resolved_pairs(elements, rows_per_share).select(
        "repo",
        F.col("call.node_id").alias("src"),
        F.col("function.node_id").alias("dst"),
        F.lit("calls").alias("kind"),
    )


def build_edges(elements: DataFrame) -> DataFrame:
    return structure_edges(elements).unionByName(resolve_calls(elements))


def call_graph(elements: DataFrame) -> DataFrame:
    """Resolved calls with file and 1-based line of both ends."""
    return resolved_pairs(elements).select(
        "repo",
        F.col("name").alias("from_name"),
        F.col("call.path").alias("from_file"),
        (F.col("call.start_row") + 1).alias("from_line"),
        F.col("name").alias("to_name"),
        F.col("function.path").alias("to_file"),
        (F.col("function.start_row") + 1).alias("to_line"),
    )


def entry_points(elements: DataFrame) -> DataFrame:
    """Functions that no call in the repository can mean: repo, name, file, line, node_id.

    Which names are free is found on distinct names. Functions meet the free names under a salt, so a
    name that most of them have is work for ``SALTS`` tasks.
    """
    distinct = {kind: elements.filter(F.col("kind") == kind).select(*CALL_KEY).distinct() for kind in ("call", "function")}
    free = distinct["function"].join(distinct["call"], CALL_KEY, "left_anti").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("path", "ordinal"), F.lit(SALTS)).cast("int")
    return (
        elements.filter("kind = 'function'").withColumn("salt", salt)
        .join(free, [*CALL_KEY, "salt"], "left_semi")
        .select(
            "repo", "name", F.col("path").alias("file"),
            (F.col("start_row") + 1).alias("line"), node_id().alias("node_id"),
        )
    )


# ---- lookups ---------------------------------------------------------------------


def nodes_of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind)


def functions_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter((F.col("kind") == "function") & (F.col("name") == name))


def strings_containing(nodes: DataFrame, text: str) -> DataFrame:
    """String nodes that hold ``text`` literally, case-sensitive."""
    return nodes.filter((F.col("kind") == "string") & F.contains(F.col("name"), F.lit(text)))


def _neighbours(nodes: DataFrame, elements: DataFrame, ids: DataFrame, at: str, to: str) -> DataFrame:
    """From the wanted elements to their names, and only to what has these names."""
    wanted = ids.select("repo", "node_id").distinct()
    here = elements.filter(F.col("kind") == at).withColumn("node_id", node_id()).join(wanted, ["repo", "node_id"], "left_semi").drop("node_id")
    there = elements.filter(F.col("kind") == to).join(here.select(*CALL_KEY).distinct(), CALL_KEY, "left_semi")
    pairs = resolved_pairs(here.unionByName(there.select(*here.columns)))
    found = pairs.select("repo", F.col(f"{at}.node_id").alias("of"), F.col(f"{to}.node_id").alias("node_id"))
    return found.join(nodes, ["repo", "node_id"], "inner")


def calls_from(nodes: DataFrame, elements: DataFrame, ids: DataFrame) -> DataFrame:
    """Functions that each call in ``ids`` (repo, node_id) can mean; the call comes back as ``of``."""
    return _neighbours(nodes, elements, ids, "call", "function")


def callers_of(nodes: DataFrame, elements: DataFrame, ids: DataFrame) -> DataFrame:
    """Calls that can mean each function in ``ids`` (repo, node_id), which comes back as ``of``."""
    return _neighbours(nodes, elements, ids, "function", "call")


# ---- reachability ----------------------------------------------------------------


def traversal_edges(elements: DataFrame) -> DataFrame:
    """Edges for ``reachable`` whose number is linear in the elements.

    A call leads to an intermediate ``name:`` node and that one to the functions,
    so calls x functions pairs are never formed. Intermediate nodes are walked but
    are no nodes of the graph, and so never part of a result.
    """
    hub = F.concat(F.lit("name:"), F.col("language"), F.lit(":"), F.col("name"))
    is_call = F.col("kind") == "call"
    through_name = elements.filter(F.col("kind").isin("call", "function")).select(
        "repo",
        F.when(is_call, node_id()).otherwise(hub).alias("src"),
        F.when(is_call, hub).otherwise(node_id()).alias("dst"),
        F.lit("calls").alias("kind"),
    )
    return structure_edges(elements).unionByName(through_name)


def fan_out(edges: DataFrame, limit: int = FAN_OUT) -> DataFrame:
    """Share the edges of each source with more than ``limit`` of them among intermediate nodes.

    Reachability stays the same, and no join key has more than about ``limit``
    rows. Returns repo, src, dst as a written table.
    """
    edges = cut(edges.select("repo", "src", "dst"))
    heavy = (
        edges.groupBy("repo", "src").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        .select("repo", "src", F.ceil(F.col("n") / limit).cast("int").alias("ways"))
    )
    if heavy.isEmpty():
        return edges
    heavy = cut(heavy)
    # Salted by target, so that the join itself has no hot key either.
    way = F.pmod(F.xxhash64("dst"), F.lit(1024)).cast("int")
    salted = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(1023))))
    marked = edges.withColumn("salt", way).join(salted, ["repo", "src", "salt"], "left")

    def between(number: Column) -> Column:
        return F.concat(F.lit("via:"), number.cast("string"), F.lit(":"), F.col("src"))

    lower = marked.select(
        "repo",
        F.coalesce(between(F.pmod(F.xxhash64("dst"), F.col("ways").cast("bigint"))), F.col("src")).alias("src"),
        "dst",
    )
    upper = heavy.select(
        "repo", "src", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way")
    ).select("repo", "src", between(F.col("way")).alias("dst"))
    return cut(lower.unionByName(upper))


def reachable(
    nodes: DataFrame,
    edges: DataFrame,
    starts: DataFrame,
    edge_kinds: list[str],
    fan_out_limit: int = FAN_OUT,
) -> DataFrame:
    """Nodes that can be reached from each start along edges of the given kinds.

    ``starts``: repo, node_id. Result: repo, start, then the node's columns. A start
    is never part of its own result; a target that is no node is walked but not
    returned. Breadth first, one round per distance: each round joins only the
    pairs found in the round before, and writes what is new to the shared folder,
    so the plan stays small and a lost executor costs no more than its own tasks.
    """
    steps = fan_out(edges.filter(F.col("kind").isin(edge_kinds)), fan_out_limit)
    begin = starts.select("repo", F.col("node_id").alias("start")).distinct()
    frontier = begin.withColumn("node_id", F.col("start"))
    rounds: list[DataFrame] = []
    seen = frontier = cut(frontier)
    while True:
        step = (
            frontier.withColumnRenamed("node_id", "src")
            .join(steps, ["repo", "src"], "inner")
            .select("repo", "start", F.col("dst").alias("node_id"))
            .distinct()
            .join(seen, ["repo", "start", "node_id"], "left_anti")
        )
        frontier = cut(step)
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        seen = seen.unionByName(frontier)
        if len(rounds) % 16 == 0:  # keep the union's plan short on long chains
            seen = cut(seen)
    found = begin.sparkSession.createDataFrame([], begin.withColumn("node_id", F.col("start")).schema)
    for part in rounds:
        found = found.unionByName(part)
    return found.join(nodes, ["repo", "node_id"], "inner").select(
        "repo", "start", *[c for c in nodes.columns if c != "repo"]
    )


# ---- statistics ------------------------------------------------------------------


_ELEMENT_COUNTS = {"functions": "function", "calls": "call", "imports": "import", "strings": "string"}


def _shared_ids(elements: DataFrame) -> DataFrame:
    """repo, and per kind how many elements have an id that another one has too."""
    same = (
        elements.filter(_may_share_id(F.col("path"), F.col("name"), F.col("kind")))
        .groupBy("repo", "kind", node_id().alias("node_id"))
        .agg((F.count("*") - 1).alias("extra"))
        .filter("extra > 0")
    )
    return same.groupBy("repo").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("extra")).otherwise(0)).alias(f"extra_{n}")
          for n, k in _ELEMENT_COUNTS.items()]
    )


def graph_stats(files: DataFrame, elements: DataFrame) -> DataFrame:
    """Per repository: nodes, edges, files, functions, calls, imports, strings, resolved_calls.

    Repositories come from ``files``; one without elements has zeros. Resolved calls
    are call edges; their number is the sum over names of calls x functions, so one
    pass that counts per name gives everything, whatever the number of edges.
    """
    named = F.when(F.col("kind").isin("call", "function"), F.col("name"))
    per_name = elements.groupBy("repo", "language", named.alias("name")).agg(
        *[F.count_if(F.col("kind") == k).alias(n) for n, k in _ELEMENT_COUNTS.items()]
    )
    counts = per_name.groupBy("repo").agg(
        *[F.sum(n).alias(n) for n in _ELEMENT_COUNTS],
        F.sum(F.col("calls") * F.col("functions")).alias("resolved_calls"),
    )
    all_counts = files.groupBy("repo").agg(F.count("*").alias("files")).join(counts, "repo", "left")
    all_counts = all_counts.join(_shared_ids(elements), "repo", "left").na.fill(0)
    raw = sum((F.col(n) for n in _ELEMENT_COUNTS), F.lit(0))
    single = {n: F.col(n) - F.col(f"extra_{n}") for n in _ELEMENT_COUNTS}
    return all_counts.select(
        "repo",
        sum(single.values(), F.col("files")).alias("nodes"),
        # Every element has one edge to or from its file.
        (raw + F.col("resolved_calls")).alias("edges"),
        "files",
        *[c.alias(n) for n, c in single.items()],
        "resolved_calls",
    )
