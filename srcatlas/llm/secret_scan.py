"""Secret scans: character Markov models of random strings and of ordinary identifiers.

Two first-order models over ASCII characters, one of random strings and one of ordinary
identifiers, give every candidate token a log-likelihood ratio; tokens above a threshold per
character are spans of kind ``random``. Both are counted from labelled samples: values of the base
patterns are the random strings, long words without a digit the ordinary ones. To these come the
base kinds assign, access and hex, the leftmost non-overlapping matches of their patterns.

Everything is built-in SQL: matches and the gaps between them give positions, an array literal of
128 x 128 log ratios scores a token. Counting looks at ``SAMPLE`` documents, chosen by a hash of
doc_id; the driver gets at most 2 x 128 x 128 counts. Scanning covers all whole texts, in one pass
without a shuffle; texts without a match cost one search per kind.

Contracts. A null text is empty. Offsets count code points, ends are exclusive. Repeated rows give
repeated results; other columns are ignored. With no labelled sample of a side its model is uniform.
Spans are ordered by start, then kind as listed. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidate tokens of the models.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Documents that the models are counted from, about.
SAMPLE = 20_000
#: Matches whose positions are added up at once.
PIECE = 256
SPAN = "array<struct<start:int,no:int,kind:string,end:int,value:string>>"
#: Log-likelihood ratio per character, in nats, from which a token counts as random.
THRESHOLD = 0.35


def matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_quoted(pattern)}, {group})"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(kind: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    """SQL for the spans of a pattern in the column ``text``: start, kind's number, kind, end, value.

    Gaps and matches alternate, so their lengths add up to positions: in pieces of ``PIECE`` matches
    first, then over the pieces, as an aggregate copies what it has found so far at every step.
    ``keep`` filters by x.`2`, the value.
    """
    found = matches("text", pattern)
    zipped = f"arrays_zip(slice(split(text, {_quoted(pattern)}, -1), 1, size({found})), {found}, {matches('text', pattern, group)})"
    piece = f"""aggregate(slice(z, cast(i * {PIECE} + 1 as int), {PIECE}), struct(0 as at, cast(array() as {SPAN}) as found),
        (a, x) -> struct(a.at + length(x.`0`) + length(x.`1`) as at, if({keep}, concat(a.found, array(struct(
            a.at + length(x.`0`) as start, {KINDS.index(kind)} as no, '{kind}' as kind, a.at + length(x.`0`) + length(x.`1`) as end, x.`2` as value))), a.found) as found))"""
    before = "aggregate(p, struct(0 as at, cast(array() as array<int>) as starts), (a, x) -> struct(a.at + x.at as at, concat(a.starts, array(a.at)) as starts), a -> a.starts)"
    moved = f"""flatten(zip_with(p, {before}, (x, o) -> transform(x.found, f -> struct(
        f.start + o as start, f.no as no, f.kind as kind, f.end + o as end, f.value as value))))"""
    whole = f"get(transform(array({zipped}), z -> get(transform(array(transform(sequence(0L, (size(z) - 1) div {PIECE}), i -> {piece})), p -> {moved}), 0)), 0)"
    return f"if(text rlike {_quoted(pattern)}, {whole}, cast(array() as {SPAN}))"


def base_spans() -> dict[str, str]:
    return {"assign": spans("assign", ASSIGN, "length(x.`2`) >= 6", 2), "access": spans("access", ACCESS), "hex": spans("hex", HEX)}


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """128 x 128 log ratios of following characters, random over ordinary, from labelled samples."""
    rows = texts(docs)
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) < math.ceil(min(1.0, sample / max(1, n)) * (1 << 20)))
    values = " , ".join(f"transform({s}, x -> x.value)" for s in base_spans().values())
    labelled = part.select(
        F.expr(f"flatten(array({values}))").alias("random"),
        F.expr(f"array_distinct({matches('text', '[A-Za-z_-]{8,}')})").alias("ordinary"),
    ).selectExpr("inline(array(struct(true as label, random as tokens), struct(false as label, ordinary as tokens)))").selectExpr("label", "explode(tokens) as token")
    letters = labelled.selectExpr("label", "split(token, '') as c").where("size(c) > 1")
    pairs = letters.selectExpr("label", "explode(transform(sequence(1, size(c) - 1), i -> ascii(c[i - 1]) * 128 + ascii(c[i]))) as pair")
    counts = {True: [0] * (128 * 128), False: [0] * (128 * 128)}
    for r in pairs.where("pair < 16384").groupBy("label", "pair").count().collect():
        counts[r["label"]][r["pair"]] = r["count"]

    def logs(own: list[int]) -> list[float]:
        out = []
        for a in range(128):
            row = own[a * 128:(a + 1) * 128]
            total = sum(row) + 0.1 * 128
            out += [math.log((c + 0.1) / total) for c in row]
        return out

    return [round(a - b, 4) for a, b in zip(logs(counts[True]), logs(counts[False]))]


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and its spans (start, no, kind, end), by start and kind."""
    table = "cast(split('" + ",".join(f"{x:g}" for x in ratios) + "', ',') as array<float>)"
    score = f"""element_at(transform(array(split(x.value, '')), c -> aggregate(sequence(1, size(c) - 1), 0D, (s, i) ->
        s + element_at({table}, 1 + ascii(c[i - 1]) * 128 + ascii(c[i]))) / (size(c) - 1)), 1)"""
    found = {**base_spans(), "random": spans("random", CANDIDATE)}
    rows = texts(docs).withColumns({k: F.expr(v) for k, v in found.items()})
    keep = F.expr(f"filter(random, x -> {score} > {threshold})")
    every = F.concat("assign", "access", "hex", keep)
    ordered = rows.select("doc_id", F.array_sort(every).alias("found"))
    return ordered.select("doc_id", F.expr("transform(found, x -> named_struct('start', x.start, 'no', x.no, 'kind', x.kind, 'end', x.end))").alias("spans"))


def joined(condition: str = "true") -> Column:
    return F.expr(f"array_join(transform(filter(spans, x -> {condition}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    out = scan(docs, train(docs))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined("x.no < 3"), 256).alias("base_sha256"), joined().alias("spans"))
