"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is a run of consecutive words of an item (the whole item where it is shorter). Its word
shingles are ordered by rarity over all documents. A document that holds the window holds every
shingle of it, so the rarest one is a sufficient prefix for exact containment, and a window with a
shingle that no document has is given up at once. Documents offer their windows around prefix
tokens only, at the token's place in the window (positional bound) and inside the text (length
bound); what is left is joined on token, place, size and the words themselves.

Which shingles are looked for goes to the tasks as bitmaps of fixed size (``sieve.BITMAP_BITS``): a
larger benchmark makes them let more through, never less, and the join decides. So nothing that
grows with a table is broadcast or collected. Equal windows of a task are offered once, with their
places, so a passage that a third of all documents share is no hot key.

Contracts. A null or wordless text has no words and no hits; a null or wordless item no windows.
Words: runs of bytes that are ASCII digits, ASCII letters (in lower case) or not ASCII. Each row is
a document of its own, whatever its doc_id (repeated or null). Repeated items count by distinct
item_id, compared as text; null item_ids are left out of the list of items. Other columns are
ignored. Without documents there is no row, without items there are no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm import bytekit
from srcatlas.llm.frames import plainly
from srcatlas.llm.sieve import bitmap, marked
from srcatlas.session import cut

SHINGLE = 3
#: Bytes between words: 0x00-0x2F, 0x3A-0x60 (after lower-casing) and 0x7B-0x7F.
LETTERS = bytekit.byte_set([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def _window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for j in range(size):
        out += bytekit.mix(hashes[starts + j] + bytekit._STEPS[j]) * bytekit._STEPS[j]
    return bytekit.mix(out + np.uint64(size))


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id (as text), words of the window, size, hash, and its shingles in order."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for texts in bytekit.chunks(batch.column(1)):
                data = texts.data = bytekit.LOWER[texts.data]
                w = bytekit.words(texts, LETTERS)
                hashes = bytekit.span_hashes(data, w.begin, w.end)
                out = []
                for i, row in enumerate(texts.rows):
                    first, last = int(w.first[i]), int(w.first[i + 1])
                    size = min(window, last - first)
                    if size:
                        own = bytekit.shingles(hashes[first:last], min(shingle, size)).view(np.int64)
                        keys = _window_hashes(hashes, np.arange(first, last - size + 1), size).view(np.int64)
                        spans = [data[w.begin[j]:w.end[j]].tobytes().decode("utf-8", "replace") for j in range(first, last)]
                        for s in range(last - first - size + 1):
                            out.append((ids[int(row)].as_py(), " ".join(spans[s:s + size]), size, int(keys[s]), own[s:s + size - min(shingle, size) + 1].tolist()))
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "words", "size", "hash", "shingles"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "item_id string, words string, size int, hash long, shingles array<long>")


def shingle_counts(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """How often each marked shingle occurs in all documents: hash, n."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            for texts in bytekit.chunks(batch.column(0)):
                data = texts.data = bytekit.LOWER[texts.data]
                w = bytekit.words(texts, LETTERS)
                hashes = bytekit.span_hashes(data, w.begin, w.end)
                own = bytekit.owner(w.first, len(hashes))
                for k in sizes:
                    h = bytekit.shingles(hashes, k)
                    if len(h):
                        h = h[marked(sent.value, h) & (own[:len(h)] == own[k - 1:])]
                        seen, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, prefixes: np.ndarray, windows: np.ndarray, sizes: list[int], shingle: int) -> DataFrame:
    """doc_id, n_words and the windows around prefix tokens: start, size, words, tokens (hash, place)."""
    sent = docs.sparkSession.sparkContext.broadcast((prefixes, windows))
    token = pa.struct([("hash", pa.int64()), ("place", pa.int32())])
    offer = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("words", pa.string()), ("tokens", pa.list_(token))])

    def run(batches):
        prefixes, windows = sent.value
        for batch in batches:
            for texts in bytekit.chunks(batch.column(1)):
                data = texts.data = bytekit.LOWER[texts.data]
                w = bytekit.words(texts, LETTERS)
                hashes = bytekit.span_hashes(data, w.begin, w.end)
                own = bytekit.owner(w.first, len(hashes))
                offers: list[list[dict]] = [[] for _ in texts.rows]
                for size in sizes:
                    k = min(shingle, size)
                    n = len(hashes) - size + 1
                    if n <= 0:
                        continue
                    h = bytekit.shingles(hashes, k)
                    tokens = marked(prefixes, h)
                    sums = np.zeros(len(h) + 1, np.int64)
                    np.cumsum(tokens, out=sums[1:])
                    starts = np.flatnonzero((sums[size - k + 1:][:n] > sums[:n]) & (own[:n] == own[size - 1:]))
                    starts = starts[marked(windows, _window_hashes(hashes, starts, size))]
                    for s in starts.tolist():
                        spans = b" ".join(data[w.begin[j]:w.end[j]].tobytes() for j in range(s, s + size))
                        places = np.flatnonzero(tokens[s:s + size - k + 1])
                        offers[own[s]].append({"start": s - int(w.first[own[s]]), "size": size, "words": spans.decode("utf-8", "replace"), "tokens": [
                            {"hash": int(h[s + p].view(np.int64)), "place": int(p)} for p in places]})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts.rows)), pa.array(np.diff(w.first)), pa.array(offers, pa.list_(offer))], ["doc_id", "n_words", "offers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_words long, offers array<struct<start:int,size:int,words:string,tokens:array<struct<hash:long,place:int>>>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted), spans (start, size in words)."""
    own = cut(item_windows(items, window, shingle))
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # at most ``window`` values
    lengths = sorted({min(shingle, s) for s in sizes})
    counts = shingle_counts(docs, bitmap(own.select(F.explode("shingles").alias("hash"))), lengths)
    distinct = own.groupBy("words", "size", "hash").agg(F.first("shingles").alias("shingles"))
    placed = distinct.select("words", "size", F.col("hash").alias("key"), F.posexplode("shingles").alias("place", "hash"))
    rarest = (
        placed.join(counts, "hash", "left")
        .groupBy("words", "size", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("least"))
        .where("least.n > 0").select("words", "size", "key", F.col("least.hash").alias("hash"), F.col("least.place").alias("place"))
    )
    prefixes = cut(rarest)
    offered = cut(candidates(docs, bitmap(prefixes.select("hash")), bitmap(prefixes.select(F.col("key").alias("hash"))), sizes, shingle)
                  .withColumn("row", F.monotonically_increasing_id()))
    places = offered.where(F.size("offers") > 0).select("row", F.explode("offers").alias("o")).select("row", "o.*")
    met = (
        places.select("words", "size", F.explode("tokens").alias("t")).select("words", "size", "t.hash", "t.place").distinct()
        .join(prefixes.drop("key"), ["words", "size", "hash", "place"], "left_semi").select("words", "size").distinct()
    )
    hits = places.drop("tokens").join(met, ["words", "size"], "left_semi")
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"))
    holders = own.where("item_id is not null").select("words", "size", "item_id").distinct()
    named = hits.select("row", "words", "size").distinct().join(holders, ["words", "size"]).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.expr("""aggregate(spans, struct(0 as upto, 0L as n), (a, x) -> struct(
        greatest(a.upto, x.start + x.size) as upto,
        a.n + cast(greatest(0, x.start + x.size - greatest(a.upto, x.start)) as bigint) as n), a -> a.n)""")
    return (
        offered.drop("offers").join(spans, "row", "left").join(named, "row", "left")
        .select("doc_id", "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"))
        .withColumn("n_items", F.size("items").cast("long"))
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit, all columns as they are."""

    def kept(plain: DataFrame) -> DataFrame:
        numbered = cut(plain.withColumn("__row", F.monotonically_increasing_id()))
        hit = contamination(numbered.select(F.col("__row").alias("doc_id"), "text"), items).where("n_hit > 0").select(F.col("doc_id").alias("__row"))
        return numbered.join(hit, "__row", "left_anti").drop("__row")

    return plainly(docs, ("doc_id", "text"), kept)
