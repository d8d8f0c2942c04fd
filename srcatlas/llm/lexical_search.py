"""Ranked lexical search: an index of compressed posting blocks, read by Block-Max MaxScore.

``build_index`` turns documents into segments of bounded size inside the tasks that read them, so
nothing is shuffled. A segment's terms are rows: a posting list in blocks of ``BLOCK`` documents, each
compressed by itself, and for every block its last document, largest term frequency and shortest
document. From these two follows a bound on any score in the block whatever the corpus statistics
are, so the index holds no figure that a later segment would change.

``search`` takes the wanted lists of a segment into one task and evaluates items over windows of
documents. The lists' global bounds, in ascending order, are summed as long as they stay under the
item's k-th score so far: those lists are non-essential, for a document that is in them alone cannot
enter. Documents of the essential lists are scored; for them the other lists follow from the
largest bound down, and a document whose score, block maximum and bounds to come stay under the
k-th score goes before the block is decompressed. Bounds are integers with the rounding of the scores, and
only what is strictly under the k-th score goes, so results are exact, ties included. The heaps of
a task's segments are one per item; those of all tasks are merged by a window.

Scores are integers. Terms: runs of ASCII digits, ASCII letters (A-Z in lower case) and characters
that are not ASCII. N counts documents with a term, L all their terms, n one document's, df the
documents with a term, tf its occurrences in one. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1)));
m = 10 + (90 n N) div L; the score is the sum of w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms.

Contracts. doc_id is an integer column; each row is a document, equal doc_ids included; rows with a
null doc_id or without a term (null or empty text) are not indexed and count nowhere. Rows of one
item_id are one item, a null item_id is none. Items with the same terms get the same answers. Ties go to the
smaller doc_id. Items without a hit, and empty tables, give no rows. Other columns are ignored.
Items are worked on in blocks of bounded size, so neither table is broadcast or collected whole.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from srcatlas.llm import bytekit
from srcatlas.llm.sieve import grouped
from srcatlas.session import cut

#: Bytes between terms: 0x00-0x2F, 0x3A-0x40, 0x5B-0x60 and 0x7B-0x7F.
LETTERS = bytekit.byte_set([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: A segment is closed at so many bytes of text or documents.
SEGMENT_BYTES, SEGMENT_DOCS = 16 << 20, 1 << 14
BLOCK = 64
#: Documents that are scored between two looks at the k-th score.
WINDOW = 2048
#: Bytes of items' terms that a search job takes along.
ITEMS_BYTES = 4 << 20

INDEX_NAMES = ["segment", "term", "df", "cf", "heads", "postings"]
INDEX = "segment long, term string, df long, cf long, heads binary, postings binary"
#: Columns of a block's head: last document, largest tf, shortest document, place of its bytes, widths.
HEAD = 5


def _grouped_terms(texts: bytekit.Texts):
    """Postings (hash, text, tf) sorted by hash, and the distinct terms' hashes, bytes and second hashes."""
    data = bytekit.LOWER[texts.data]
    w = bytekit.words(texts, LETTERS)
    hashes = bytekit.span_hashes(data, w.begin, w.end)
    own = bytekit.owner(w.first, len(hashes))
    order = np.argsort(hashes, kind="stable")  # within a hash the texts ascend
    h, o = hashes[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    first = np.ones(len(at), bool)
    first[1:] = h[at][1:] != h[at][:-1]
    spans = order[at[first]]
    return h[at], o[at], tf, hashes[spans], data, w.begin[spans], w.end[spans], np.diff(w.first)


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sizes = end - begin
    return data[np.repeat(begin, sizes) + bytekit.ranges(sizes)]


class Segment:
    """Postings of some documents, until they are handed out as index rows."""

    def __init__(self, most: int = SEGMENT_DOCS):
        self.most = most
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.terms: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.bytes = 0

    def add(self, ids: np.ndarray, texts: bytekit.Texts) -> bool:
        h, own, tf, distinct, data, begin, end, lengths = _grouped_terms(texts)
        some = lengths > 0
        place = np.cumsum(some) - 1 + self.docs
        self.postings.append((h, place[own].astype(np.int32), tf.astype(np.int32)))
        self.terms.append((distinct, end - begin, _spans(data, begin, end)))
        self.ids.append(ids[some])
        self.lengths.append(lengths[some])
        self.docs += int(some.sum())
        self.bytes += len(texts.data)
        return self.docs >= self.most or self.bytes >= SEGMENT_BYTES

    def rows(self, number: int):
        """Index rows; the row of the empty term holds doc_ids and lengths."""
        if not self.docs:
            return
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([""]), pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary())], INDEX_NAMES)
        h, doc, tf = (np.concatenate(c) for c in zip(*self.postings))
        order = np.argsort(h, kind="stable")
        h, doc, tf = h[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.diff(np.append(first, len(h)))
        names, sizes, flat = (np.concatenate(c) for c in zip(*self.terms))
        starts = np.cumsum(sizes) - sizes
        by = np.argsort(names, kind="stable")
        picked = by[np.concatenate([[True], names[by][1:] != names[by][:-1]])]
        blocks = -(-df // BLOCK)
        within = bytekit.ranges(blocks)
        begin = np.repeat(first, blocks) + within * BLOCK
        count = np.minimum(np.repeat(df, blocks) - within * BLOCK, BLOCK)
        last = doc[begin + count - 1]
        most, least = np.maximum.reduceat(tf, begin), np.minimum.reduceat(lengths[doc], begin)
        before = np.where(within > 0, np.append(0, last[:-1]), -1)
        gap = np.diff(doc, prepend=0)
        gap[begin] = doc[begin] - before
        widths = [np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4)) for x in (np.maximum.reduceat(gap, begin), most)]
        bytes_of = (widths[0] + widths[1]) * count
        place = np.cumsum(bytes_of) - bytes_of
        out = np.zeros(int(bytes_of.sum()), np.uint8)
        nth = bytekit.ranges(count)
        for base, values, width in ((place, gap, widths[0]), (place + widths[0] * count, tf, widths[1])):
            each = np.repeat(width, count)
            to = np.repeat(base, count) + nth * each
            for byte in range(4):
                some = np.flatnonzero(each > byte)
                out[to[some] + byte] = (values[some] >> (8 * byte)) & 255
        block_of_list = np.cumsum(blocks) - blocks
        begins = place[block_of_list]
        heads = np.stack([last, most, least, place - np.repeat(begins, blocks), widths[0] * 16 + widths[1]], axis=1).astype("<i4")
        words = pa.array(_strings(sizes[picked], flat, starts[picked]), pa.string())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(df), number)), words, pa.array(df), pa.array(np.add.reduceat(tf, first)),
            _binaries(heads.reshape(-1).view(np.uint8), blocks * HEAD * 4), _binaries(out, np.diff(np.append(begins, len(out))))], INDEX_NAMES)


def _offsets(sizes: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, _offsets(sizes), pa.py_buffer(np.ascontiguousarray(flat))])


def _strings(sizes: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, _offsets(sizes), pa.py_buffer(_spans(flat, starts, starts + sizes))])


def build_index(docs: DataFrame, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Rows of INDEX: for each segment its terms' posting lists, and its documents under the empty term."""

    def run(batches):
        number, segment = (TaskContext.get().partitionId() << 32), Segment(segment_docs)
        for part in (b.slice(i, segment_docs) for b in batches for i in range(0, b.num_rows, segment_docs)):
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for texts in bytekit.chunks(part.column(1)):
                if segment.add(ids[texts.rows], texts):
                    yield from segment.rows(number)
                    number, segment = number + 1, Segment(segment_docs)
        yield from segment.rows(number)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms, one row each."""

    def run(batches):
        for batch in batches:
            for texts in bytekit.chunks(batch.column(1)):
                h, own, _, distinct, data, begin, end, _ = _grouped_terms(texts)
                words = _strings(end - begin, _spans(data, begin, end), np.cumsum(end - begin) - (end - begin))
                rows = pa.array(texts.rows[own])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), words.take(pa.array(np.searchsorted(distinct, h)))], ["item_id", "term"])

    rows = items.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    schema = rows.select("item_id", F.col("text").alias("term")).schema
    return rows.mapInArrow(run, schema).distinct()


@dataclass
class Statistics:
    """N and L of a corpus."""

    documents: int
    terms: int

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        return 10 + (90 * lengths * self.documents) // self.terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's share of the score before its term's weight; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class List:
    """A posting list of a segment; blocks are decompressed when they are asked for, and kept."""

    def __init__(self, heads: bytes, postings: bytes, weight: int, statistics: Statistics):
        table = np.frombuffer(heads, "<i4").reshape(-1, HEAD).astype(np.int64)
        self.last, self.place, self.widths = table[:, 0], np.append(table[:, 3], len(postings)), table[:, 4]
        self.tops = weight * impact(table[:, 1], statistics.damping(table[:, 2]))
        self.bound, self.weight, self.postings = int(self.tops.max()), weight, postings
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.open:
            wide, high = divmod(int(self.widths[b]), 16)
            raw = self.postings[self.place[b]:self.place[b + 1]]
            n = len(raw) // (wide + high)
            gaps = np.frombuffer(raw, f"<u{wide}", n).astype(np.int64)
            before = int(self.last[b - 1]) if b else -1
            self.open[b] = (before + np.cumsum(gaps), np.frombuffer(raw, f"<u{high}", n, wide * n).astype(np.int64))
        return self.open[b]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents low .. high - 1 and their tf."""
        a, b = int(np.searchsorted(self.last, low)), int(np.searchsorted(self.last, high - 1))
        parts = [self.block(i) for i in range(a, min(b + 1, len(self.last)))]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, tf = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        x, y = np.searchsorted(docs, (low, high))
        return docs[x:y], tf[x:y]


class Heap:
    """The k best (score, smaller doc_id first) of an item."""

    def __init__(self, k: int):
        self.k, self.kept = k, []

    def least(self) -> int:
        """A score under this one cannot enter."""
        return self.kept[0][0] if len(self.kept) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            best = np.lexsort((ids, -scores))[:self.k]
            scores, ids = scores[best], ids[best]
        for score, doc in zip(scores.tolist(), ids.tolist()):
            entry = (score, -doc)
            if len(self.kept) < self.k:
                heapq.heappush(self.kept, entry)
            elif entry > self.kept[0]:
                heapq.heapreplace(self.kept, entry)


def search_segment(lists: list[List], ids: np.ndarray, m: np.ndarray, heap: Heap) -> None:
    """Offer an item's best documents of a segment to its heap."""
    lists = sorted(lists, key=lambda x: x.bound)
    sums = np.cumsum([x.bound for x in lists])  # of the lists up to each one
    for low in range(0, len(ids), WINDOW):
        high = min(low + WINDOW, len(ids))
        least = heap.least()
        essential = int(np.searchsorted(sums, least))  # those before it stay under the k-th score together
        if essential == len(lists):
            return
        scores, hit = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for x in lists[essential:]:
            docs, tf = x.between(low, high)
            scores[docs - low] += x.weight * impact(tf, m[docs])
            hit[docs - low] = True
        docs = np.flatnonzero(hit) + low
        scores = scores[docs - low]
        for i in range(essential - 1, -1, -1):
            x, rest = lists[i], int(sums[i - 1]) if i else 0
            open_ = scores + int(sums[i]) >= least
            docs, scores = docs[open_], scores[open_]
            if not len(docs):
                break
            b = np.searchsorted(x.last, docs)
            inside = b < len(x.last)
            top = np.where(inside, x.tops[np.minimum(b, len(x.last) - 1)], 0)
            stay = scores + top + rest >= least
            docs, scores, b = docs[stay], scores[stay], b[stay]
            edges = np.flatnonzero(np.diff(b, prepend=-1))
            for s, e in zip(edges, np.append(edges[1:], len(b))):
                if b[s] >= len(x.last):
                    continue
                own, tf = x.block(int(b[s]))
                at = np.searchsorted(own, docs[s:e])  # never past the end: docs are at most the block's last
                same = np.flatnonzero(own[at] == docs[s:e])
                scores[s + same] += x.weight * impact(tf[at[same]], m[docs[s + same]])
        keep = scores >= least
        heap.offer(scores[keep], ids[docs[keep]])


def _best(lists: DataFrame, queries: list, item: StructField, statistics: Statistics, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best documents of each item in each task that holds segments."""
    wanting: dict[str, list[int]] = {}
    for i, (_, terms) in enumerate(queries):
        for term in terms:
            wanting.setdefault(term, []).append(i)
    sent = lists.sparkSession.sparkContext.broadcast(([q[0] for q in queries], wanting))
    schema = StructType([item, StructField("doc_id", LongType()), StructField("score", LongType())])
    kinds = to_arrow_schema(schema)

    def run(batches):
        names, wanting = sent.value
        heaps = [Heap(k) for _ in names]
        for group in grouped(batches, 1):
            asked: dict[int, list[List]] = {}
            ids = m = None
            for term, weight, heads, postings in zip(*(group.column(i).to_pylist() for i in range(1, 5))):
                if term == "":
                    ids, m = np.frombuffer(heads, np.int64), statistics.damping(np.frombuffer(postings, np.int64))
                else:
                    own = List(heads, postings, weight, statistics)
                    for i in wanting[term]:
                        asked.setdefault(i, []).append(own)
            for i, own in asked.items():
                search_segment(own, ids, m, heaps[i])
        found = [(names[i], -doc, score) for i, heap in enumerate(heaps) for score, doc in heap.kept]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(j).type) for j, c in enumerate(zip(*found))], schema.fieldNames())

    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lists.select("segment", "term", "weight", "heads", "postings").repartition(parts, "segment").sortWithinPartitions("segment")
    return rows.mapInArrow(run, schema)


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of a written index."""
    terms = cut(item_terms(items))
    item = terms.schema["item_id"]
    corpus = index.where("term = ''").agg(F.sum("df"), F.sum("cf")).first()
    empty = terms.select("item_id", F.lit(0).cast("int").alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    size = terms.agg(F.sum(F.length("term") + 8)).first()[0]
    if not corpus[0] or not size:
        return empty
    statistics = Statistics(*corpus)
    wanted = cut(terms.select("term").distinct())  # of known size: where it is small the index is not shuffled
    counts = index.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    rarity = F.lit(2 * statistics.documents + 2).cast("double") / (2 * F.col("df") + 1)
    weights = cut(counts.select("term", F.floor(1000 * F.log(rarity)).cast("long").alias("weight")))
    blocks = -(-size // ITEMS_BYTES)
    out = empty.drop("rank")
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).join(weights.where("weight > 0"), "term")
        queries = [tuple(r) for r in own.groupBy("item_id").agg(F.collect_list("term")).collect()]
        if queries:
            asked = cut(own.select("term", "weight").distinct().unionByName(index.sparkSession.createDataFrame([("", 0)], "term string, weight long")))
            out = out.unionByName(_best(index.join(asked, "term"), queries, item, statistics, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    return search(cut(build_index(docs)), items, k)
