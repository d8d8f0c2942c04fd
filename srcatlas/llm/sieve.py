"""Bitmaps of fixed size that let through a superset of the wanted rows before an exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap of hashes: 1 MB in every task, however many rows are wanted.
BITMAP_BITS = 23


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the 64-bit column ``hash``; at most 2**BITMAP_BITS / 64 rows come to the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    rows = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for word, bits in rows.collect():
        out[word] = bits
    return out.view(np.uint64)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - BITMAP_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def sift(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be in the same column of ``wanted``: all that are, few others."""
    bits = bitmap(wanted.select(F.xxhash64(column).alias("hash")))
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    names = rows.columns

    def run(batches):
        for batch in batches:
            hashes = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.select(names).filter(pa.array(marked(sent.value, hashes)))

    return rows.select(*names, F.xxhash64(column).alias("__hash")).mapInArrow(run, rows.schema)


def maybe(rows: DataFrame, column: str, wanted: DataFrame, flag: str = "maybe") -> DataFrame:
    """Adds ``flag``: whether ``column`` may be in the same column of ``wanted``; false is certain.

    The same bitmap in built-in SQL: its words, at most 2**BITMAP_BITS / 64 rows, are broadcast.
    """
    place = F.shiftrightunsigned(F.xxhash64(column), 64 - BITMAP_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({column}), {64 - BITMAP_BITS}) & 63 as int))")
    words = wanted.select(F.shiftright(place, 6).alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    marked_rows = rows.withColumns({"__word": F.shiftright(place, 6), "__bit": bit}).join(F.broadcast(words), "__word", "left")
    found = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return marked_rows.withColumn(flag, found).drop("__word", "__bit", "__bits")


class Packer:
    """Collects (key, id) entries of a task and hands them out in packed rows, one per bucket.

    Of a key that several ids of the same flush have, only the smallest id goes on; the others
    come back as pairs with it. So a frequent key is one entry of each flush.
    """

    def __init__(self, buckets: int, most: int = 400_000):
        self.buckets, self.most = buckets, most
        self.keys: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> bool:
        self.keys.append(keys)
        self.ids.append(ids)
        self.size += len(keys)
        return self.size >= self.most

    def flush(self) -> Iterator[tuple[int, bytes, bytes]]:
        if not self.size:
            return
        keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
        self.keys, self.ids, self.size = [], [], 0
        keys, ids, pairs = stars(keys, ids)
        if len(pairs):
            yield int(pairs[0, 0] % self.buckets), b"", pairs.tobytes()
        bucket = (keys >> np.uint64(32)).astype(np.int64) % self.buckets
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        keys, ids = keys[order], ids[order]
        for a, b in zip(edges, np.append(edges[1:], len(keys))):
            yield int(bucket[order[a]]), keys[a:b].tobytes(), ids[a:b].tobytes()


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest ids, and distinct pairs (smallest id, other id) of a key."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    centre = ids[first][np.cumsum(new) - 1]
    other = ids != centre
    pairs = np.stack([centre[other], ids[other]], axis=1)
    if len(pairs):
        pairs = _distinct(pairs)
    return keys[first], ids[first], pairs


def _distinct(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    keep = np.ones(len(pairs), bool)
    keep[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[keep]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by their first ``keys`` columns, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for i in range(keys):
            values = batch.column(i).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        if held and any(held[-1].column(i)[held[-1].num_rows - 1] != batch.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def packed_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, ids and ready pairs of each bucket, from rows (bucket, keys, ids) sorted by bucket."""
    for group in grouped(batches, 1):
        keys, ids, pairs = [], [], []
        for k, v in zip(group.column(1).to_pylist(), group.column(2).to_pylist()):
            if k:
                keys.append(np.frombuffer(k, np.uint64))
                ids.append(np.frombuffer(v, np.int64))
            else:
                pairs.append(np.frombuffer(v, np.int64).reshape(-1, 2))
        empty = np.zeros(0, np.int64)
        yield (np.concatenate(keys) if keys else empty.view(np.uint64), np.concatenate(ids) if ids else empty, np.concatenate(pairs) if pairs else empty.reshape(0, 2))


def bucket_count(df: DataFrame) -> int:
    """Two buckets for each shuffle partition: few packed rows, and bounded parts of a task."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(packed: DataFrame) -> DataFrame:
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket")

