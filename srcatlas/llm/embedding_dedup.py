"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

A sample of the vectors, without those near another one of it, gives principal directions; rotations
of them are learned so that the signs of the rotated coordinates lose little (iterative
quantisation), and the medians of the sample balance the bits. (With near ones in the sample the
medians would run through a large group of copies and part it.) A code's bits are cut into tables of ``bits`` each; vectors whose codes agree in
a whole table meet there and are compared by cosine in double precision.

How many bits a table has grows with the number of vectors, so that buckets stay small, and the
number of tables follows from it: a pair just at the threshold is to meet with probability ``RECALL``
at least. A first number takes bits to differ with probability angle / pi; as a common direction of the
vectors widens the angles of codes, it is then measured on made pairs at the threshold, and tables are
added until enough of them meet (beyond ``TABLES``, bits are taken away instead). Every vector is indexed.

A pair may meet in several tables; it is counted in the first one, which both codes tell. So no
table of pairs is made: each bucket gives counts per vector and a spanning forest of its links.
Buckets of more than ``PIECE`` vectors are compared in pieces, each with each, in tasks of their own.

Contracts. A vector that is null, zero, of another length than most, or holds null or non-finite
components links with nothing. Equal vectors link like any others. Rows of one vec_id have a
result each and do not link with each other; each different one of them adds its links. A null vec_id links with nothing,
component_id null, kept true. Other columns are ignored. Empty in, empty out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm import sieve
from srcatlas.llm.components import components
from srcatlas.session import cut

#: Vectors the quantiser is fitted on, about; the least recall planned for; vectors compared at once.
SAMPLE, RECALL, PIECE = 10_000, 0.97, 512
#: Where more tables than this would be needed, they get fewer bits instead.
TABLES = 96


@dataclass
class Quantiser:
    mean: np.ndarray
    directions: np.ndarray  # one column per bit, for unit vectors
    medians: np.ndarray
    bits: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """One number of ``bits`` bits per table."""
        signs = ((unit - self.mean) @ self.directions > self.medians).reshape(len(unit), -1, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    bits = min(32, max(8, math.ceil(math.log2(max(2, n))) - 4))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def apart(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of the sample of which no two are near each other, first come first kept."""
    kept = np.zeros((0, sample.shape[1]))
    for at in range(0, len(sample), 512):
        block = sample[at:at + 512]
        block = block[(block @ kept.T).max(axis=1, initial=-1) < threshold]
        near = block @ block.T >= threshold
        out = np.zeros(len(block), bool)
        for i in range(len(block)):
            out[i] = not (near[i, :i] & out[:i]).any()
        kept = np.concatenate([kept, block[out]])
    return kept


def fit(sample: np.ndarray, bits: int, tables: int, rounds: int = 25, seed: int = 3) -> Quantiser:
    """Learn rotations of the principal directions until there are bits for all tables."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(sample)))
    projected = centred @ axes
    parts = []
    for _ in range(-(-bits * tables // width)):
        turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ v).T
        order = rng.permutation(width)
        parts.append(axes @ turn[:, order])
    directions = np.concatenate(parts, axis=1)[:, :bits * tables]
    return Quantiser(mean, directions, np.median(centred @ directions, axis=0), bits)


def pairs_at(sample: np.ndarray, threshold: float, pairs: int = 2000, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of the sample with partners just at the threshold: in any direction, and towards other vectors of the sample."""
    rng = np.random.default_rng(seed)
    a = sample[rng.integers(len(sample), size=pairs)]
    out = []
    for way in (rng.normal(size=a.shape), sample[rng.integers(len(sample), size=pairs)]):
        way = way - (way * a).sum(axis=1, keepdims=True) * a
        length = np.linalg.norm(way, axis=1, keepdims=True)
        some = length[:, 0] > 1e-6
        if some.any():
            out.append((a[some], threshold * a[some] + math.sqrt(1 - threshold * threshold) * (way / np.maximum(length, 1e-6))[some]))
    return out


def fit_for(sample: np.ndarray, bits: int, tables: int, threshold: float, recall: float) -> Quantiser:
    """A quantiser under which pairs at the threshold are measured to meet; more tables, or fewer bits, until they do."""
    tests = pairs_at(sample, threshold)
    while True:
        q = fit(sample, bits, tables)
        met = min(((q.codes(a) == q.codes(b)).any(axis=1).mean() for a, b in tests), default=1.0)
        if met >= recall:
            return q
        more = math.ceil(tables * max(1.1, math.log(1 - recall) / math.log(1 - max(met, 0.01))))
        if more > TABLES and bits > 1:
            bits -= 1
        else:
            tables = more


def unit_vectors(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and those rows scaled to length 1."""
    lists = [x if x is not None and len(x) and None not in x and (width is None or len(x) == width) else None for x in column.to_pylist()]
    good = np.array([x is not None for x in lists], bool)
    rows = np.array([x for x in lists if x is not None], np.float64).reshape(int(good.sum()), -1)
    with np.errstate(all="ignore"):
        largest = np.abs(rows).max(axis=1, initial=0, keepdims=True)
        rows = rows / largest
        norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        rows = rows / norm
    fine = np.isfinite(rows).all(axis=1) & (norm[:, 0] > 0) if len(rows) else np.zeros(0, bool)
    good[np.flatnonzero(good)[~fine]] = False
    return good, rows[fine]


def normalised(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id and the unit vector's bytes of every usable row."""

    def run(batches):
        for batch in batches:
            good, rows = unit_vectors(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "unit"])

    return vectors.where("vec_id is not null and embedding is not null").mapInArrow(run, "vec_id long, unit binary")


def tables_of(units: DataFrame, q: Quantiser) -> DataFrame:
    """(table, bucket, vec_id, codes, unit) of every vector in every table."""
    sent = units.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1)
                codes = sent.value.codes(rows)
                n, tables = codes.shape
                which = np.repeat(np.arange(n), tables)
                packed = pa.array([c.astype("<i4" if sent.value.bits < 32 else "<i8").tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(codes.ravel()),
                    part.column(0).take(pa.array(which)), packed.take(pa.array(which)), part.column(1).take(pa.array(which))], ["tab", "bucket", "vec_id", "codes", "unit"])

    return units.mapInArrow(run, "tab int, bucket long, vec_id long, codes binary, unit binary")


def neighbours(tables: DataFrame, threshold: float, bits: int) -> DataFrame:
    """Per bucket: (a, b, n) where n counts new links of a, and a link (a, b) of a spanning forest (b null: none)."""
    sizes = tables.groupBy("tab", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("pieces", F.ceil(F.col("n") / PIECE)).drop("n")
    met = tables.join(sizes, ["tab", "bucket"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    spread = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    spread = spread.select("tab", "bucket", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "vec_id", "codes", "unit")
    spread = spread.repartition("tab", "bucket", "i", "j").sortWithinPartitions("tab", "bucket", "i", "j", "vec_id")
    kind = np.int32 if bits < 32 else np.int64

    def run(batches):
        out: list[tuple] = []
        for group in sieve.grouped(batches, 4):
            tab, i, j = group.column(0)[0].as_py(), group.column(2)[0].as_py(), group.column(3)[0].as_py()
            piece, ids = group.column(4).to_numpy(), group.column(5).to_numpy()
            codes = np.frombuffer(b"".join(group.column(6).to_pylist()), kind).reshape(len(ids), -1)
            rows = np.frombuffer(b"".join(group.column(7).to_pylist()), np.float64).reshape(len(ids), -1)
            left = np.flatnonzero(piece == i)
            right = left if i == j else np.flatnonzero(piece == j)
            for a in range(0, len(left), PIECE):
                for b in range(0, len(right), PIECE):
                    l, r = left[a:a + PIECE], right[b:b + PIECE]
                    near = (rows[l] @ rows[r].T >= threshold) & (ids[l][:, None] != ids[r][None, :])
                    if i == j:
                        near &= l[:, None] < r[None, :]
                    x, y = np.nonzero(near)
                    if tab and len(x):
                        new = (codes[l[x], :tab] != codes[r[y], :tab]).all(axis=1)
                        x, y = x[new], y[new]
                    if len(x):
                        yield from links(ids[l[x]], ids[r[y]], out)
        if out:
            yield batch_of(out)

    def links(a, b, out):
        ids, n = np.unique(np.concatenate([a, b]), return_counts=True)
        parent = {x: x for x in ids.tolist()}

        def find(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        tree = {}
        for u, v in zip(a.tolist(), b.tolist()):
            x, y = find(u), find(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        for v in ids.tolist():
            tree[v] = find(v)
        out.extend((v, tree[v] if tree[v] != v else None, c) for v, c in zip(ids.tolist(), n.tolist()))
        if len(out) > 50_000:
            yield batch_of(out)
            out.clear()

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "n"])

    return spread.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    widths = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    units = cut(normalised(vectors, widths["w"]).distinct())
    n = units.count()
    bits, tables = plan(n, threshold, recall)
    share = min(1.0, sample / max(1, n))
    chosen = units.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("vec_id", "unit").collect()
    chosen.sort(key=lambda r: (r["vec_id"], bytes(r["unit"])))
    rows = np.array([np.frombuffer(r["unit"], np.float64) for r in chosen]).reshape(len(chosen), widths["w"])
    q = fit_for(apart(rows, threshold), bits, tables, threshold, recall) if len(rows) else None
    found = cut(neighbours(tables_of(units, q), threshold, q.bits)) if q else None
    own = vectors.select("vec_id")
    if found is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "vec_id")
    return own.join(counts, "vec_id", "left").join(joined, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"))
