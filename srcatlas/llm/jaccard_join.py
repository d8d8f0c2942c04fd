"""N-gram Jaccard join: documents by their word shingles, with a count-vector R-tree.

Shingles are hashed into groups. The counts per group make a document a point; the summed minima
of two points bound the overlap of their sets from above, and so do the summed minima of a point
and the upper corner of a box. An R-tree over the points of a block finds the pairs whose bound
reaches the threshold; those are verified on the sets themselves.

A tree over all documents cannot be cut into independent parts, so the groups also deal documents
out to blocks, without losing a pair: sets that link differ in at most T shingles, and among more
than T groups at least one holds the same shingles in both. The hash of a group's content is a block
key. T, and so the number of groups, follows from the sizes: documents of a size class meet those of
the next class under the class's own number of groups. As empty groups say nothing there are more
groups than T + 1 by ``spare``; a document with more empty groups than that is dealt out again by
another hash, and after ``DEALS`` of these by its empty groups, too, so no pair is lost.

Rows with equal sets become one first: all that follows works on one document of each distinct set. Then
a few rounds use one key a document, the smallest block key under some salt, which near copies share with
high probability; the documents of a key are tested against its smallest one and united. Only then
are all block keys dealt out, and only blocks that hold several components stay open. In these a few rounds test a random document against those of other components,
and what then is still open is searched by R-tree for pairs across components, in pieces of ``PIECE``
documents: those outside of the block's largest component against all. So groups of copies cost one pair per copy and round, and no block is
gathered in one task. Keys with the same documents count as one. Before a pair's texts meet, its parities must: shingles fall into
``PARITY`` cells, and each cell that holds an odd number of one set and an even one of the other holds a shingle of one
alone. More such cells than a link allows rule the pair out, so few texts travel in vain. Of a set too large for its cells
a share of the shingles is taken, by hash, a half, a quarter and so on; then as many cells more rule the pair out as
the share of what a link allows has with a probability below e**-``SAFE``. The tree's pairs are sifted where they are found.

Contracts. Words are runs of bytes other than blank and 0x09-0x0D, A-Z in lower case. A text of
fewer than ``k`` words is one shingle; null and wordless texts have none and link with nothing. Rows
of one doc_id count as one document; a null doc_id links with nothing. Other columns are ignored
(``distinct`` keeps them). Empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm import bytekit, sieve
from srcatlas.llm.components import components
from srcatlas.llm.frames import plainly
from srcatlas.session import cut

U64 = np.uint64
LETTERS = bytekit.byte_set([(0x20, 0x20), (0x09, 0x0D)])
DEALS = 4
#: Groups of the count vectors, and documents of a block that are compared at once.
GROUPS, PIECE = 64, 256
#: Cells of the parities, a power of two from 64 on, and the bits of the largest size that has all shingles in them.
PARITY, ALL_BITS = 1024, 10
#: A sampled parity loses a link with a probability below e**-SAFE.
SAFE = 40
#: Block keys that a bucket holds, about; the number of buckets follows from it.
BUCKET_KEYS = 500_000
#: Where counts of a vector end.
CLIP = 65535
#: Rounds with one key a document before all block keys are dealt out; they only save work.
LEADS = 3
#: Rounds with a random document of each open block before its tree is built; they only save work.
ROUNDS = 3
#: Members that one copy of a centre's text is verified against.
FAN = 64


def sets(column: pa.Array, k: int):
    """Chunks of (rows, flat distinct shingles, sizes)."""
    for texts in bytekit.chunks(column):
        texts.data = bytekit.LOWER[texts.data]
        w = bytekit.words(texts, LETTERS)
        hashes = bytekit.span_hashes(texts.data, w.begin, w.end)
        grams = bytekit.shingles(hashes, k)
        out = []
        for i in range(len(texts.rows)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            out.append(np.unique(grams[a:b - k + 1]) if b - a >= k else bytekit.shingles(hashes[a:b], b - a) if b > a else grams[:0])
        yield texts.rows, np.concatenate(out) if out else grams[:0], np.array([len(x) for x in out], np.int64)


def need(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


class Classes:
    """Size classes and, for each, the number of groups under which it meets itself and the next."""

    def __init__(self, percent: int, largest: int):
        bounds = [1]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // percent + 1))
        self.bounds = np.array(bounds, np.int64)
        top = self.bounds[1:] - 1
        differ = (100 - percent) * (top + top * 100 // percent) // (100 + percent)
        self.spare = np.where(differ == 0, 0, 1 + differ // 40)
        self.groups = differ + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, sizes, side="right") - 1


_CLASSES: dict[tuple[int, int], Classes] = {}


def classes(percent: int, largest: int) -> Classes:
    key = (percent, 1 << max(10, int(largest).bit_length()))
    if key not in _CLASSES:
        _CLASSES[key] = Classes(*key)
    return _CLASSES[key]


def block_keys(flat: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Block keys of some sets and, for each, the number of its set."""
    c = classes(percent, int(sizes.max(initial=1)))
    content = bytekit.mix(flat * U64(0x9E3779B97F4A7C15))
    keys, owners = [], []
    for lower in (0, 1):
        scheme = c.of(sizes) - lower
        left = (sizes > 0) & (scheme >= 0)
        for deal in range(DEALS):
            who = np.flatnonzero(left)
            if not len(who):
                break
            use = np.repeat(left, sizes)
            m, spare = c.groups[scheme[who]], c.spare[scheme[who]]
            own = np.repeat(np.arange(len(who)), sizes[who])
            at = np.cumsum(m) - m
            group = ((bytekit.mix(flat[use] + U64(deal + 1)) >> U64(32)) * m.astype(U64)[own]) >> U64(32)
            cell = at[own] + group.astype(np.int64)
            sums = np.zeros(int(m.sum()), U64)
            np.add.at(sums, cell, content[use])
            counts = np.bincount(cell, minlength=len(sums))
            owner = np.repeat(np.arange(len(who)), m)
            label = (scheme[who].astype(U64)[owner] << U64(34)) + (U64(deal) << U64(32)) + bytekit.ranges(m).astype(U64)
            key = bytekit.mix(sums + bytekit.mix(label) + counts.astype(U64))
            empty = np.bincount(owner[counts == 0], minlength=len(who)) > spare
            take = (counts > 0) | (empty[owner] if deal == DEALS - 1 else False)
            keys.append(key[take])
            owners.append(who[owner[take]])
            left = np.zeros(len(sizes), bool)
            left[who[empty]] = True
    none = np.zeros(0, np.int64)
    return np.concatenate(keys) if keys else none.view(U64), np.concatenate(owners) if owners else none


def count_vectors(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = np.repeat(np.arange(len(sizes)), sizes)
    group = (bytekit.mix(flat + U64(99)) >> U64(40)).astype(np.int64) % GROUPS
    return np.bincount(own * GROUPS + group, minlength=len(sizes) * GROUPS).reshape(len(sizes), GROUPS).clip(max=CLIP).astype(np.uint16)


def levels(sizes: np.ndarray) -> np.ndarray:
    """How often the shingles of sets are halved before they fill the cells."""
    return np.maximum(np.frexp(sizes)[1] - ALL_BITS, 0)


def parities(flat: np.ndarray, sizes: np.ndarray, more: int = 0) -> np.ndarray:
    """For each set, as bits of its row: whether the number of its shingles in each of ``PARITY`` cells is odd.

    Of the shingles of its level, halved ``more`` often.
    """
    own = np.repeat(np.arange(len(sizes)), sizes)
    hashes = bytekit.mix(flat + U64(77))
    use = hashes >> U64(1) >> (U64(63) - (levels(sizes) + more).astype(U64)[own]) == 0
    own, cell = own[use], hashes[use] & U64(PARITY - 1)
    out = np.zeros(len(sizes) * (PARITY // 64), U64)
    np.bitwise_xor.at(out, own * (PARITY // 64) + (cell >> U64(6)).astype(np.int64), U64(1) << (cell & U64(63)))
    return out.reshape(len(sizes), PARITY // 64)


def packed_parities(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The parities of each set for its own level and for the next."""
    both = np.concatenate([parities(flat, sizes, more) for more in (0, 1)], axis=1)
    return pa.array([p.tobytes() for p in both], pa.binary())


def allowed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of sets (rows: size, parities): whether these allow a link."""
    (na, pa), (nb, pb) = a, b
    la, lb = levels(na), levels(nb)
    level = np.maximum(la, lb)
    at = np.arange(len(na))
    part = lambda p, own: p.reshape(len(p), 2, PARITY // 64)[at, np.minimum(level - own, 1)]
    odd = np.bitwise_count(part(pa, la) ^ part(pb, lb)).sum(axis=1, dtype=np.int64)
    most = (na + nb) * (100 - percent) // (100 + percent)
    mean = most / 2.0 ** level
    bound = np.where(level == 0, most, mean + SAFE / 3 + np.sqrt(SAFE * SAFE / 9 + 2 * SAFE * mean))
    return (np.abs(na - nb) <= most) & ((odd <= bound) | (np.abs(la - lb) > 1))


class RTree:
    """A packed R-tree over count vectors: boxes of ``WIDTH`` children, bounds by summed minima."""

    WIDTH = 8

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.astype(float)
        axis = spread.std(axis=0).argmax() if len(points) else 0
        self.order = np.lexsort((points[:, axis], sizes))
        high, low = points[self.order], sizes[self.order]
        self.levels = [(high, low)]
        while len(high) > self.WIDTH:
            edges = np.arange(0, len(high), self.WIDTH)
            high, low = np.maximum.reduceat(high, edges), np.minimum.reduceat(low, edges)
            self.levels.append((high, low))

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose summed minima reach what a link needs."""
        top = len(self.levels[-1][0])
        asked, node = np.repeat(np.arange(len(points)), top), np.tile(np.arange(top), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            fit = np.zeros(len(asked), bool)
            for a in range(0, len(asked), 1 << 14):
                q, n = asked[a:a + (1 << 14)], node[a:a + (1 << 14)]
                least = np.maximum(low[n], -(-percent * sizes[q] // 100))
                shared = np.minimum(points[q], high[n])
                # a clipped count bounds nothing
                fit[a:a + (1 << 14)] = (shared.sum(axis=1, dtype=np.int64) >= need(sizes[q], least, percent)) | (shared == CLIP).any(axis=1)
                if depth == 0:
                    fit[a:a + (1 << 14)] &= low[n] * 100 <= sizes[q] * 100 * 100 // percent
            asked, node = asked[fit], node[fit]
            if depth:
                below = len(self.levels[depth - 1][0])
                asked, node = np.repeat(asked, self.WIDTH), (node[:, None] * self.WIDTH + np.arange(self.WIDTH)).ravel()
                asked, node = asked[node < below], node[node < below]
        return asked, self.order[node]


def profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """n_shingles, a 128-bit digest of the set (d1, d2), its smallest block keys (keys), their number (n_keys) and its parities of each row (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for rows, flat, sizes in sets(batch.column(1), k):
                ends = np.cumsum(sizes)
                digest = []
                for salt in (U64(5), U64(6)):
                    sums = np.zeros(len(flat) + 1, U64)
                    np.cumsum(bytekit.mix(flat + salt), out=sums[1:])
                    digest.append(pa.array((sums[ends] - sums[ends - sizes]).view(np.int64)))
                blocks, owners = block_keys(flat, sizes, percent)
                least = np.full((len(sizes), LEADS), np.iinfo(np.uint64).max, U64)
                for lead in range(LEADS):
                    np.minimum.at(least[:, lead], owners, bytekit.mix(blocks + U64(1000 + lead)))
                keys = bytekit.list_array(least.view(np.int64).ravel(), np.full(len(sizes), LEADS), pa.int64())
                n_keys = pa.array(np.bincount(owners, minlength=len(sizes)).astype(np.int64))
                odd = packed_parities(flat, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes), *digest, keys, n_keys, odd], ["doc_id", "n_shingles", "d1", "d2", "keys", "n_keys", "parity"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, n_keys long, parity binary")


def _some(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc_id may be wanted: all that are, few others; the others' texts do not leave the JVM."""
    return sieve.maybe(docs, "doc_id", wanted.select("doc_id")).where("maybe").drop("maybe")


def _parities(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, 2 * PARITY // 64)


def possible(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that sizes and parities of their sets (own: profiles) do not rule out."""
    sets = own.where("doc_id is not null and n_shingles > 0")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            a, b = ((batch.column(f"n{x}").to_numpy(), _parities(batch.column(f"p{x}"))) for x in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(allowed(a, b, percent)))

    return met.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Adds ``linked`` to pairs (a, b), by the sets themselves.

    Each pair's second text goes to where copies of the first are, one for ``FAN`` others.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / FAN)).alias("part"))
    wanted = dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("side")).unionByName(
        dealt.select("a", "part").distinct().select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("side")))
    texts = _some(docs, wanted).join(wanted, "doc_id")
    rows = texts.select("a", "part", "side", "doc_id", "text").repartition("a", "part").sortWithinPartitions("a", "part", "side", "doc_id")

    def run(batches):
        here, centre = None, []
        for batch in batches:
            a, part, side, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = []
            for at, flat, n in sets(batch.column(4), k):
                ends = np.cumsum(n)
                for i, end, size in zip(at.tolist(), ends.tolist(), n.tolist()):
                    own = flat[end - size:end]
                    if (a[i], part[i]) != here:
                        here, centre = (a[i], part[i]), []
                    if side[i] == 0:
                        centre.append(own.copy())
                        continue
                    linked = False
                    for c in centre:
                        if size and len(c) and min(size, len(c)) * 100 >= percent * max(size, len(c)):
                            both = len(np.intersect1d(c, own, assume_unique=True))
                            linked |= both * 100 >= percent * (size + len(c) - both)
                    out.append((a[i], doc[i], bool(linked)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def block_members(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """(key, doc_id) of the blocks that hold several documents; docs has doc_id and text."""

    def out_of(packs):
        for i in range(0, len(packs), 64):
            columns = list(zip(*packs[i:i + 64]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], ["bucket", "keys", "ids"])

    def deal(batches):
        held, n = [], 0

        def flush():
            keys, ids = (np.concatenate(x) for x in zip(*held))
            bucket = (keys >> U64(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            # keys that agree in 32 bits within a bucket count as equal: more to test, nothing lost; ids go byte by byte, which packs well
            short = (keys & U64(0xFFFFFFFF)).astype(np.uint32)[order]
            planes = ids[order].view(np.uint8).reshape(-1, 8)
            return [(int(bucket[order[a]]), short[a:b].tobytes(), planes[a:b].T.tobytes()) for a, b in zip(edges, np.append(edges[1:], len(keys)))]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, flat, sizes in sets(batch.column(1), k):
                keys, owners = block_keys(flat, sizes, percent)
                held.append((keys, ids[at][owners]))
                n += len(keys)
                if n >= 300_000:
                    yield from out_of(flush())
                    held, n = [], 0
        if held:
            yield from out_of(flush())

    def shared_only(batches):
        for group in sieve.grouped(batches, 1):
            keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column(1).to_pylist()])
            ids = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T) for x in group.column(2).to_pylist()]).view(np.int64).ravel()
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            if not len(keys):
                continue
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            last = np.append(first[1:], len(keys)) - 1
            several = np.repeat(ids[first] != ids[last], last - first + 1)
            several[1:] &= (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            if several.any():
                whole = keys[several].astype(np.int64) | (group.column(0)[0].as_py() << 32)
                yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(ids[several])], ["key", "doc_id"])

    packed = docs.select("doc_id", "text").mapInArrow(deal, "bucket int, keys binary, ids binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(shared_only, "key long, doc_id long")


def vectors(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for rows, flat, sizes in sets(batch.column(1), k):
                points = count_vectors(flat, sizes)
                packed = pa.array([p.tobytes() for p in points], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes), packed, packed_parities(flat, sizes)], ["doc_id", "n", "point", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, point binary, parity binary")


def tree_pairs(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a block and of different components whose count vectors and parities allow a link.

    Nothing is left to find within a block's largest component. So its members outside of that one are asked
    for, in pieces, against pieces of all members: a large component with a few other documents costs one
    row for each of its own.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("largest"))
    sizes = counts.select("key", F.col("largest.component").alias("largest"), F.ceil(F.col("n") / PIECE).alias("pieces"), F.ceil((F.col("n") - F.col("largest.n")) / PIECE).alias("parts"))
    rows = members.join(sizes, "key").join(points, "doc_id").withColumns({"i": F.pmod(F.xxhash64("doc_id"), F.col("pieces")), "j": F.pmod(F.xxhash64("doc_id"), F.col("parts"))})
    columns = ["doc_id", "component", "n", "point", "parity"]
    every = rows.select("key", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), F.lit(False).alias("asked"), *columns)
    asked = rows.where("component <> largest").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("i"), "j", F.lit(True).alias("asked"), *columns)
    spread = every.unionByName(asked).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")

    def run(batches):
        for group in sieve.grouped(batches, 3):
            left = group.column(3).to_numpy()
            ids, labels, sizes = (group.column(i).to_numpy() for i in (4, 5, 6))
            points, odd = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint16).reshape(-1, GROUPS), _parities(group.column(8))
            l, r = np.flatnonzero(left), np.flatnonzero(~left)
            if not len(l) or not len(r):
                continue
            asked, found = RTree(points[r], sizes[r]).search(points[l], sizes[l], percent)
            a, b = l[asked], r[found]
            keep = (labels[a] != labels[b]) & (ids[a] != ids[b])
            a, b = a[keep], b[keep]
            keep = allowed((sizes[a], odd[a]), (sizes[b], odd[b]), percent)
            if keep.any():
                x, y = ids[a[keep]], ids[b[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long").distinct()


def _label(labels: DataFrame, side: str) -> DataFrame:
    return labels.select(F.col(labels.columns[0]).alias(side), F.col("component").alias(f"c{side}"))


def _united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (doc_id, component) after more links: components are united, not documents."""
    between = links.select("a", "b").join(_label(labels, "a"), "a").join(_label(labels, "b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(between).select(F.col("id").alias("component"), F.col("component").alias("top"))
    return labels.join(joined, "component", "left").select("doc_id", F.coalesce("top", "component").alias("component"))


def _representatives(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written profiles: (doc_id, keys) of one document for each distinct set, and (doc_id, rep) of every row with a set."""
    some = own.where("doc_id is not null and n_shingles > 0")
    reps = cut(some.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys")))
    return reps.select(F.col("rep").alias("doc_id"), "keys"), some.join(reps.drop("keys"), ["n_shingles", "d1", "d2"]).select("doc_id", "rep")


def _sketches(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of profiles what ``possible`` looks at, written, for the wanted documents and few others."""
    return cut(_some(own.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "parity"), wanted))


def _tested(pairs: DataFrame, labels: DataFrame, tested: DataFrame | None, own: DataFrame, known: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All pairs tested on their texts so far, and the labels united by the links among new ones."""
    fresh = pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    now = cut(verified(cut(possible(cut(fresh), own, percent)), known, k, percent))
    return now if tested is None else tested.unionByName(now), cut(_united(labels, now.where("linked")))


def groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (the smallest doc_id reachable by links)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = cut(profiles(texts, k, percent))
    reps, rows = _representatives(own)
    rows = cut(rows)
    known = texts.where("doc_id is not null")
    # rows of one doc_id are one document, whatever their sets
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    links = rows.join(several.select("doc_id", "low"), "doc_id").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    labels = cut(_united(reps.select("doc_id", F.col("doc_id").alias("component")).distinct(), links))
    tested = None
    for lead in range(LEADS):
        members = reps.select("doc_id", F.col("keys")[lead].alias("key")).join(labels, "doc_id")
        centre = members.groupBy("key").agg(F.min(F.struct("doc_id", "component")).alias("c"), F.max("component").alias("high")).where("c.component < high").drop("high")
        star = members.join(centre, "key").where("component <> c.component").select(F.col("c.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        star = cut(star)
        tested, labels = _tested(star, labels, tested, _sketches(own, star.select(F.explode(F.array("a", "b")).alias("doc_id"))), known, k, percent)
    wanted = reps.select("doc_id").distinct()
    n_keys = rows.select("rep").distinct().join(own.select(F.col("doc_id").alias("rep"), "n_keys"), "rep").agg(F.sum("n_keys")).first()[0] or 0
    buckets = max(sieve.bucket_count(docs), -(-n_keys // BUCKET_KEYS))
    shared = cut(block_members(_some(known, wanted), k, percent, buckets)).join(labels, "doc_id")
    # keys with the same documents are one: their number and two sums of hashes tell
    same = [F.bit_xor(F.xxhash64(F.lit(salt), "doc_id")).alias(f"x{salt}") for salt in (1, 2)]
    mixed = shared.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), *same).where("low < high")
    mixed = mixed.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    members = cut(shared.join(mixed, "key", "left_semi").select("key", "doc_id", "component"))
    sketches = _sketches(own, members)
    for turn in range(ROUNDS):
        centre = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "component")).alias("c"))
        star = members.join(centre, "key").where("component <> c.component").select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()
        tested, labels = _tested(star, labels, tested, sketches, known, k, percent)
        fresh = members.drop("component").join(labels, "doc_id")
        still = fresh.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        members = cut(fresh.join(still, "key", "left_semi").select("key", "doc_id", "component"))
    wanted = members.select("doc_id").distinct()
    points = cut(vectors(_some(known, wanted), k).join(wanted, "doc_id", "left_semi"))
    _, labels = _tested(tree_pairs(members, points, percent), labels, tested, sketches, known, k, percent)
    found = rows.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(labels.withColumnRenamed("doc_id", "rep"), "rep").select("doc_id", "component")
    return own.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def distinct(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns as they are."""

    def kept(plain: DataFrame) -> DataFrame:
        gone = groups(plain, k, percent).where("component_id <> doc_id").select("doc_id").distinct()
        return plain.join(gone, "doc_id", "left_anti")

    return plainly(docs, ("doc_id", "text"), kept)
