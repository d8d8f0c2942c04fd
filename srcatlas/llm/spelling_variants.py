"""Spelling variants: words one edit apart, found by FM-index search schemes over the vocabulary.

Words are counted once over all documents. Two words at distance one agree in the first or in the last
half of the shorter one (of s characters: s // 2 and the rest). So each word goes to the groups of its
halves, for s its own length and one less; near words meet in a group. A group with more than ``MOST``
words is dealt out anew: of what is still open between the fixed ends one half must agree again. With one open
character a group is bounded by the alphabet, so this ends, no group is unbounded, and nothing is capped. A
pair that could meet in several groups counts in the first: where the first half agrees, it is not counted
in the group of the last.

A task packs groups into vocabularies of some 10,000 words and builds an FM-index over each: the words
between delimiters, their suffix ranks, and the Burrows-Wheeler transform with ranks of its symbols. Words of groups
that share a beginning are written backwards, so that the index runs in both directions and the
half that must match exactly comes first in either. All words of a vocabulary are looked up together: the exact half
step by step, then the other half, leaving the exact path once for a replaced or an inserted character.
Intervals of suffix ranks are steps of a search over sorted (symbol, rank) numbers. A word whose interval
holds nothing but itself is done.

Contracts. Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, that lose a character
where the checksum of document and run says so (``damaged``); those of ``LEAST`` characters or more that occur
twice or more are the vocabulary. A null text has no words, a null doc_id counts as an empty text.
Repeated rows count repeatedly. Other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm import bytekit
from srcatlas.session import cut

#: Characters of a word, at least.
LEAST = 7
#: A checksum that this number divides takes a character away.
DIVISOR = 31
#: A form occurs so many times as often as its variant, at least.
TIMES = 10
#: Words of a group that are looked up together, at most; larger groups are dealt out anew.
MOST = 20_000
#: Words of the small groups that share an index.
PACKED = 10_000
#: Intervals up to this width are followed row by row, wider ones symbol by symbol.
NARROW = 24
#: Distinct words that a task counts before it hands them out.
COUNTED = 200_000


def damaged(run: bytes, state: int) -> bytes | None:
    """The run without the character its checksum names, if it names one."""
    h = zlib.crc32(run, state)
    if h % DIVISOR:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode() if len(text) > LEAST else None


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: how often the words of LEAST characters or more occur in the rows of a task."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for texts in bytekit.chunks(batch.column(1)):
                data = bytekit.LOWER[texts.data]
                lead = data == 0xC3
                flags = ((data >= 97) & (data <= 122)) | lead
                flags[1:] |= lead[:-1]
                w = bytekit.runs(texts, flags)
                leads = np.zeros(len(data) + 1, np.int64)
                np.cumsum(lead, out=leads[1:])
                sizes = w.end - w.begin - leads[w.end] + leads[w.begin]
                long = np.flatnonzero(sizes >= LEAST)
                first = np.searchsorted(long, w.first)
                raw = data.tobytes()
                spans = [raw[b:e] for b, e in zip(w.begin[long].tolist(), w.end[long].tolist())]
                for i in np.flatnonzero(np.diff(first)).tolist():
                    state = zlib.crc32((ids[texts.rows[i]] + ":").encode())
                    seen.update([damaged(s, state) for s in spans[first[i]:first[i + 1]]])
                if len(seen) > COUNTED:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    return rows.mapInArrow(run, "word string, n long")


def _counted(seen: Counter) -> pa.RecordBatch:
    seen.pop(None, None)
    words = pa.array(list(seen.keys()), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words that occur at least twice."""
    return occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of a group: the shorter length s, and a first and b last characters."""
    return rows.withColumn("key", F.expr("xxhash64(s, a, b, left(word, a), right(word, b))"))


def groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, s, a, b, upto, backwards, key: the groups of each word, none with unboundedly many words.

    Words of a group agree in a first and b last characters; ``upto`` is the number of first
    characters in which a pair that counts here must not agree.
    """
    rows = words.select("word", "n", F.explode(F.expr(f"filter(array(length(word), length(word) - 1), s -> s >= {LEAST})")).alias("s"))
    open_ = cut(_keyed(_halved(rows.withColumns({"a": F.lit(0), "b": F.lit(0), "upto": F.lit(1 << 30)}))))
    done = None
    while True:
        large = cut(open_.groupBy("key").agg(F.count("*").alias("words"), F.max(F.expr("s - a - b")).alias("inner")).where(F.col("words") > most).where("inner > 1").select("key"))
        small = open_.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        open_ = cut(_keyed(_halved(open_.join(large, "key", "left_semi").drop("key", "backwards"))))


def _halved(rows: DataFrame) -> DataFrame:
    """Two rows for one: the first or the last half of what is open between the fixed ends agrees."""
    inner = "(s - a - b)"
    half = F.expr(f"""array(
        named_struct('a', a + {inner} div 2, 'b', b, 'upto', upto, 'backwards', true),
        named_struct('a', a, 'b', b + {inner} - {inner} div 2, 'upto', least(upto, a + {inner} div 2), 'backwards', false))""")
    ints = [F.col(f"half.{c}").cast("int").alias(c) for c in ("a", "b", "upto")]
    return rows.withColumn("half", F.explode(half)).select("word", "n", F.col("s").cast("int").alias("s"), *ints, "half.backwards")


class Index:
    """FM-index over words between delimiters; symbols are Latin-1 numbers, 0 is the delimiter."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray):
        k = len(sizes)
        starts = np.cumsum(sizes) - sizes
        n = len(letters) + k + 1
        text = np.zeros(n, np.int64)
        self.begin = starts + np.arange(1, k + 1)  # of each word in the text
        text[np.repeat(self.begin - starts, sizes) + np.arange(len(letters))] = letters
        self.text, self.n, self.k = text, n, k
        delimiters = np.append(self.begin - 1, n - 1)
        rank = text + k  # delimiters come first, in the order of the words
        rank[delimiters] = np.arange(k + 1)
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] + 1
            both = rank * (n + 300) + ahead
            suffixes = np.argsort(both, kind="stable")
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(np.concatenate([[False], np.diff(both[suffixes]) != 0]))
            if rank[suffixes[-1]] == n - 1 or step >= n:
                break
            step *= 2
        self.suffixes = suffixes
        self.before = text[suffixes - 1]  # the transform
        numbers = self.before * n + np.arange(n)
        order = np.argsort(numbers, kind="stable")
        self.numbers = numbers[order]
        self.back = np.empty(n, np.int64)  # where a row goes with the symbol before it
        self.back[order] = np.arange(n)
        self.symbols = np.unique(letters)
        self.word_at = np.repeat(np.arange(k), sizes + 1)  # of the places up to the last delimiter

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that have the symbol before those of [low, high)."""
        base = symbol * self.n
        return np.searchsorted(self.numbers, base + low), np.searchsorted(self.numbers, base + high)

    def whole(self, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin at suffixes of the intervals, with the interval's own number."""
        first, last = np.searchsorted(self.numbers, low), np.searchsorted(self.numbers, high)  # among the delimiters
        rows = self.numbers[np.repeat(first, last - first) + bytekit.ranges(last - first)]
        return np.repeat(which, last - first), self.word_at[self.suffixes[rows]]


def near(index: Index, asked: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked word, word): equal in the last ``exact`` letters, with one letter replaced or put in before."""
    text, begin = index.text, index.begin
    word, left = asked, sizes[asked].copy()  # letters still to match
    goal = left - exact[asked]
    low, high = np.zeros(len(word), np.int64), np.full(len(word), index.k + 1)
    branches: list[tuple[np.ndarray, ...]] = []
    while len(word):
        spread = left <= goal  # on the other half: leave the exact path here
        if spread.any():
            branches += _leave(index, word[spread], left[spread], low[spread], high[spread])
        go = left > 0
        word, left, goal, low, high = word[go], left[go] - 1, goal[go], low[go], high[go]
        low, high = index.extend(low, high, text[begin[word] + left])
        others = high - low > 1  # beside the word itself
        word, left, goal, low, high = word[others], left[others], goal[others], low[others], high[others]
    found = [np.zeros((2, 0), np.int64)]
    if branches:
        word, left, low, high = (np.concatenate(c) for c in zip(*branches))
        while len(word):
            ends = left == 0
            found.append(np.stack(index.whole(low[ends], high[ends], word[ends])))
            go = ~ends
            word, left, low, high = word[go], left[go] - 1, low[go], high[go]
            symbol = text[begin[word] + left]
            single = high - low == 1
            next_low, next_high = np.zeros_like(low), np.zeros_like(high)
            one = np.flatnonzero(single)
            one = one[index.before[low[one]] == symbol[one]]
            next_low[one] = index.back[low[one]]
            next_high[one] = next_low[one] + 1
            many = np.flatnonzero(~single)
            next_low[many], next_high[many] = index.extend(low[many], high[many], symbol[many])
            stay = next_high > next_low
            word, left, low, high = word[stay], left[stay], next_low[stay], next_high[stay]
    x, y = np.concatenate(found, axis=1)
    return np.divmod(np.unique(x * index.k + y), index.k)


def _leave(index: Index, word: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """States after one letter that is not the word's next one: in its place, and before it."""
    expected = index.text[index.begin[word] + left - 1]  # the delimiter, where none is left
    narrow = high - low <= NARROW
    counts = (high - low)[narrow]
    at = np.repeat(np.flatnonzero(narrow), counts)
    rows = np.repeat(low[narrow], counts) + bytekit.ranges(counts)
    symbol = index.before[rows]
    keep = (symbol != expected[at]) & (symbol != 0)
    at, low_of = at[keep], index.back[rows[keep]]
    parts = [(at, low_of, low_of + 1)]
    wide = np.flatnonzero(~narrow)
    if len(wide):
        at = np.repeat(wide, len(index.symbols))
        symbol = np.tile(index.symbols, len(wide))
        other = symbol != expected[at]
        at, symbol = at[other], symbol[other]
        low_of, high_of = index.extend(low[at], high[at], symbol)
        some = high_of > low_of
        parts.append((at[some], low_of[some], high_of[some]))
    at, low_of, high_of = (np.concatenate(c) for c in zip(*parts))
    replaced = left[at] > 0
    return [(word[at], left[at], low_of, high_of), (word[at][replaced], left[at][replaced] - 1, low_of[replaced], high_of[replaced])]


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 numbers of all letters, and each word's length."""
    data, at = bytekit.utf8(words)
    lead = data == 0xC3
    values = data.astype(np.int64)
    values[1:][lead[:-1]] += 64
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    return values[~lead], np.diff(at - leads[at])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole groups, from rows sorted by their first column, with PACKED rows or more but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            done = 0
            for edge in edges.tolist():
                if edge - done >= PACKED or edge == edges[-1]:
                    yield table.slice(done, edge - done)
                    done = edge
            held, n = table.slice(done).to_batches(), n - done
    if n:
        yield pa.Table.from_batches(held)


def _pairs_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of near words of one group, each counted in this group, in either direction."""
    key, s, a, b, upto = (table.column(i).to_numpy() for i in (0, 3, 4, 5, 6))
    backwards = table.column(7).to_numpy(zero_copy_only=False).astype(bool)
    letters, sizes = letters_of(table.column(1))
    starts = np.cumsum(sizes) - sizes
    place = bytekit.ranges(sizes)
    turned = np.repeat(backwards, sizes)
    mirrored = np.repeat(starts + sizes - 1, sizes) - place
    own = letters[np.where(turned, mirrored, np.arange(len(letters)))]
    index = Index(own, sizes)
    x, y = near(index, np.flatnonzero(sizes == s), sizes, np.where(backwards, a, b))
    same = (key[x] == key[y]) & (x != y)
    x, y = x[same], y[same]
    at, equal = np.zeros(len(x), np.int64), np.ones(len(x), bool)  # pairs that agree in ``upto`` letters count elsewhere
    limit = np.where(upto[x] > sizes[x], 0, upto[x])
    open_ = np.flatnonzero(limit > 0)
    equal[limit == 0] = False
    while len(open_):
        differ = letters[starts[x[open_]] + at[open_]] != letters[starts[y[open_]] + at[open_]]
        equal[open_[differ]] = False
        at[open_] += 1
        open_ = open_[~differ & (at[open_] < limit[open_])]
    x, y = x[~equal], y[~equal]
    longer = sizes[y] > sizes[x]
    return np.concatenate([x, y[longer]]), np.concatenate([y, x[longer]])


def neighbours(keyed: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of each word in each group its near words' number and the most frequent one."""

    def run(batches):
        for table in _packs(batches):
            x, y = _pairs_of(table)
            if not len(x):
                continue
            n = table.column(2).to_numpy()
            names = table.column(1).combine_chunks()
            alphabetic = np.empty(len(n), np.int64)
            alphabetic[pc.sort_indices(names).to_numpy()] = np.arange(len(n))
            order = np.lexsort((alphabetic[y], -n[y], x))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            counts = np.diff(np.append(first, len(x)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x[first])), pa.array(counts), pa.array(n[y[first]]), names.take(pa.array(y[first]))], ["word", "n_near", "best_n", "best"])

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.select("key", "word", "n", "s", "a", "b", "upto", "backwards").repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from (word, form), the last form that is reached.

    A form is at least TIMES as frequent as its word, so chains are short, and a form has
    one edit to each of its words, so no form has unboundedly many. A round doubles the steps.
    """
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = cut(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = following.drop("moved")
        if following.where("moved").isEmpty():
            return reached


def variants(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for a written table of words (word, n)."""
    found = neighbours(groups(words, most)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))
    often = F.col("n") * TIMES <= -F.col("best.less")
    formed = cut(words.join(found, "word", "left").select(
        "word", F.when(often, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return variants(cut(vocabulary(docs)))
