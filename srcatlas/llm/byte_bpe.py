"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

A text is split by a pattern and each match is encoded by itself. Its bytes are read as Latin-1
text, so that an Aho-Corasick automaton over the vocabulary gives the longest token at every
place. Encoding goes on from longest token to longest token and steps back to a shorter one only
where two neighbours could not stand side by side in the result of the merges. Whether they can is
found once for each pair, from the merges that make the two of their bytes, so the work is linear in
the text and the ids are those of the merges.

Rows are independent: no shuffle, and a lost task is run again from its input. Both directions
run in one Python worker of a task. What a worker remembers of texts and of pairs of tokens is bounded,
in bytes and in entries, and serves its next tasks.

Contracts. A null text is an empty one: no ids, an empty packed column. Texts of any length are
encoded whole. Repeated rows give repeated results. Columns of the input stay as they are; where
one has the name of a result, the result takes its place. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from srcatlas.llm import bytekit
from srcatlas.llm.frames import map_in_arrow

#: Bytes that a worker spends on stretches of text it remembers, and pairs of tokens; beyond it they are forgotten.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 80 << 20, 400_000
#: What an entry takes beside its own bytes, about.
ENTRY_BYTES = 200
#: Bytes of text that are handed on at once.
PART_BYTES = 2 << 20
#: White space as the split pattern means it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts a text where no match of the usual split patterns goes on: before a blank and a visible
#: character, and around other white space as those patterns cut it. Each stretch is then split
#: by the pattern itself; stretches recur, so most are looked up whole.
STRETCHES = rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


class Decoder:
    """Bytes of the ids of a rank file (a base64 token and its rank per line)."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.size_of = np.array(self.sizes, np.int64)
        self.place_of = np.cumsum(self.size_of) - self.size_of

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        sizes = self.size_of[ids]
        return self.flat[np.repeat(self.place_of[ids], sizes) + bytekit.ranges(sizes)].tobytes()


class Codec(Decoder):
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: bytes, pattern: str, stretches: str | None = STRETCHES):
        """``stretches``: None for a pattern whose matches may run from visible into white space."""
        super().__init__(rank_file)
        self.split = regex.compile(pattern).findall
        self.stretches = re.compile(stretches).findall if stretches else lambda text: [text]
        ranks = self.ranks
        #: The longest token that a token begins with, beside itself.
        self.shorter = [next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.histories: dict[int, list | None] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes of ``known``, about

    def _merges(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """The merges that make a token of its bytes, lowest rank first: rank, and the first and last part after it.

        None for a token that merging does not reach.
        """
        rank, none, piece = self.ranks.get, len(self.tokens), self.tokens[token]
        parts, out = [piece[i:i + 1] for i in range(len(piece))], []
        while len(parts) > 1:
            pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
            lowest = min(pairs)
            if lowest == none:
                return None
            at = pairs.index(lowest)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            out.append((lowest, parts[0], parts[-1]))
        return out

    def _history(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        if token not in self.histories:
            self.histories[token] = self._merges(token)
        return self.histories[token]

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b, lowest rank first, leaves just a and b.

        Until something merges over the border each side goes its own way, so their merges are taken
        in turn by rank. The parts at the border must never be the next to merge.
        """
        left, right, rank, none = self._history(a), self._history(b), self.ranks.get, len(self.tokens)
        if left is None or right is None:
            return False
        last, first, i, j = self.tokens[a][-1:], self.tokens[b][:1], 0, 0
        border = rank(last + first, none)
        while True:
            x, y = left[i][0] if i < len(left) else none, right[j][0] if j < len(right) else none
            if border < x and border <= y and border < none:  # of equal merges the left one comes first
                return False
            if x == y == none:
                return True
            if x <= y:
                last, i, changed = left[i][2], i + 1, last
                moved = changed is not last
            else:
                first, j, changed = right[j][1], j + 1, first
                moved = changed is not first
            if moved:
                border = rank(last + first, none)

    def ids_of(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        sizes, shorter, fits = self.sizes, self.shorter, self.fits
        n = len(piece)
        longest = [-1] * (n + 1)
        for last, rank in self.automaton.iter(piece.decode("latin-1")):
            start = last + 1 - sizes[rank]
            if longest[start] < 0 or sizes[longest[start]] < sizes[rank]:
                longest[start] = rank
        open_end = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = ids[-1] if ids else -1
            while token >= 0:
                if open_end[at + sizes[token]]:
                    if before < 0:
                        break
                    pair = before << 32 | token
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) >= REMEMBERED_PAIRS:
                            fits.clear()
                        fit = fits[pair] = self._side_by_side(before, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += sizes[token]
                token = longest[at]
            elif ids:
                open_end[at] = 0
                token = ids.pop()
                at -= sizes[token]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        stretches = self.stretches(text)
        out = list(map(self.known.get, stretches))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    stretch = stretches[i]
                    if (ids := self.known.get(stretch)) is None:
                        ids = b"".join([self._piece(p) for p in self.split(stretch)])
                        self._remember(stretch, ids)
                    out[i] = ids
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """Packed ids of one match of the pattern; a stretch is often one, or one and a sign."""
        ids = self.known.get(piece)
        if ids is None:
            ids = array("I", self.ids_of(piece.encode("utf-8"))).tobytes()
            self._remember(piece, ids)
        return ids

    def _remember(self, text: str, ids: bytes) -> None:
        if len(text) >= 256 or text in self.known:
            return
        if self.held >= REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        self.known[text] = ids
        self.held += len(text) + len(ids) + ENTRY_BYTES


_BUILT: dict[str, Decoder] = {}


def _once(kind: type, rank_file: bytes, *more: str) -> Decoder:
    """The codec or decoder of a rank file; a worker builds it once and keeps one."""
    key = hashlib.sha256(b"\0".join([kind.__name__.encode(), rank_file, *(m.encode() for m in more)])).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = kind(rank_file, *more)
    return _BUILT[key]


def codec(rank_file: bytes, pattern: str) -> Codec:
    return _once(Codec, rank_file, pattern)


def _widened(df: DataFrame, **fields) -> StructType:
    kept = [f for f in df.schema.fields if f.name not in fields]
    return StructType(kept + [StructField(k, v) for k, v in fields.items()])


def _with(batch: pa.RecordBatch, schema: StructType, **columns: pa.Array) -> pa.RecordBatch:
    names = schema.fieldNames()
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(batch.schema.get_field_index(n)) for n in names], names)


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut into pieces of bounded bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        for part in bytekit.chunks(texts, PART_BYTES):
            first, n = int(part.rows[0]), len(part.rows)
            yield batch.slice(first, n), texts.slice(first, n)


def _sent(df: DataFrame, ranks_path: str):
    """The rank file, read where the job is planned; its size is the vocabulary's."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", packed: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Adds ``packed`` (ids of the text as little-endian 32-bit numbers) and ``n_tokens``.

    With ``decoded`` a column of that name holds the bytes that the ids stand for, read back in the same pass.
    """
    sent = _sent(df, ranks_path)
    schema = _widened(df, **{packed: BinaryType(), "n_tokens": LongType()}, **({decoded: BinaryType()} if decoded else {}))

    def run(batches):
        c = codec(sent.value, pattern)
        for batch, texts in _parts(batches, text):
            out = [c.encode(t) if t else b"" for t in texts.to_pylist()]
            back = {decoded: pa.array([c.decode(x) for x in out], pa.binary())} if decoded else {}
            yield _with(batch, schema, **{packed: pa.array(out, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64())}, **back)

    return map_in_arrow(df, run, schema)


def decode(df: DataFrame, ranks_path: str, packed: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the bytes that the packed ids stand for; null ids are no ids."""
    sent = _sent(df, ranks_path)
    schema = _widened(df, **{decoded: BinaryType()})

    def run(batches):
        d = _once(Decoder, sent.value)
        for batch, ids in _parts(batches, packed):
            yield _with(batch, schema, **{decoded: pa.array([d.decode(x or b"") for x in ids.to_pylist()], pa.binary())})

    return map_in_arrow(df, run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the packed ids and of what they decode to."""
    out = encode(docs.select("doc_id", "text"), ranks_path, pattern, decoded="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
