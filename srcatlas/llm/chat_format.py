"""Chat formatting: fingerprints of field paths choose the mapping that makes canonical turns.

A record (JSON) has a set of nested field paths, such as ``messages[].role``. The hash of the set,
restricted to paths that any mapping knows, is the record's fingerprint, and a table from
fingerprint to ``Mapping`` says where roles and texts are; no mapping is tried by trial and error.
A mapping is data: a list path or none, the fields of a turn or a fixed list of (role, field), and
names of roles.

Template, per turn: ``<|turn|>role\\ntext<|end|>\\n``. Every ``<`` and ``[`` of a text is followed by
an inserted backslash, so no control string (all begin with one of them) can come from a text, and
taking exactly one backslash away after each gives the text back. In a role a line feed becomes
``[n``, which an escaped role cannot hold otherwise. The loss mask covers assistant texts.

Turns are formatted row by row; a conversation is read back in one pass over sorted rows, of which
only the current turn is in memory, so a conversation of any length can be digested.

Contracts. A null text is empty, a null role is empty. Turns are ordered by (order column, role,
text); ties and repeated rows all stay. A null conversation id is one conversation of its own. A
record that matches no mapping has no turns and ``layout`` null, as has a text that is no JSON
object or is nested too deep to be read; half of a surrogate pair becomes a question mark. A
conversation is read back in one task, as its digest needs its turns in order. Other columns are ignored; names of results never clash with them. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from srcatlas.llm.frames import map_in_arrow

OPEN, CLOSE = "<|turn|>", "<|end|>"
_PIECE = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``items``: path of a list with one element per turn, "" for the record itself; ``role`` and
    ``text`` are fields of an element. Or ``fields``: a turn each, as (role, path). ``system``: a
    path whose text is a first system turn. ``optional``: paths that may be missing.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    system: str = ""
    optional: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        inner = f"{self.items}[]." if self.items else ""
        own = {inner + self.role, inner + self.text} if self.role else {p for _, p in self.fields}
        return own | ({self.system} if self.system else set())


MAPPINGS = [
    Mapping("turn", role="role", text="text", optional=("role", "text")),
    Mapping("turn_content", role="role", text="content", optional=("content",)),
    Mapping("messages", "messages", "role", "content", system="system", optional=("system", "messages[].content")),
    Mapping("nested_messages", "data.messages", "role", "content", optional=("data.messages[].content",)),
    Mapping("exchanges", "conversations", "from", "value", system="system", optional=("system", "conversations[].value"),
            names={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), system="system", optional=("system", "input")),
    Mapping("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", fields=(("user", "prompt"), ("assistant", "response")), system="system", optional=("system",)),
    Mapping("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
]


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all leaves; lists add ``[]``, nulls and empty lists count as missing."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else set()
    return set() if value is None else {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def fingerprints(mappings: list[Mapping]) -> tuple[set[str], dict[str, Mapping]]:
    """All known paths, and the mapping of each fingerprint; of two the earlier mapping counts."""
    known: set[str] = set().union(*(m.paths() for m in mappings))
    table: dict[str, Mapping] = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for left_out in itertools.combinations(m.optional, n):
                if left := m.paths() - set(left_out):
                    table.setdefault(fingerprint(left), m)
    return known, table


def _text(value) -> str:
    """A value as text; half of a surrogate pair, which no text can hold, becomes a question mark."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return text.encode("utf-8", "replace").decode()


def _at(record, path: str):
    for step in path.split(".") if path else []:
        record = record.get(step) if isinstance(record, dict) else None
    return record


def turns_of(record: dict, m: Mapping) -> list[tuple[str, str]]:
    out = [("system", _text(_at(record, m.system)))] if m.system and _at(record, m.system) is not None else []
    if m.role:
        items = _at(record, m.items)
        for item in items if isinstance(items, list) else [items]:
            if isinstance(item, dict):
                role = _text(item.get(m.role))
                out.append((m.names.get(role, role), _text(item.get(m.text))))
        return out
    parts = [(role, _text(_at(record, path))) for role, path in m.fields if _at(record, path) not in (None, "")]
    for role, same in itertools.groupby(parts, key=lambda p: p[0]):
        out.append((role, "\n\n".join(text for _, text in same)))
    return out


def canonical(df: DataFrame, record: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """Replaces the JSON column by ``layout`` (the mapping's name) and ``turns`` (role, text)."""
    mappings = mappings or MAPPINGS
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    kept = [c for c in df.columns if c not in (record, "layout", "turns")]
    made = StructType.fromDDL("layout string, turns array<struct<role:string,text:string>>")
    fields = StructType([*(df.schema[c] for c in kept), *made.fields])
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in (*kept, record)]

    def run(batches):
        known, table = fingerprints(mappings)
        for batch in batches:
            names, turns = [], []
            for text in batch.column(len(kept)).to_pylist():
                try:
                    value = json.loads(text) if text else None
                    m = table.get(fingerprint(field_paths(value) & known)) if isinstance(value, dict) else None
                    own = [{"role": r, "text": t} for r, t in turns_of(value, m)] if m else []
                except (ValueError, RecursionError):  # no JSON, or nested deeper than can be read
                    m, own = None, []
                names.append(m.name if m else None)
                turns.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(names, pa.string()), pa.array(turns, pa.list_(turn))], [*kept, "layout", "turns"])

    return map_in_arrow(df.select(*quoted), run, fields)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


def formatted(turns: DataFrame) -> DataFrame:
    """Rows with ``role`` and ``text`` get ``piece`` and its loss span [loss_from, loss_to), in characters."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("[n")), F.lit("\n"))
    body = escaped(text)
    begin = F.length(head)
    return turns.withColumns({
        "piece": F.concat(head, body, F.lit(CLOSE + "\n")),
        "loss_from": F.when(role == "assistant", begin).otherwise(F.lit(0)),
        "loss_to": F.when(role == "assistant", begin + F.length(body)).otherwise(F.lit(0)),
    })


def read_back(pieces: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """Parse formatted pieces, in order, back into turns; digest each conversation."""
    kind = pieces.schema[conversation].dataType.simpleString()
    rows = pieces.select(conversation, *order, "piece", "loss_from", "loss_to")
    rows = rows.repartition(conversation).sortWithinPartitions(conversation, *order, "piece").select(conversation, "piece", "loss_from", "loss_to")

    def run(batches):
        current, state = object(), None

        def result():
            key, n, turns, chars, loss, total = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            done = []
            for key, piece, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != current:
                    if state is not None:
                        done.append(result())
                    current, state = key, [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in _PIECE.findall(piece):
                    role, text = unescape(role.replace("[n", "\n")), unescape(text)
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if end > begin:
                    text = unescape(piece[begin:end])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(piece)
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([result()])

    names = [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def batch_of(rows):
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return rows.mapInArrow(run, f"{conversation} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Format a table of turns (conv_id, turn, role, text) and read it back."""
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    turns = canonical(rows.select("conv_id", "turn", record.alias("record")), "record").select("conv_id", "turn", F.explode("turns").alias("t"))
    return read_back(formatted(turns.select("conv_id", "turn", "t.role", "t.text")), "conv_id", ["turn"])
