"""Personal data by anchor expansion: an automaton finds anchors, local parsers expand them.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, address schemes and cue words
of account numbers. At each anchor a deterministic parser looks at its surroundings only, expands
to the boundaries of a candidate and validates it (labels of a domain, parts of an address, Luhn,
mod 97). Kinds keep their own end, so candidates of a kind never overlap.

Kinds, in this order: email, ip, card, phone (the base kinds, each equal to the leftmost
non-overlapping matches of its pattern, invalid matches used up and dropped), then url and account.

Rows are independent: no shuffle. Contracts: a null text is empty; texts of any length are searched
whole; offsets count code points, ends are exclusive; repeated rows give repeated results; result
columns take the place of input columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from srcatlas.llm import bytekit
from srcatlas.llm.frames import map_in_arrow

KINDS = ["email", "ip", "card", "phone", "url", "account"]
BASE = KINDS[:4]
#: Fixed lists: schemes of web addresses, and words that announce an account number.
SCHEMES = ["http://", "https://", "ftp://", "www."]
CUES = ["iban", "account no", "account number", "acct", "kontonummer", "numéro de compte", "número de cuenta", "passport no", "ssn"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'()\[\]{}]+")
_ACCOUNT = re.compile(r"[\s:.#=]{0,4}([A-Za-z]{0,2}[0-9](?:[ -]?[A-Za-z0-9]){4,33})")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}")

_AT, _PLUS, _DIGIT, _SCHEME, _CUE = range(5)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _account_ok(value: str) -> bool:
    bare = re.sub(r"[ -]", "", value)
    if _IBAN.fullmatch(bare):
        moved = bare[4:] + bare[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    return sum(c.isdigit() for c in bare) >= 6


def _automaton():
    a = ahocorasick.Automaton()
    a.add_word("@", (_AT, 1))
    a.add_word("+", (_PLUS, 1))
    for d in "0123456789":
        a.add_word(d, (_DIGIT, 1))
    for s in SCHEMES:
        a.add_word(s, (_SCHEME, len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize(), c.title()}:
            a.add_word(form, (_CUE, len(form)))
    a.make_automaton()
    return a


def spans_of(text: str, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    email, ip, card, phone, url, account = found = [], [], [], [], [], []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (anchor, size) in automaton.iter(text):
        at = last + 1 - size
        if anchor == _DIGIT:
            if at >= ip_end:
                if m := _IP.match(text, at):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        ip.append((at, ip_end))
                else:
                    ip_end = _DIGITS.match(text, at).end()
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    card.append((at, card_end))
        elif anchor == _AT:
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                email.append((start, email_end))
        elif anchor == _PLUS:
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    phone.append((at, phone_end))
        elif anchor == _SCHEME:
            if at >= url_end and (at == 0 or not text[at - 1].isalnum()) and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?"))
                if "." in text[at + size:end] or text[last] == "/" and end > last + 1:
                    url.append((at, end))
                    url_end = end
        elif at >= account_end and (at == 0 or not text[at - 1].isalnum()):
            if (m := _ACCOUNT.match(text, last + 1)) and _account_ok(m[1]):
                account.append((m.start(1), m.end(1)))
                account_end = m.end(1)
    return [(kind, s, e) for kind, own in zip(KINDS, found) for s, e in own]


def find(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds ``spans``: array of (kind, start, end), by kind as listed and then start."""
    kept = [c for c in df.columns if c != spans]
    found = StructType.fromDDL("kind string, start int, end int")
    schema = StructType([*(df.schema[c] for c in kept), StructField(spans, ArrayType(found))])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        automaton = _automaton()
        for batch in batches:
            texts = batch.column(kept.index(text))
            for part in bytekit.chunks(texts, 8 << 20):
                first, n = int(part.rows[0]), len(part.rows)
                out = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, automaton)] if t else [] for t in texts.slice(first, n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, n).columns, pa.array(out, pa.list_(kind))], [*kept, spans])

    return map_in_arrow(df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in kept)), run, schema)


def masked(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replaces every span of a text by its kind in angle brackets; of overlapping ones the first counts."""
    return df.withColumn(text, F.expr(f"""aggregate(array_sort(transform({spans}, x -> struct(x.start as start, x.end as upto, x.kind as kind))),
        struct('' as done, 0 as at),
        (a, x) -> if(x.start < a.at, a, struct(concat(a.done, substring({text}, a.at + 1, x.start - a.at), '<', x.kind, '>') as done, x.upto as at)),
        a -> concat(a.done, substring({text}, a.at + 1)))"""))


def joined(spans: str, kinds: list[str]) -> Column:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"array_join(transform(filter({spans}, x -> x.kind in ({listed})), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    out = find(docs.select("doc_id", F.col("text").cast("string"))).drop("text")
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined("spans", BASE), 256).alias("base_sha256"), joined("spans", KINDS).alias("spans"))
