"""Operators that keep other columns keep them whatever they are called."""

import pytest

from srcatlas.llm import byte_bpe, chat_format, decontaminate, jaccard_join, language_id, line_dedup, personal_data

SCHEMA = "doc_id long, text string, lang string, `my col` string, `a.b` string, `a-b` int, __row long, __lost string, __word long, __doc string, nested struct<`x y`: int, `p.q`: string>"


def rows():
    words = [f"w{i} und das ist ein {chr(97 + i)} satz über" for i in range(20)]
    return [(i, f"{words[i]} {i * 7919} {words[(i * 3) % 20]} der die mail a{i}@b.de\nzweite zeile {i * 31337}", "de", f"m{i}", f"d{i}", i, 10 * i, f"l{i}", 5 * i, f"o{i}", (i, f"q{i}")) for i in range(20)]


def tokens(docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    return byte_bpe.encode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, decoded="decoded")


OPERATORS = {
    "language": language_id.accepted, "lines": line_dedup.distinct_lines, "near": jaccard_join.distinct, "personal": personal_data.find, "tokens": tokens,
    "clean": lambda docs: decontaminate.clean(docs, docs.sparkSession.createDataFrame([("i", "nowhere to be found")], "item_id string, text string")),
    "chat": lambda docs: chat_format.canonical(docs.withColumnRenamed("text", "record"), "record"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_columns_stay(spark, name):
    given = rows()
    out = OPERATORS[name](spark.createDataFrame(given, SCHEMA))
    kept = [c for c in out.columns if c in ("doc_id", "lang", "my col", "a.b", "a-b", "__row", "__lost", "__word", "__doc", "nested")]
    assert len(kept) == 10
    got = {r["doc_id"]: [r[c] for c in kept] for r in out.collect()}
    assert len(got) == len(given)
    for row in given:
        plain = [v for i, v in enumerate(row) if i != 1]
        assert [tuple(v) if isinstance(v, tuple) else v for v in got[row[0]]] == plain
