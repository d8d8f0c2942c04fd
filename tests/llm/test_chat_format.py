import hashlib
import json

from pyspark.sql import functions as F


from srcatlas.llm import chat_format as chat


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] <|turn|>user\nx<|end|>\n<\\ [\\ \\< <|im_end|> é😀 [n"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (2, 0, "assistant", ""),
            (2, 1, "odd\n[n<role", "a" * 300_000), (None, 0, "user", "q"), (None, None, "assistant", "r")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, piece string").repartition(4)
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0)
    for conv in (1, 2, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), digest(turns))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(df.limit(0)).count() == 0
    pieces = chat.formatted(df.where("conv_id = 1")).collect()
    assert all(p["piece"].count("<|turn|>") == 1 and "</s>" not in p["piece"] and "[INST]" not in p["piece"] for p in pieces)


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "weight": 1}], "id": 7}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "exchanges", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "do", "input": "it", "output": "ok"}, "instruction", [("user", "do\n\nit"), ("assistant", "ok")]),
        ({"instruction": "do", "output": "ok", "lang": None}, "instruction", [("user", "do"), ("assistant", "ok")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"data": {"messages": [{"role": "user", "content": "a"}]}}, "nested_messages", [("user", "a")]),
        ({"question": "q", "answer": 5}, "question_answer", [("user", "q"), ("assistant", "5")]),
        ({"unknown": 1}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(98, "no json"), (99, None)], "id int, record string")
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical(df, "record").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i] == (layout, turns)
    assert got[98] == got[99] == (None, [])
    assert chat.canonical(df.withColumn("turns", F.lit(1)), "record").columns == ["id", "layout", "turns"]


def test_records_that_cannot_be_read(spark):
    """Half a surrogate pair becomes a question mark; a record nested too deep has no layout."""
    deep = '{"prompt": ' + "[" * 100_000 + "]" * 100_000 + ', "response": "x"}'
    half = '{"prompt": "a\\ud800b", "response": "ok"}'
    rows = [(1, half, "k"), (2, deep, "k"), (3, '{"prompt": "p", "response": "r"}', "k")]
    df = spark.createDataFrame(rows, "conv_id long, record string, `a.b` string")
    got = {r["conv_id"]: r for r in chat.canonical(df, "record").collect()}
    assert got[2]["layout"] is None and got[2]["turns"] == []
    assert [t["text"] for t in got[1]["turns"]] == ["a?b", "ok"] and got[1]["layout"] == got[3]["layout"] is not None
    assert got[1]["a.b"] == "k"
