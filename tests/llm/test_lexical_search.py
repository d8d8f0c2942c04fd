import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from srcatlas.llm import bytekit, lexical_search


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [m.decode() for m in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower.encode())]


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in own:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "été", "x1", "b", "ä", "na"] + [f"w{int(rng.paretovariate(0.5))}" for _ in range(60)]
    say = lambda m: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "'"]) for _ in range(m))
    docs = [(i, say(int(rng.paretovariate(0.6)) % 400)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!!!"), (None, "the of"), (3, docs[4][1]), (n + 3, docs[4][1]), (n + 4, docs[4][1]), (n + 5, say(30000)), (n + 6, "the " * 70000)]
    items = [(i, say(rng.choice([1, 2, 5, 20, 60]))) for i in range(15)] + [(50, None), (51, ""), (52, "nowhere"), (None, "the"), (2, "of b"), (53, docs[4][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus(700, 1)
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, `a.b` string").repartition(3)
    right = spark.createDataFrame([(*d, 5) for d in items], "item_id long, text string, doc_id int").repartition(2)
    want = brute(docs, items)
    assert sorted(map(tuple, lexical_search.report(left, right).collect())) == want
    small = lexical_search.build_index(left, segment_docs=50).cache()
    assert small.select("segment").distinct().count() > 12
    assert sorted(map(tuple, lexical_search.search(small, right).collect())) == want
    assert sorted(map(tuple, lexical_search.search(small, right, k=3).collect())) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "c")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "A b")], "item_id string, text string")
    assert lexical_search.report(docs.limit(0), items).count() == 0
    assert lexical_search.report(docs, items.limit(0)).count() == 0
    got = lexical_search.report(docs, items).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [("i", 1, 1)]


@pytest.mark.parametrize("window", [16, 2048])
def test_blocks_are_left_compressed(monkeypatch, window):
    """Non-essential lists are opened in few blocks once the k-th score is high, with the same answers."""
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "WINDOW", window)
    rng = random.Random(2)
    texts = [" ".join(["common"] * rng.randint(1, 3) + [f"r{rng.randint(0, 400)}"] + ["pad"] * rng.randint(0, 40)) for _ in range(4000)]
    for i in range(5, 4000, 300):
        texts[i] = "rare common"
    segment = lexical_search.Segment()
    for chunk in bytekit.chunks(pa.array(texts)):
        segment.add(np.arange(len(texts))[chunk.rows], chunk)
    rows = pa.Table.from_batches(list(segment.rows(0))).to_pylist()
    by = {r["term"]: r for r in rows}
    statistics = lexical_search.Statistics(by[""]["df"], by[""]["cf"])
    m = statistics.damping(np.frombuffer(by[""]["postings"], np.int64))
    weight = lambda t: math.floor(1000 * math.log((2 * statistics.documents + 2) / (2 * by[t]["df"] + 1)))
    lists = [lexical_search.List(by[t]["heads"], by[t]["postings"], weight(t), statistics) for t in ("rare", "common")]
    heap = lexical_search.Heap(3)
    lexical_search.search_segment(lists, np.arange(4000), m, heap)
    assert sorted((-s, -d) for s, d in heap.kept) == [(-s, d) for _, _, d, s in brute(list(enumerate(texts)), [(0, "rare common")], 3)]
    if window == 16:
        assert len(lists[1].open) < len(lists[1].last) / 2
