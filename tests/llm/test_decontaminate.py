import hashlib
import random
import re

from srcatlas.llm import decontaminate


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [m.decode() for m in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower.encode())]


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = tokens(text), set(), set()
        for item_id, item in items:
            v = tokens(item)
            size = min(window, len(v))
            for s in range(len(v) - size + 1 if size else 0):
                for at in range(len(w) - size + 1):
                    if w[at:at + size] == v[s:s + size]:
                        hit.update(range(at, at + size))
                        if item_id is not None:
                            found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["The", "of", "été", "x1", "b", "ä", "na", "to"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(25)] + [(100, None), (101, ""), (7, "ONE two"), (None, "b b b"), (9, say(12))]
    docs = [(i, say(rng.randint(0, 120)) + (rng.choice(items)[1] or "") + say(rng.randint(0, 30))) for i in range(60)]
    docs += [(60, None), (61, ""), (61, docs[0][1]), (None, docs[1][1]), (62, "!!!"), (63, say(5000)), (64, (items[8][1] or "") * 300)]
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, n_words int").repartition(5)
    right = spark.createDataFrame([(*d, 2) for d in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, decontaminate.report(left, right).collect()), key=str)
    assert got == brute(docs, items)
    kept = decontaminate.clean(left, right)
    assert kept.columns == left.columns and kept.count() == sum(not r[5] for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert [r["n_hit"] for r in decontaminate.report(docs, items.limit(0)).collect()] == [0]
    assert [r["n_hit"] for r in decontaminate.report(docs, items).collect()] == [2]
