import random
import re
import zlib
from collections import Counter

import pytest

from srcatlas.llm import spelling_variants


def words_of(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(vocabulary):
    near = {w: [v for v in vocabulary if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best and vocabulary[best] >= 10 * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocabulary[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeÄéß") for _ in range(rng.randint(6, 12))) for _ in range(12)] + ["aaaaaaaa", "abababababab", "Straßenbahn", "ÿÿÿÿÿÿÿ", "x" * 40]

    def typo(w):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randint(0, len(w) - 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abeé") + w[i:], w[:i] + rng.choice("abeé") + w[i + 1:]])
        return w

    docs = [(i, rng.choice([" ", "\n"]).join(rng.choice([typo(rng.choice(stems)), stems[0], rng.choice(stems)]) + rng.choice(["", ".", "×1", "ō", "9"]) for _ in range(30))) for i in range(n)]
    docs += [(n + 10 + i, text) for i, text in enumerate(["kalabarata " * 20] * 30 + ["kalabaratu " * 8] * 4 + ["kalabarutu"] * 3)]
    long = "".join(rng.choice("abcdefgh") for _ in range(20000))
    return docs + [(n, None), (n + 1, ""), (n + 1, docs[0][1]), (None, docs[1][1]), (n + 2, long), (n + 3, long), (n + 4, long[:9000] + "q" + long[9000:]), (n + 5, long[:9000] + "q" + long[9000:])]


def table(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    vocabulary = words_of(docs)
    want = brute(vocabulary)
    assert len(vocabulary) > 300 and any(r[2] != r[1] and r[1] for r in want)
    assert sorted(map(tuple, spelling_variants.report(table(spark, docs)).collect())) == want


@pytest.mark.parametrize("most", [3, 12])
def test_large_groups_are_dealt_out_anew(spark, most):
    """Halves of halves, down to one open character, give the same pairs, each of them once."""
    vocabulary = words_of(corpus(3))
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    groups = spelling_variants.groups(words, most)
    assert groups.where("a > 0 and b > 0").count() > 0
    assert groups.groupBy("key", "s", "a", "b").count().where(f"count > {most} and s - a - b > 1").count() == 0
    assert sorted(map(tuple, spelling_variants.variants(words, most).collect())) == brute(vocabulary)


def test_random_vocabularies_in_one_index():
    import pyarrow as pa

    rng = random.Random(4)
    for size in (1, 2, 50, 400):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(size)})
        for s in (7, 8):
            own = [w for w in words if len(w) in (s, s + 1)]
            got = set()
            for backwards in (True, False):
                if not own:
                    continue
                k = len(own)
                columns = [[1] * k, own, [2] * k, [s] * k, [s // 2 if backwards else 0] * k, [0 if backwards else s - s // 2] * k, [1 << 30] * k if backwards else [s // 2] * k, [backwards] * k]
                x, y = spelling_variants._pairs_of(pa.table([pa.array(c) for c in columns], list("abcdefgh")))
                pairs = list(zip(x.tolist(), y.tolist()))
                assert len(set(pairs)) == len(pairs) and not got & set(pairs)
                got |= set(pairs)
            want = {(i, j) for i, w in enumerate(own) for j, v in enumerate(own) if one_edit(w, v) and min(len(w), len(v)) == s}
            assert got == want


def test_empty_table(spark):
    assert spelling_variants.report(table(spark, [(1, "short words only")])).count() == 0
    assert spelling_variants.report(table(spark, [(1, "x")]).limit(0)).count() == 0
