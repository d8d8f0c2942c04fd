import random
import re

import numpy as np

from srcatlas.llm import jaccard_join as jj


def shingles(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower) if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, percent=85):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def documents(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    docs = []
    for base in range(25):
        origin = say(rng.choice([1, 3, 4, 6, 9, 14, 20, 40, 80, 150, 400]))
        for _ in range(rng.randint(1, 14)):
            w = list(origin)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = say(rng.randint(0, 2))
            docs.append((len(docs), rng.choice([" ", "\n"]).join(w)))
    chain = say(300)
    for step in range(12):  # neighbours link, ends do not
        chain = chain[4:] + say(4)
        docs.append((len(docs), " ".join(chain)))
    docs += [(1000 + i, "Same Text again and again") for i in range(30)]
    docs += [(2000, None), (2001, ""), (2002, " \n "), (None, docs[0][1]), (2003, docs[1][1]), (2003, docs[1][1]), (2004, " ".join(say(30_000)))]
    return docs


def test_against_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, component_id string").repartition(6)
    assert sorted(map(tuple, jj.groups(df).collect()), key=str) == brute(docs)
    kept = jj.distinct(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _, c in brute(docs) if i == c), key=str)
    assert jj.groups(df.limit(0)).count() == 0


def test_linked_sets_share_a_block():
    """Every pair that links has a block key in common, over many sizes and as far apart as allowed."""
    rng = np.random.default_rng(3)
    for size in [*range(1, 40), 55, 90, 170, 333, 700]:
        for _ in range(12):
            a = rng.integers(1, 1 << 63, size, dtype=np.uint64)
            best = []
            for drop in range(size):
                for add in range(0, size):
                    if 100 * (size - drop) >= 85 * (size + add):
                        best.append((drop + add, drop, add))
                    else:
                        break
            _, drop, add = max(best)
            b = np.concatenate([a[drop:], rng.integers(1, 1 << 63, add, dtype=np.uint64)])
            keys, owners = jj.block_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), 85)
            assert set(keys[owners == 0]) & set(keys[owners == 1]), (size, drop, add)


def test_tree_finds_all_within_the_bound():
    rng = np.random.default_rng(5)
    flat, sizes = [], []
    for _ in range(20):
        base = rng.integers(1, 1 << 60, 120, dtype=np.uint64)
        for _ in range(6):
            n = int(rng.integers(90, 121))
            flat.append(base[:n])
            sizes.append(n)
    sizes = np.array(sizes)
    points = jj.count_vectors(np.concatenate(flat), sizes)
    asked, found = jj.RTree(points, sizes).search(points, sizes, 85)
    got = set(zip(asked.tolist(), found.tolist()))
    for i in range(len(sizes)):
        for j in range(len(sizes)):
            both = len(set(flat[i]) & set(flat[j]))
            if 100 * both >= 85 * (sizes[i] + sizes[j] - both):
                assert (i, j) in got
    assert len(got) < len(sizes) * 12


def test_tree_keeps_pairs_whose_counts_are_clipped():
    flat = np.random.default_rng(8).integers(0, 1 << 63, 5_000_000).astype(np.uint64)
    sizes = np.array([len(flat)])
    points = jj.count_vectors(flat, sizes)
    asked, found = jj.RTree(points, sizes).search(points, sizes, 80)
    assert (asked.tolist(), found.tolist()) == ([0], [0])


def test_parities_rule_out_no_link():
    rng = np.random.default_rng(6)
    for size in (1, 5, 40, 300, 1500):
        base = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        other = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        for drop in {0, size // 40, size // 13}:
            b = np.concatenate([base[drop:], rng.integers(1, 1 << 63, drop, dtype=np.uint64)])
            x, y, z = jj.parities(np.concatenate([base, b, other]), np.array([size] * 3))
            assert np.bitwise_count(x ^ y).sum() <= 2 * drop
            assert size < 40 or np.bitwise_count(x ^ z).sum() * 185 > 2 * size * 15


def test_few_texts_meet_and_buckets_follow_the_block_keys(spark, monkeypatch):
    """Documents that share all but a few words: blocks in common, hardly a link."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for i in range(120):
        w = list(common)
        for at in rng.sample(range(60), 6):
            w[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
        if i % 20 == 0:
            docs.append((1000 + i, docs[-1][1] + " more"))
    sent, given, verified, block_members = [], [], jj.verified, jj.block_members
    monkeypatch.setattr(jj, "BUCKET_KEYS", 50, raising=False)
    monkeypatch.setattr(jj, "verified", lambda pairs, *rest: sent.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(jj, "block_members", lambda *a: given.append(a[-1]) or block_members(*a))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jj.groups(df).collect()), key=str) == brute(docs)
    assert sum(sent) <= 20
    assert given[0] > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_parities_of_large_sets_rule_pairs_out():
    """Sets of more shingles than cells, of one level and of two: links pass, sets with little in common do not."""
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
    for size in (1020, 3000, 4100, 20_000):
        for percent in (80, 85):
            base = draw(size)
            drop = size * (100 - percent) // 100
            linked = [base, base[drop:], np.concatenate([base[drop // 2:], draw(drop // 2 * percent // 100)])]
            others = [draw(size), np.concatenate([base[:size // 3], draw(size - size // 3)])]
            sets = linked + others
            sizes = np.array([len(x) for x in sets])
            odd = np.frombuffer(b"".join(jj.packed_parities(np.concatenate(sets), sizes).to_pylist()), np.uint64).reshape(len(sets), -1)
            one, many = (sizes[[0] * len(sets)], odd[[0] * len(sets)]), (sizes, odd)
            assert jj.allowed(one, many, percent).tolist() == [True, True, True, False, False], (size, percent)
            assert jj.allowed(many, one, percent).tolist() == [True, True, True, False, False]


def test_large_texts_with_a_passage_in_common_do_not_meet(spark, monkeypatch):
    """Texts too large for the cells, in one block through common passages, no two of them linked but the planted ones."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = say(400)
    docs = [(i, " ".join(say(2600) + passage)) for i in range(24)]
    docs += [(100 + i, docs[i][1] + " and more") for i in range(3)]
    sent, kept, verified, tree_pairs = [], [], jj.verified, jj.tree_pairs
    monkeypatch.setattr(jj, "verified", lambda pairs, *rest: sent.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(jj, "tree_pairs", lambda *a: kept.append(tree_pairs(*a).count()) or tree_pairs(*a))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jj.groups(df, k=5, percent=80).collect()), key=str) == sorted(((i, len(shingles(t, 5)), i % 100) for i, t in docs), key=str)
    assert sum(sent) <= 6
    assert kept == [0]
