import numpy as np

from srcatlas.llm import embedding_dedup as ed


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24))
    rows = []
    for b in base:
        for _ in range(int(rng.integers(1, 6))):
            rows.append((b + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25, 0.33])).tolist())
    hub = rng.normal(size=24)
    rows += [(hub + rng.normal(size=24) * 0.15).tolist() for _ in range(700)] + [hub.tolist()] * 40
    data = list(enumerate(rows))
    odd = [(90_000, None), (90_001, [0.0] * 24), (90_002, [float("nan")] + rows[0][1:]), (90_003, [float("inf")] + rows[0][1:]), (90_004, [None] + rows[0][1:]), (90_005, []), (90_006, rows[0][:3]), (None, rows[0])]
    big = (90_007, [x * 1e300 for x in rows[0]])
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data + odd + [big]], "vec_id long, embedding array<double>, label int, kept string").repartition(5)
    got = {r["vec_id"]: r for r in ed.near_duplicates(df).collect()}
    ids = [i for i, _ in data] + [90_007]
    x = np.array(rows + [rows[0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    truth = near.sum()
    links = sum(got[i]["n_links"] for i in ids)
    assert 0.97 * truth <= links <= truth
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, near.sum(axis=1)))
    for i, v in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    parent = np.arange(len(ids))
    for _ in range(60):
        parent = np.minimum(parent, np.where(near, parent[None, :], len(ids)).min(axis=1))
    want = [ids[p] for p in parent]
    assert np.mean([got[i]["component_id"] == w for i, w in zip(ids, want)]) > 0.99
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)


def test_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = ed.near_duplicates(one).collect()
    assert sorted((r["vec_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1)]
    nothing = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ed.near_duplicates(nothing).collect()] == [(1, 0, 1, True)]
    bits, tables = ed.plan(50_000, 0.9)
    assert bits == 12 and 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= 0.97


def test_recall_with_a_strong_common_mean(spark):
    rng = np.random.default_rng(7)
    width, share = 48, 0.7
    common = np.eye(width)[0] * np.sqrt(share)
    a = rng.normal(size=(1500, width - 1))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    w = rng.normal(size=a.shape)
    w -= (w * a).sum(axis=1, keepdims=True) * a
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = (0.902 - share) / (1 - share)
    own = np.concatenate([a, c * a + np.sqrt(1 - c * c) * w]) * np.sqrt(1 - share)
    x = np.concatenate([np.zeros((len(own), 1)), own], axis=1) + common
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = sum(r["n_links"] for r in ed.near_duplicates(df).collect())
    assert near.sum() >= 3000 and 0.9 * near.sum() <= links <= near.sum()
