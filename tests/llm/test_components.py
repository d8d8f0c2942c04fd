import random

from srcatlas.llm.components import components


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_against_union_find(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(200, 260)] + [(500, 500 + i) for i in range(1, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    links = [(a, b) for a, b in links if a != b] + [(7, 3), (3, 7), (3, 3)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert dict(map(tuple, components(df).collect())) == brute(links)
    assert components(df.limit(0)).count() == 0
