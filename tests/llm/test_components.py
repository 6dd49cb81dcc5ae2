import random

from pactlake.llm.components import components


def test_equals_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(4000, 4050)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"))[0].count() == 0
