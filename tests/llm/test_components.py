import random

import pytest

from casehours.llm import components


@pytest.mark.parametrize("few", [components.BROADCAST_EDGES, 0])
def test_components_against_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(components, "BROADCAST_EDGES", few)
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 180)]
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + chain + [(500, 500 + k) for k in range(1, 40)] + [(7, 7)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
