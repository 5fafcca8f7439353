"""Connected components against a union-find, with hubs that are set apart and without."""

import random

import pytest

from studylake.llm import common


def by_union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def graph():
    rng = random.Random(5)
    edges = [(500, i) for i in range(400, 700) if i != 500]  # a hub in the middle of its neighbours
    edges += [(2000, i) for i in range(1000, 1200)]  # the largest node is the hub
    edges += [(i, i + 1) for i in range(3000, 3040)]  # a chain
    edges += [(rng.randrange(4000, 4300), rng.randrange(4000, 4300)) for _ in range(200)]
    edges += [(1100, 650)] + edges[:20]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("hub_rows", [8, 1 << 20])
def test_components_with_hubs(spark, monkeypatch, hub_rows):
    monkeypatch.setattr(common, "HUB_ROWS", hub_rows)
    edges = [e for e in graph() if e[0] != e[1]]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    got = common.connected_components(df, "a", "b", common.Scratch(spark, "components"))
    want = by_union_find(edges)
    assert {r.node: r.root for r in got.collect()} == {n: r for n, r in want.items() if n != r}


def test_least_of_hubs_with_nulls(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_ROWS", 4)
    rows = [(k, v) for k in range(3) for v in (range(10) if k else [])] + [(3, None)] * 9 + [(4, 1), (4, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = common.with_least(df, "k", "v", "m", len(rows), common.Scratch(spark, "least"))
    least = {1: 0, 2: 0, 3: None, 4: 1}
    assert sorted(((r.k, r.v, r.m) for r in got.collect()), key=repr) == sorted(((k, v, least[k]) for k, v in rows), key=repr)


def test_no_edges(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert common.connected_components(df, "a", "b", common.Scratch(spark, "components")).count() == 0
