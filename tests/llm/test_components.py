from __future__ import annotations

import random

from spanveil.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_random_graph_chain_and_star(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    edges += [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 5001 + k) for k in range(500)] + [(7, 7), (1000, 1001)]
    edges = [(a - 2**62, b - 2**62) if a % 2 == b % 2 == 0 else (a, b) for a, b in edges]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
