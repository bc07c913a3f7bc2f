"""Components of chains, stars and random graphs against union-find."""

import random

from tomefold.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(6)
    ids = list(range(-50, 150))
    rng.shuffle(ids)
    chain = [(ids[i], ids[i + 1]) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)] + [(3000 - i, 3000) for i in range(1, 30)]
    loose = [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)] + [(7, 7), (9000, 9000)]
    edges = chain + star + loose + chain[:5]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
