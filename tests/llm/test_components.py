"""Connected components against union-find on random graphs, chains and stars."""

import random

import pytest

from loomspark.llm import cluster


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = {0: [(i, i + 1) for i in range(40)] + [(100, 7), (300, 301), (5, 5)], 1: [(r.randrange(60), r.randrange(60)) for _ in range(45)], 2: [(0, i) for i in range(1, 30)] + [(29, i) for i in range(50, 60)]}[seed]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.id: x.component for x in cluster.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_no_links(spark):
    assert cluster.components(spark.createDataFrame([], "a long, b long")).count() == 0
