import random

import pytest

from tidemark.llm.components import connected_components
from tidemark.session import Scratch


def brute(edges):
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u in parent and v in parent and u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    random.seed(7)
    edges = {"random": [(random.randrange(120), random.randrange(120)) for _ in range(90)] + [(None, 1), (5, 5)], "path": [(i, i + 1) for i in range(60)][::-1], "star": [(50, i) for i in range(100)], "empty": []}[kind]
    out = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"))
    assert sorted(map(tuple, out.collect())) == brute(edges)
