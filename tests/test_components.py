import random

import pytest

from lexloom.plans.components import components


@pytest.mark.parametrize("local", [10**6, 40])
def test_components(spark, local):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(80)] + [(r.randint(2000, 2300), r.randint(2000, 2300)) for _ in range(120)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long").repartition(6), local).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in parent}
