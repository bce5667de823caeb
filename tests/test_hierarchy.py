import random

import pytest

from lexloom.operators.hierarchy import hierarchy


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is None:
            continue
        if i not in parent or (p is not None and (parent[i] is None or p < parent[i])):
            parent[i] = p
    out = {}
    for i in parent:
        path, at = [i], i
        while True:
            up = parent[at]
            if up is None or up not in parent:
                out[i] = (at, len(path) - 1, path[::-1])
                break
            if up in path:
                out[i] = (min(path[path.index(up) :]), -1, None)
                break
            path.append(up)
            at = up
    return out


def random_rows(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(1, n):
        kind = r.random()
        p = None if kind < 0.05 else r.randint(n, 2 * n) if kind < 0.08 else r.randint(1, n) if kind < 0.25 else max(1, i - 1) if kind < 0.8 else 7
        rows.append((i * 13 % 4001, None if p is None else p * 13 % 4001))
    return rows + rows[:20] + [(None, 5)]


@pytest.mark.parametrize("seed,block,local", [(1, 1000, 1000), (2, 60, 1000), (3, 40, 30), (4, 25, 10), (5, 40, 5)])
def test_matches_brute_force(spark, seed, block, local):
    rows = random_rows(seed)
    df = spark.createDataFrame([(i, p, "x") for i, p in rows], "id long, parent_id long, node string")
    got = {r.node: (r.root, r.depth, r.path) for r in hierarchy(df, with_path=True, block_rows=block, local_rows=local).collect()}
    assert got == brute(rows)


def test_long_chain_and_big_cycle(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    cycle = [(1000 + i, 1000 + (i * 7 + 1) % 101) for i in range(101)]
    rows = chain + cycle + [(5000, 5000), (5001, 5000)]
    df = spark.createDataFrame(rows, "id long, parent_id long")
    got = {r.node: (r.root, r.depth) for r in hierarchy(df, block_rows=30, local_rows=20).collect()}
    assert got == {k: v[:2] for k, v in brute(rows).items()}


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "id long, parent_id long")
    assert hierarchy(empty).collect() == []
    nulls = spark.createDataFrame([(None, None), (1, None)], "id long, parent_id long")
    assert [(r.node, r.root, r.depth) for r in hierarchy(nulls).collect()] == [(1, 1, 0)]


def test_one_parent_of_most_rows(spark, monkeypatch):
    """Children of one node in other blocks meet it in several tasks."""
    from lexloom.plans import runtime

    monkeypatch.setattr(runtime.unique_join, "__defaults__", ("inner", 50))
    n = 2_000
    rows = [(1, None)] + [(i, 1) for i in range(2, n)] + [(n + i, i + 2) for i in range(300)]
    got = {r.node: (r.root, r.depth) for r in hierarchy(spark.createDataFrame(rows, "id long, parent_id long"), block_rows=150, local_rows=50).collect()}
    assert got == {1: (1, 0)} | {i: (1, 1) for i in range(2, n)} | {n + i: (1, 2) for i in range(300)}
