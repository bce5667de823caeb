import numpy as np
import pytest

import lexloom.llm.nearest as nn


def data(spark, n=400, dim=24, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = (centres[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, dim))).astype(np.float32)
    x[50:80] = x[3]
    x[90] = 2 * x[4]
    rows = [(i, x[i].tolist(), "v") for i in range(n)] + [(1000, None, "v"), (1001, [0.0] * dim, "v"), (1002, [1.0], "v"), (1003, [float("nan")] * dim, "v"), (1004, [None] * dim, "v"), (None, x[0].tolist(), "v")]
    rows += rows[:5]
    return x, spark.createDataFrame(rows, "id long, e array<float>, similarity string").repartition(3)


def brute(x, k):
    u = nn.directions(x)
    s = np.round(u @ u.T, 7)
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:k]
        out[i] = [(j, s[i, j]) for j in order]
    return out


@pytest.mark.parametrize("block", [20000, 90])
def test_exact_with_few_lists(spark, block, monkeypatch):
    monkeypatch.setattr(nn, "HEAVY", 20)
    x, df = data(spark)
    want = brute(x, 5)
    got = {}
    for r in nn.nearest(df, "id", "e", 5, list_rows=400, block_rows=block).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.similarity))
    assert set(got) == set(want)
    for i, found in got.items():
        found.sort(key=lambda p: (-p[1], p[0]))
        assert [j for j, _ in found] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in found], [s for _, s in want[i]], atol=1e-6)


def test_recall(spark):
    x, df = data(spark, 3000, 32, 5)
    want = brute(x, 5)
    got = {(r.id, r.neighbour) for r in nn.nearest(df, "id", "e", 5, list_rows=150).collect()}
    hits = [len([j for j, _ in want[i] if (i, j) in got]) / 5 for i in range(0, 3000, 50)]
    assert np.mean(hits) >= 0.9


def test_empty(spark):
    assert nn.nearest(spark.createDataFrame([], "id long, e array<float>"), "id", "e").collect() == []
    assert nn.nearest(spark.createDataFrame([(1, [0.0, 0.0])], "id long, e array<float>"), "id", "e").collect() == []


def test_planes_round_trip():
    x = np.random.default_rng(1).normal(size=(7, 13)).astype(np.float32)
    assert (nn.from_planes(nn.planes(x)) == x).all()


def test_sample_is_bounded_and_stable(spark):
    src = spark.range(3_000).selectExpr("id", "array(1.0f, 2.0f) AS vec").unionByName(spark.range(1_000).selectExpr("id", "array(1.0f, 2.0f) AS vec"))
    members = src.select("id")
    one, two = ({r.id for r in nn._sample(src.repartition(n), members, 3_000, 500).collect()} for n in (3, 7))
    assert one == two and 400 < len(one) <= 500
    assert nn._sample(src, members, 3_000, 5_000).count() == 3_000
