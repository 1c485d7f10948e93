"""Connected components and near-hash pairs against brute force."""

import random

import pytest

from specblock.operators.apps import band_masks, near_hash_pairs
from specblock.operators.graph import connected_components
from specblock.session import cut_afresh


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


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle", "loops", "empty"])
def test_components(kind, spark):
    rng = random.Random(5)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(1000, i) for i in range(200)],
        "random": [(rng.randrange(-50, 150), rng.randrange(-50, 150)) for _ in range(120)],
        "cycle": [(i, (i + 1) % 20) for i in range(20)] + [(100, 101), (101, 100)],
        "loops": [(3, 3), (4, 4), (4, 5), (4, 5), (None, 7)],
        "empty": [],
    }[kind]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == brute([e for e in edges if None not in e])


def test_estimates_do_not_grow_with_rounds(spark):
    """Estimated sizes multiply at joins; carried over rounds, their digits would outgrow the work."""
    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    for _ in range(4):
        edges = edges.join(edges.withColumnRenamed("b", "c"), "a").select("a", "b")
    found = connected_components(edges)
    assert found.where("component = 0").count() == 401
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 200


def test_cut_afresh_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.5, None]), (None, None, None)], "k long, s string, v array<double>")
    again = cut_afresh(df.join(df.select("k"), "k", "left"))
    assert again.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("distance", [0, 1, 5, 15])
def test_near_pairs(distance, spark):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(0, 9))) for b in base for _ in range(12)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a, r.b) for r in near_hash_pairs(spark.createDataFrame([(v,) for v in signed], "h long"), distance).collect()}
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance
    assert got == {(a, b) for a in signed for b in signed if a < b and near(a, b)}


def test_bands_cover_all_bits():
    for d in range(16):
        assert sum(band_masks(d)) == (1 << 64) - 1
    with pytest.raises(ValueError):
        near_hash_pairs(None, 16)
