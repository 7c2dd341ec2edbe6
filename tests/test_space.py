"""Clusters and overlaps of points against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import linkage, spatial

SCHEMA = "id long, x double, y double, z double"


def table(spark, places):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(places)], SCHEMA)


def brute_ward(places, k):
    own = [[i] for i in range(len(places))]
    center = lambda c: [sum(places[i][a] for i in c) / len(c) for a in range(3)]
    cost = lambda c, d: len(c) * len(d) / (len(c) + len(d)) * sum((p - q) ** 2 for p, q in zip(center(c), center(d)))
    costs = {(i, j): cost(own[i], own[j]) for i in range(len(own)) for j in range(i)}
    live = set(range(len(own)))
    while len(live) > k:
        i, j = min(costs, key=costs.get)
        own[j] += own[i]
        live.remove(i)
        costs = {p: v for p, v in costs.items() if i not in p and j not in p}
        costs |= {(max(j, m), min(j, m)): cost(own[j], own[m]) for m in live if m != j}
    return {frozenset(own[i]) for i in live}


def groups(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(v) for v in out.values()}


def places(r, n):
    centers = [[r.uniform(0, 50) for _ in range(3)] for _ in range(6)]
    return [[r.gauss(c, 2) for c in r.choice(centers)] for _ in range(n)]


@pytest.mark.parametrize("small", [1000, 30])
def test_ward(spark, small):
    r = random.Random(5)
    own = places(r, 200) + [[1.0, 2.0, 3.0]] * 7 + [[1.0, 2.0, 3.5]]
    for k in (5, 40) if small == 1000 else (12,):
        found = linkage.ward(table(spark, own), k, small=small, crowd=8)
        assert {x.cluster for x in found.select("cluster").distinct().collect()} == set(range(k))
        assert groups(found) == brute_ward(own, k)


def test_ward_edges(spark):
    odd = [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [None, 1.0, 1.0]]
    assert {r.id: r.cluster for r in spatial.clusters(table(spark, odd), 3, "hierarchical").collect()} == {0: 0, 1: 0, 2: None}
    assert spatial.clusters(table(spark, []), 3, "hierarchical").count() == 0
    with pytest.raises(ValueError):
        spatial.clusters(table(spark, odd), 3, "none")


def test_overlap(spark):
    r = random.Random(6)
    for radius in (3.0, 12.0):
        a, b = places(r, 150) + [[9.0, 9.0, 9.0]] * 5, places(r, 120) + [[9.0, 9.0, 9.0 + radius]]
        near = sum(any(sum((p - q) ** 2 for p, q in zip(x, y)) < radius * radius for y in b) for x in a)
        for compared in (4096, 4):
            x = spatial.overlap(table(spark, a), table(spark, b), radius, compared).first()
            assert (x.n, x.n_near, x.overlap) == (155, near, pytest.approx(near / 155))
    assert tuple(spatial.overlap(table(spark, []), table(spark, []), 1.0).first()) == (0, 0, 0.0)


def test_overlap_of_crowded_cells(spark):
    """All points within one radius, just out of reach of most others: no pair of cells has many places to compare."""
    r = random.Random(7)
    a = [[r.uniform(0, 0.2), r.uniform(0, 0.2), r.uniform(0, 0.2)] for _ in range(1500)]
    b = [[r.uniform(1.0, 1.2), r.uniform(0, 0.2), r.uniform(0, 0.2)] for _ in range(1500)]
    one, two = table(spark, a).select("x", "y", "z"), table(spark, b).select("x", "y", "z")
    near, leaves = spatial.cell_pairs(one, two, 1.0, 256)
    per = []
    for k in [x.level for x in leaves.select("level").distinct().collect()]:
        at = lambda df, c: df.groupBy(spatial._at(k, 1.0 / 1.7320509).alias(c)).count()  # noqa: B023, E731
        own = leaves.filter(F.col("level") == k).join(at(one, "cell").withColumnRenamed("count", "n"), "cell").join(at(two, "other").withColumnRenamed("count", "m"), "other")
        per.append(own.agg(F.max(F.col("n") * F.col("m"))).first()[0])
    assert max(per) <= 256
    want = sum(any(sum((p - q) ** 2 for p, q in zip(x, y)) < 1 for y in b) for x in a)
    assert spatial.overlap(table(spark, a), table(spark, b), 1.0, 256).first().n_near == want


def test_no_side_of_a_round_goes_over_the_driver(spark, monkeypatch):
    """No table of a round, of Ward's linkage or of the components, is broadcast, however small."""
    from quillon.operators import graph

    plans = []

    def seen(plain):
        def keep(df, name):
            plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
            return plain(df, name)

        return keep

    for module in (graph, linkage):
        monkeypatch.setattr(module, "written", seen(module.written))
    own = places(random.Random(5), 120)
    found = linkage.ward(table(spark, own), 12, small=30, crowd=8)
    assert groups(found) == brute_ward(own, 12) and "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    joins = [x for name, x in plans if name in ("best", "merges", "clusters", "up", "left", "components") and "Join" in x]
    # but for the merges that are taken back and the numbers of the last clusters, of at most k rows each
    assert len(joins) > 8 and not [x for x in joins if "Broadcast" in x and "TakeOrdered" not in x and "row_number" not in x]
