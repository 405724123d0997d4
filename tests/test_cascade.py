"""Hypsometric levels and the spill cascade against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cascade, hypsometry, ponding


def water_level(beds, area, supply):
    """Bisects the level at which the beds hold the supply."""
    if supply <= 0:
        return min(beds)
    low, high = min(beds), max(beds) + supply / area
    for _ in range(200):
        mid = (low + high) / 2
        if area * sum(max(0.0, mid - b) for b in beds) < supply:
            low = mid
        else:
            high = mid
    return high


def test_levels_equal_bisection(spark):
    rng = random.Random(2)
    beds = {d: [round(rng.random() * 5, 1) for _ in range(rng.choice([1, 2, 40, 200]))] for d in range(12)}
    asked = [(d, k, s) for d in beds for k, s in enumerate([-1.0, 0.0, 0.5, 3.0, 40.0, 900.0, 50_000.0])]
    table = spark.createDataFrame([(d, float(z)) for d, zs in beds.items() for z in zs] + [(3, None)], "dep long, z double")
    curve = hypsometry.curves(table, 9.0)
    got = {(r.dep, r.k): r.level for r in hypsometry.levels_of(curve, spark.createDataFrame(asked, "dep long, k int, supply double"), 9.0).collect()}
    assert len(got) == len(asked)
    for d, k, s in asked:
        assert got[d, k] == pytest.approx(water_level(beds[d], 9.0, s), abs=1e-6)


def test_a_large_depression_lies_in_many_ranges(spark):
    n = 200_000
    beds = spark.range(n).select(F.lit(7).cast("long").alias("dep"), (F.col("id") / 1000).alias("z"))
    curve = hypsometry.curves(beds, 1.0)
    assert curve.select("part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    z = np.arange(n) / 1000
    for k in (1, 77_777, n - 1):
        supply = float((z[k] - z[:k]).sum())
        got = hypsometry.levels_of(curve, spark.createDataFrame([(7, supply)], "dep long, supply double"), 1.0).collect()
        assert len(got) == 1 and got[0].level == pytest.approx(z[k], rel=1e-9)


def test_no_depressions(spark):
    none = spark.createDataFrame([], "dep long, z double")
    assert hypsometry.curves(none, 1.0).count() == 0


def by_order(capacity, to, water):
    """Nodes in topological order, then those of cycles by number; what reaches a settled node is lost."""
    water, above = dict(water), dict.fromkeys(capacity, 0)
    for t in to.values():
        if t in above:
            above[t] += 1
    ready, order = [d for d in sorted(capacity) if not above[d]], []
    while ready:
        d = ready.pop()
        order.append(d)
        if to.get(d) in above:
            above[to[d]] -= 1
            if not above[to[d]]:
                ready.append(to[d])
    done = set()
    for d in order + sorted(set(capacity) - set(order)):
        done.add(d)
        if to.get(d) in capacity and to[d] not in done:
            water[to[d]] += max(0.0, water[d] - capacity[d])
    return water


def cascaded(spark, capacity, to, water):
    deps = spark.createDataFrame([(d, c) for d, c in capacity.items()], "dep long, capacity_m3 double")
    spill = spark.createDataFrame([(d, to.get(d)) for d in capacity], "dep long, spill_to long")
    supply = spark.createDataFrame([(d, rp, w * rp) for d, w in water.items() for rp in (1, 3)], "dep long, rp int, supply double")
    return {(r.dep, r.rp): (r.inflow, r.full) for r in ponding.cascade(deps, spill, supply, "rp").collect()}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "caterpillar", "cycles"])
def test_cascade_equals_topological_order(spark, kind):
    rng = random.Random(kind)
    n = 60
    to = {
        "random": {d: rng.randrange(d) if d else None for d in range(n)},
        "chain": {d: d + 1 for d in range(n - 1)},
        "star": {d: 0 for d in range(1, n)},
        "caterpillar": {d: d - 2 if d % 2 == 0 else d - 1 for d in range(2, n)},
        "cycles": {d: rng.randrange(n) for d in range(n)} | {5: 5, 6: 10**9, 7: None, 8: 9, 9: 8},
    }[kind]
    capacity = {d: float(rng.choice([0, 1, 5, 50])) for d in range(n)}
    water = {d: float(rng.randrange(20)) for d in range(n) if d % 7}
    got = cascaded(spark, capacity, to, water)
    for rp in (1, 3):
        want = by_order(capacity, {d: t for d, t in to.items() if t != d}, {d: water.get(d, 0.0) * rp for d in capacity})
        for d in capacity:
            assert got[d, rp][0] == pytest.approx(want[d]) and got[d, rp][1] == (want[d] >= capacity[d] or got[d, rp][0] >= capacity[d])


def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch):
    rounds = []
    kept = cascade.cut_round
    monkeypatch.setattr(cascade, "cut_round", lambda df: rounds.append(1) or kept(df))
    n = 5000
    nodes = spark.range(n).select(F.col("id").alias("dep"), F.lit(1.0).alias("capacity"), F.when(F.col("id") == 0, float(2 * n)).otherwise(0.0).alias("water"))
    links = spark.range(n - 1).select(F.col("id").alias("dep"), (F.col("id") + 1).alias("parent"))
    got = cascade.settled(nodes, links, [])
    assert got.where((F.col("inflow") - (2 * n - F.col("dep"))).between(-1e-6, 1e-6)).count() == n
    assert len(rounds) <= 18


def test_nodes_on_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 7), (8, 9), (9, 8)], "a long, b long")
    assert {r.node for r in cascade.on_cycles(links).collect()} == {1, 2, 3, 8, 9}
    assert cascade.on_cycles(links.limit(0)).collect() == []
