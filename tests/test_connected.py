"""Both ways of joining links and of filling basins give the same, on grids and chains that take many rounds."""

import heapq
import math
import random

import pytest

from tidemark.operators import components, scoring, terrain
from tidemark.operators.graph import lower_envelope


@pytest.mark.parametrize("small", [0, 20_000])
def test_spill_levels_equal_flooding(spark, monkeypatch, small):
    monkeypatch.setattr(terrain, "SMALL", small)
    rng = random.Random(3)
    ways = {}
    for i in range(60):  # a long chain with side ways, to the outside at one end and by a high pass at the other
        ways[i, i + 1 if i < 59 else -1] = rng.choice([1.0, 2.0, 3.0, 5.0])
        if i % 7 == 0 and i:
            ways[i, rng.randrange(i)] = rng.choice([1.0, 4.0])
    ways[0, -1] = 9.0
    rows = [(a, b, h) for (a, b), h in ways.items()] + [(b, a, h) for (a, b), h in ways.items() if b != -1]
    least = {}
    for a, b, h in rows:
        least[a, b] = min(h, least.get((a, b), h))
    level, waiting = {}, [(float("-inf"), -1)]
    while waiting:
        h, x = heapq.heappop(waiting)
        if x not in level:
            level[x] = h
            for (a, b), p in least.items():
                if b == x and a not in level:
                    heapq.heappush(waiting, (max(h, p), a))
    table = spark.createDataFrame([(a, b, h) for (a, b), h in least.items()] + [(100, 101, 1.0), (101, 100, 1.0)], "basin long, other long, height double")
    got = {r.basin: r.level for r in terrain.spill_levels(table).collect()}
    assert got == {**{b: h for b, h in level.items() if b != -1}, 100: None, 101: None}


@pytest.mark.parametrize("small", [0, 20_000])
def test_components_either_way(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    links = [(i, i + 1) for i in range(25)] + [(100, 100 + i) for i in range(1, 12)] + [(7, 7), (None, 3), (3, 1)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(26)}, **{i: 100 for i in range(100, 112)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lower_envelope_equals_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        column = rng.permutation(80)[:n]
        near = np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 30, n))
        want = np.array([min([(c - d) ** 2 + f * f for d, f in zip(column, near) if f == f], default=np.nan) for c in column])
        assert np.allclose(lower_envelope(column, near), want, equal_nan=True)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    stations = [(i, rng.gauss(0, 1) if i % 2 else rng.uniform(-50, 50), rng.gauss(0, 1)) for i in range(40)] + [(99, 0.5, 0.5), (98, 0.5, 0.5), (97, None, 1.0)]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-5, 5)) for i in range(60)] + [(100, 0.5, 0.5), (101, None, 0.0), (102, 1000.0, 0.0)]
    got = {r.label: (r.station_id, r.distance) for r in scoring.nearest(spark.createDataFrame(points, "label long, x double, y double"), spark.createDataFrame(stations, "station_id long, x double, y double"), "x", "y").collect()}
    for label, x, y in points:
        if x is None:
            assert got[label] == (None, None)
            continue
        d, s = min(((x - a) ** 2 + (y - b) ** 2, s) for s, a, b in stations if a is not None)
        assert got[label][0] == s and got[label][1] == pytest.approx(d**0.5)
    assert scoring.nearest(spark.createDataFrame(points[:2], "label long, x double, y double"), spark.createDataFrame([], "station_id long, x double, y double"), "x", "y").where("station_id is null").count() == 2


def test_nearest_where_stations_crowd(spark):
    rng = random.Random(12)
    town = [(k, 500 + rng.random() * 0.01, 500 + rng.random() * 0.01) for k in range(400)]
    stations = town + [(1000 + k, rng.random() * 1000, rng.random() * 1000) for k in range(60)] + [(2000, *town[0][1:])]
    points = [(k, 500 + rng.random() * 0.02, 500 + rng.random() * 0.02) for k in range(40)] + [(100 + k, rng.random() * 3000 - 1000, rng.random() * 3000 - 1000) for k in range(60)]
    points += [(300, 450.0, 450.0), (301, 450.0, 450.0), (302, None, 1.0)]
    got = {r.label: (r.station_id, r.distance) for r in scoring.nearest(spark.createDataFrame(points, "label long, x double, y double"), spark.createDataFrame(stations, "station_id long, x double, y double"), "x", "y").collect()}
    for label, x, y in points[:-1]:
        d, k = min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), k) for k, a, b in stations)
        assert got[label][0] == k and math.isclose(got[label][1], d, abs_tol=1e-12)
    assert got[302] == (None, None) and len(got) == len(points)
    one = scoring.nearest(spark.createDataFrame(points[:3], "label long, x double, y double"), spark.createDataFrame([(7, 1.0, 1.0)], "station_id long, x double, y double"), "x", "y")
    assert {r.station_id for r in one.collect()} == {7}
