"""Distances across flats and the directions that follow from them."""

from collections import deque

import numpy as np
import pytest
from grids import array_of, grid_of
from pyspark.sql import functions as F

from tidemark.operators import flats, graph, grid, terrain
from tidemark.operators.grid import OFFSETS


def by_queue(height, sources):
    """Breadth-first over equal heights."""
    h, w = height.shape
    out = np.full((h, w), -1)
    queue = deque(sources)
    for r, c in sources:
        out[r, c] = 0
    while queue:
        r, c = queue.popleft()
        for dr, dc in OFFSETS:
            y, x = r + dr, c + dc
            if 0 <= y < h and 0 <= x < w and out[y, x] < 0 and height[y, x] == height[r, c]:
                out[y, x] = out[r, c] + 1
                queue.append((y, x))
    return out


def start(spark, height, sources):
    at = set(sources)
    rows = [(r, c, float(v), 0 if (r, c) in at else None) for r, line in enumerate(height) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, height double, distance int")


@pytest.mark.parametrize("tile", [5, 1024])
def test_distances_equal_breadth_first_search(spark, tile):
    rng = np.random.default_rng(4)
    height = (rng.random((31, 28)) < 0.35).astype(float)
    sources = [(int(r), int(c)) for r, c in zip(rng.integers(0, 31, 5), rng.integers(0, 28, 5))]
    got = np.array(array_of(flats.flat_distances(start(spark, height, sources), tile), "distance", None), float)
    want = by_queue(height, sources)
    np.testing.assert_array_equal(np.nan_to_num(got, nan=-1), want)
    assert want.max() > 10 and (want < 0).any()


def test_a_way_may_leave_a_tile_and_come_back(spark):
    # a wall with one gap far off: the shortest way winds through three tiles
    height = np.zeros((12, 12))
    height[5, :11] = 1
    got = array_of(flats.flat_distances(start(spark, height, [(0, 0)]), 4), "distance", None)
    assert [[-1 if v is None else v for v in line] for line in got] == by_queue(height, [(0, 0)]).tolist()
    assert got[11][0] == 22


def test_rounds_follow_tiles_not_cells(spark, monkeypatch):
    rounds = []
    spread = flats._spread_tiles
    monkeypatch.setattr(flats, "_spread_tiles", lambda *a: rounds.append(1) or spread(*a))
    n = 96
    cells = spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), F.lit(1.0).alias("height"), F.when(F.col("id") == 0, 0).alias("distance"))
    assert flats.flat_distances(cells, 32).agg(F.sum("distance")).first()[0] == sum(max(r, c) for r in range(n) for c in range(n))
    assert len(rounds) <= 4


def test_directions_of_a_wide_flat_match_rings(spark):
    rng = np.random.default_rng(9)
    z = np.round(rng.random((24, 26)) * 2) + 3
    z[8:20, 6:22] = 1
    z[13, 14] = 0
    cells = grid_of(spark, z.tolist())
    small = array_of(terrain.conditioned_directions(cells, tile=6), "d8")
    assert small == array_of(terrain.conditioned_directions(cells), "d8")
    ends = graph.terminals(graph.flow_edges(terrain.conditioned_directions(cells, tile=6)))
    _, r, c = grid.id_parts(F.col("terminal"))
    assert all(x.r in (0, 23) or x.c in (0, 25) for x in ends.select(r.alias("r"), c.alias("c")).collect())


def test_several_grids_do_not_touch(spark):
    cells = start(spark, np.zeros((3, 7)), [(0, 0)]).withColumn("grid", F.lit(1))
    both = cells.unionByName(cells.withColumn("grid", F.lit(2)).withColumn("distance", F.lit(None).cast("int")))
    got = {(x.grid, x.row, x.col): x.distance for x in flats.flat_distances(both, 4).collect()}
    assert got[1, 2, 6] == 6 and got[2, 0, 0] is None
