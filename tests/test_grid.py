import numpy as np
import pytest
from grids import array_of, grid_of
from pyspark.sql import functions as F

from tidemark.operators import graph, grid, ponding, terrain, zonal

EDGE = lambda h, w: (F.col("row") == 0) | (F.col("row") == h - 1) | (F.col("col") == 0) | (F.col("col") == w - 1)


def test_d8_ramp_and_pit(spark):
    ramp = array_of(graph.d8(grid_of(spark, [[3, 2, 1]] * 3)), "d8")
    assert ramp[1] == [4, 4, -1]
    assert array_of(graph.d8(grid_of(spark, [[5, 5, 5], [5, 1, 5], [5, 5, None]])), "d8", None)[1][1] == -1


def test_labels_across_tiles_equal_those_within_one(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((40, 37)) < 0.45
    g = grid_of(spark, [[1.0 if x else None for x in row] for row in mask])
    small = {(r["row"], r["col"]): r["label"] for r in graph.label_components(g, F.col("z").isNotNull(), 8, tile=8).collect()}
    large = {(r["row"], r["col"]): r["label"] for r in graph.label_components(g.repartition(7), F.col("z").isNotNull(), 8, tile=64).collect()}
    assert small == large and len(set(small.values())) > 3


def test_serpentine_is_one_component(spark):
    n = 32
    z = [[1.0 if r % 2 == 0 or c == (n - 1 if r % 4 == 1 else 0) else None for c in range(n)] for r in range(n)]
    labels = graph.label_components(grid_of(spark, z), F.col("z").isNotNull(), 4, tile=8).select("label").distinct().count()
    assert labels == 1


def test_basin_needs_a_seed(spark):
    z = [[-1.0 if 7 <= r <= 12 and 7 <= c <= 12 else 5.0 for c in range(20)] for r in range(20)]
    g = grid_of(spark, z)
    count = lambda **k: graph.sea_mask(g, EDGE(20, 20), **k).where("sea").count()
    assert count() == 0
    assert count(extra_seed=(F.col("row") == 9) & (F.col("col") == 9)) == 36
    assert count(extra_seed=(F.col("row") == 0) & (F.col("col") == 0)) == 0
    assert count(lake_seeds=[((F.col("row") == 9) & (F.col("col") == 9), 1.0)]) == 36


def test_denoise_keeps_pools_and_nulls(spark):
    z = [[0.4 if (5 <= r <= 9 and 5 <= c <= 9) or (r, c) == (20, 20) else 0.0 for c in range(30)] for r in range(30)]
    z[29][29] = None
    out = array_of(graph.denoised(grid_of(spark, z).withColumnRenamed("z", "depth")), "depth")
    assert sum(x == 0.4 for row in out for x in row) == 25 and out[20][20] == 0 and out[29][29] is None


def test_distance_to_outlets(spark):
    g = grid_of(spark, [[0.0] * 10] * 5)
    d = array_of(graph.outlet_distance(g, F.col("col") == 0), "distance")
    flat = [x for row in d for x in row]
    assert np.median(flat) == 4.5 and max(flat) == 9


def priority_flood(z):
    import heapq

    h, w = z.shape
    out = np.full_like(z, np.nan)
    heap, seen = [], np.isnan(z)
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    for r in range(h):
        for c in range(w):
            if not seen[r, c] and any(not (0 <= r + a < h and 0 <= c + b < w) or np.isnan(z[r + a, c + b]) for a, b in near):
                heapq.heappush(heap, (z[r, c], r, c))
    done = seen.copy()
    while heap:
        v, r, c = heapq.heappop(heap)
        if done[r, c]:
            continue
        done[r, c], out[r, c] = True, v
        for a, b in near:
            y, x = r + a, c + b
            if 0 <= y < h and 0 <= x < w and not done[y, x]:
                heapq.heappush(heap, (max(v, z[y, x]), y, x))
    return out


def test_filled_surface_equals_priority_flood(spark):
    rng = np.random.default_rng(5)
    z = np.round(rng.random((14, 15)) * 5, 1)
    z[6, 6] = np.nan
    g = grid_of(spark, [[None if np.isnan(x) else x for x in row] for row in z])
    got = np.array(array_of(terrain.filled_surface(g), "filled"), float)
    np.testing.assert_allclose(got, priority_flood(z))


def test_flats_drain_outwards(spark):
    z = [[2.0] * 6 for _ in range(6)]
    flow = terrain.conditioned_directions(grid_of(spark, z))
    ends = graph.terminals(graph.flow_edges(flow))
    _, r, c = grid.id_parts(F.col("terminal"))
    assert all(x.r in (0, 5) or x.c in (0, 5) for x in ends.select(r.alias("r"), c.alias("c")).collect())


def test_depit_modes(spark):
    z = [[10.0] * 20 for _ in range(20)]
    z[5][5], z[5][15], z[15][5], z[15][15] = -5.0, 5.0, 9.0, 9.7
    g = grid_of(spark, z)
    noise, rain = array_of(terrain.depitted(g), "z"), array_of(terrain.depitted(g, deep=3.0), "z")
    at = lambda a: (a[5][5], a[5][15], a[15][5], a[15][15])
    assert at(noise) == (-5, 5, 9, 10) and at(rain) == (10, 10, 9, 10)


def test_inventory_supply_levels_and_cascade(spark):
    z = [[10.0] * 5 for _ in range(5)]
    z[1][1], z[3][3] = 6.0, 9.8
    surface = grid_of(spark, z).withColumn("filled", F.lit(10.0))
    _, deps = ponding.inventory(surface, 900.0, 0.5, 100.0, 1)
    row = deps.first()
    assert deps.count() == 1 and row.pour_elev == 10 and row.capacity_m3 == 4 * 900
    beds = F.array(*[F.lit(float(x)) for x in (0, 1, 2, 3)])
    got = spark.range(1).select(*[ponding.fill_level(beds, F.lit(4.0), 1.0, F.lit(float(s))).alias(str(s)) for s in (0, 1, 6, 100)]).first()
    assert tuple(got) == (0, 1, 3, 4)
    deps = spark.createDataFrame([(1, 5.0, 5.0, [0.0]), (2, 100.0, 100.0, [0.0])], "dep long, pour_elev double, capacity_m3 double, beds array<double>")
    spill = spark.createDataFrame([(1, 2), (2, None)], "dep long, spill_to long")
    supply = spark.createDataFrame([(1, 30.0), (2, 0.0)], "dep long, supply double")
    level = {r.dep: r.level for r in ponding.levels(deps, ponding.cascade(deps, spill, supply), 1.0).collect()}
    assert level == {1: 5.0, 2: 25.0}


def test_trough_supply(spark):
    g = grid_of(spark, [[5, 4, 0]] * 3).withColumn("runoff", F.lit(2.0))
    pits = grid.with_id(g.where("col = 2"), "dep").select("row", "col", F.lit(7).cast("long").alias("dep"))
    assert ponding.catchment_supply(g, graph.d8(g), pits, F.col("runoff")).first().supply == 18


def test_spill_graph_stops_at_rivers(spark):
    flow = spark.createDataFrame([(r, c, 4 if r == 1 and 1 <= c <= 6 else -1) for r in range(3) for c in range(8)], "row int, col int, d8 int")
    inside = spark.createDataFrame([(1, 1, 1), (1, 5, 2)], "row int, col int, dep long")
    ids = {r.dep: r.cell for r in grid.with_id(inside).collect()}
    cells = inside.replace(ids, subset=["dep"]) if False else grid.with_id(inside, "d").select("row", "col", F.col("d").alias("dep"))
    deps = cells.select("dep")
    none = spark.createDataFrame([], "row int, col int")
    got = {r.dep: r.spill_to for r in ponding.spill_graph(deps, cells, flow, none).collect()}
    assert got == {ids[1]: ids[2], ids[2]: None}
    river = spark.createDataFrame([(1, 3)], "row int, col int")
    assert {r.dep: r.spill_to for r in ponding.spill_graph(deps, cells, flow, river).collect()}[ids[1]] is None


def test_tiles_round_trip(spark):
    g = grid_of(spark, [[r * 10 + c if (r + c) % 3 else None for c in range(7)] for r in range(5)])
    back = grid.from_tiles(grid.to_tiles(g.where("z is not null"), "z", 4), "z", 4)
    assert sorted(map(tuple, back.collect())) == sorted(tuple(x) for x in g.where("z is not null").collect())


def test_quantile_flag_limits(spark):
    g = grid_of(spark, [[1, 2, 3, None]])
    assert zonal.quantile_flag(g, "z", 0.0, 0.5).where("depth > 0").count() == 0
    assert zonal.quantile_flag(g, "z", 0.5, 0.5).where("depth > 0").count() == 2
    with pytest.raises(ValueError):
        zonal.quantile_flag(g, "z", 1.5, 0.5)


def test_otsu_and_change(spark):
    v = spark.createDataFrame([(x,) for x in [1.0, 1.2, 1.1, 5.0, 5.2, 5.1]], "v double")
    assert 1.2 < zonal.otsu_threshold(v, "v", 0.0, 6.0, 60).first().threshold < 5.0
    s = spark.createDataFrame([(0, 0, "A", False, -8.0), (0, 0, "A", True, -15.0), (0, 1, "A", False, -8.0), (0, 1, "A", True, -8.5)], "row int, col int, orbit string, event boolean, backscatter double")
    assert [r.flood for r in zonal.median_change(s, -3.0).orderBy("col").collect()] == [True, False]
