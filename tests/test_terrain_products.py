"""Lines, void fill, raster files, reprojection, controls and bootstrap curves against plain Python."""

import math
import random

import numpy as np
import pytest
from grids import array_of, grid_of
from pyspark.sql import functions as F

from tidemark.functions.geo import from_utm, to_utm
from tidemark.operators import controls, grid, lines, reproject, resampling, scoring, solver
from tidemark.sources import rasters

SEGMENTS = "k int, x1 double, y1 double, x2 double, y2 double"


def by_steps(x1, y1, x2, y2):
    """Cells under many points of a segment."""
    return {(math.floor(y1 + t * (y2 - y1)), math.floor(x1 + t * (x2 - x1))) for t in (i / 200_000 for i in range(1, 200_000))}


def test_touched_cells(spark):
    rng = random.Random(7)
    made = [(k, *[round(rng.random() * 9, 2) for _ in range(4)]) for k in range(12)] + [(20, 1.5, 2.0, 4.5, 2.0), (21, 3.2, 3.2, 3.2, 3.2), (22, 0.0, 0.0, 3.0, 3.0), (23, 5.5, 4.0, 5.5, 1.5)]
    got = {}
    for r in lines.touched(spark.createDataFrame(made, SEGMENTS)).collect():
        got.setdefault(r.k, set()).add((r.row, r.col))
    for k, *ends in made:
        want = by_steps(*ends)
        # a corner cut by less than a step may be missing from the points
        assert want <= got[k] and len(got[k] - want) <= 1, (k, got[k] ^ want)
    assert got[22] == {(0, 0), (1, 1), (2, 2)} and got[21] == {(3, 3)}


def test_long_line_makes_rows_in_proportion(spark):
    assert lines.touched(spark.createDataFrame([(1, 0.5, 0.25, 40_000.5, 30_000.3)], SEGMENTS)).count() == 70_001


def test_widened_lines_touch_squares(spark):
    g = grid_of(spark, [[0] * 9] * 9)
    segment = spark.createDataFrame([(1, 2.5, 4.5, 6.5, 4.5)], SEGMENTS)
    got = {(r.row, r.col) for r in lines.touched_within(g, segment, 0.5).collect()}
    # the widened line ends on the borders of the rows beside it, and of the columns beyond its ends
    assert got == {(r, c) for r in (3, 4, 5) for c in range(2, 7)} | {(4, 1), (4, 7)}


def test_culverts_and_fallback(spark):
    rows = [(1, "Culvert", None, None), (2, None, "yes", None), (3, None, None, "-2"), (4, "no", "no", "1"), (5, None, None, "a;b")]
    ways = spark.createDataFrame([(k, 0.5, 0.5, 3.5, 0.5, *tags) for k, *tags in rows], SEGMENTS + ", tunnel string, covered string, layer string")
    assert sorted(r.k for r in lines.open_lines(ways).collect()) == [4, 5]
    g = grid_of(spark, [[5, 4, 3, 2], [5, 4, 1, 1], [5, 4, 3, 2]])
    none = lines.drainage_network(g, ways.where("k < 4"), 0.0, 4, "lines").where("drain")
    assert none.count() == lines.drainage_network(g, None, 0.0, 4).where("drain").count() > 0
    assert lines.drainage_network(g, ways, 0.0, 4, "lines").where("drain").count() == 4
    with pytest.raises(ValueError):
        lines.drainage_network(g, ways, 0.0, 4, "else")


def test_void_fill_searches_eight_ways(spark):
    rng = np.random.default_rng(6)
    z = np.round(rng.random((15, 17)) * 9, 1)
    z[4:11, 5:13] = np.nan
    z[0, 0] = np.nan
    g = grid_of(spark, [[None if np.isnan(x) else x for x in row] for row in z])
    got = np.array(array_of(grid.void_filled(g, "z", F.lit(False), radius=4), "z"), float)
    for r in range(15):
        for c in range(17):
            if not np.isnan(z[r, c]):
                assert got[r, c] == z[r, c]
                continue
            top = low = 0.0
            for dr, dc in grid.OFFSETS:
                for k in range(1, 5):
                    y, x, apart = r + k * dr, c + k * dc, k * math.hypot(dr, dc)
                    if apart <= 4 and 0 <= y < 15 and 0 <= x < 17 and not np.isnan(z[y, x]):
                        top, low = top + z[y, x] / apart, low + 1 / apart
                        break
            assert np.isnan(got[r, c]) if not low else got[r, c] == pytest.approx(top / low)


def test_raster_round_trip_and_pruned_window(spark, tmp_path):
    z = [[r * 10 + c + 0.5 if (r * c) % 7 else None for c in range(19)] for r in range(11)]
    path, at = str(tmp_path / "r"), rasters.Geometry(32648, 1000.0, 9000.0, 30.0)
    rasters.write_raster(grid_of(spark, z), path, "z", at, tile=4)
    got = {(r.row, r.col): r.z for r in rasters.read_raster(spark, path).collect()}
    assert got == {(r, c): v for r, row in enumerate(z) for c, v in enumerate(row) if v is not None}
    window = rasters.read_raster(spark, path, rows=(3, 5), columns=(6, 9))
    assert {(r.row, r.col) for r in window.collect()} == {k for k in got if 3 <= k[0] <= 5 and 6 <= k[1] <= 9}
    assert "PartitionFilters: [isnotnull(tile_r" in window._jdf.queryExecution().executedPlan().toString()
    found = rasters.read_geometry(spark, path, 32648)
    assert rasters.misaligned(found, spark.createDataFrame([(32648, 30.0, 1000.0, -30.0, 9000.0, 20, 12)], "epsg int, a double, c double, e double, f double, width int, height int")).collect() == []
    grid.aligned(found, found)
    with pytest.raises(ValueError, match="c, width"):
        grid.aligned(found, found.withColumns({"c": F.lit(0.0), "width": F.lit(1)}))


def test_cell_numbers_out_of_range_are_errors(spark):
    with pytest.raises(Exception, match="2\\*\\*24"):
        grid.with_id(spark.createDataFrame([(1 << 24, 0)], "row int, col int")).collect()


def test_reprojection_follows_the_projection(spark):
    # a plane in longitude and latitude is the same plane in either zone
    def plane(at, n):
        cells = spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
        lon, lat = from_utm(F.lit(at.west) + (F.col("col") + 0.5) * at.size, F.lit(at.north) - (F.col("row") + 0.5) * at.size, at.epsg)
        return cells.select("row", "col", ((lon - 101.9) * 100 + (lat - 3.0) * 10).alias("depth"))

    x, y = to_utm(F.lit(102.0), F.lit(3.07), 32648)
    origin = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    here, there = rasters.Geometry(32647, 833_000.0, 340_000.0, 30.0), rasters.Geometry(32648, round(origin.x) - 1500.0, round(origin.y) + 1500.0, 25.0)
    want = plane(here, 12).withColumnRenamed("depth", "want")
    got = reproject.reprojected(plane(there, 120), there, want.select("row", "col"), here).join(want, ["row", "col"]).collect()
    assert len(got) == 144 and all(abs(r.depth - r.want) < 1e-6 for r in got)
    assert reproject.reprojected(plane(there, 2), there, want.select("row", "col"), here).where("depth is not null").count() == 0


def test_controls_equal_greedy_choice(spark):
    rng = random.Random(11)
    cells = [(r, c, c * 30.0, r * 30.0, rng.choice([5.0, 8.0, 12.0, 30.0]), rng.random() < 0.1) for r in range(40) for c in range(40)]
    floods = [(rng.random() * 1200, rng.random() * 1200) for _ in range(5)]
    table = spark.createDataFrame(cells, "row int, col int, x double, y double, hand double, channel boolean")
    got = controls.dry_controls(table, spark.createDataFrame(floods, "x double, y double"), apart_m=100.0, between_m=200.0, stride=2, n=30).orderBy("rank").collect()
    able = [(min(math.hypot(x - a, y - b) for a, b in floods), r, c, x, y) for r, c, x, y, h, ch in cells if r % 2 == c % 2 == 0 and 6.5 <= h <= 20 and not ch]
    chosen = []
    for d, r, c, x, y in sorted((a for a in able if a[0] >= 100), key=lambda a: (-a[0], a[1], a[2])):
        if len(chosen) < 30 and all(math.hypot(x - o[3], y - o[4]) >= 200 for o in chosen):
            chosen.append((d, r, c, x, y))
    assert [(r.row, r.col) for r in got] == [(a[1], a[2]) for a in chosen] and 10 < len(got)
    assert controls.dry_controls(table.limit(0), spark.createDataFrame(floods, "x double, y double")).count() == 0


def test_area_without_groups_equals_pairs(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["flood", "dry"]), float(rng.randrange(8)), float(rng.randrange(8))) for k in range(200)]
    df = spark.createDataFrame(rows, "label int, cls string, score double, other_score double")
    a, b = [r[2] for r in rows if r[1] == "flood"], [r[2] for r in rows if r[1] == "dry"]
    assert scoring.roc_auc(df).first().auc == pytest.approx(sum((x > y) + (x == y) / 2 for x in a for y in b) / len(a) / len(b))
    assert scoring.roc_auc(df.where("cls = 'dry'")).first().auc == 0.5 and scoring.roc_auc(df.limit(0)).first().auc == 0.5


def test_large_registers_are_drawn_by_counts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, cls := rng.choice(["flood", "dry"]), float(rng.randrange(8)) + (cls == "flood"), float(rng.randrange(8))) for k in range(400)]
    df = spark.createDataFrame(rows, "label int, cls string, score double, other_score double")
    small = scoring.bootstrap(df, "auc_diff", n_boot=400).first()
    monkeypatch.setattr(scoring, "REGISTER", 10)
    large = scoring.bootstrap(df, "auc_diff", n_boot=400).first()
    assert large.estimate == pytest.approx(small.estimate)
    assert abs(large.low - small.low) < 0.02 and abs(large.high - small.high) < 0.02
    assert scoring.bootstrap(df.repartition(7), "auc_diff", n_boot=400).first() == large


def test_curve_bands_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(cls := rng.choice(["flood", "dry"]), float(rng.randrange(6)) + (cls == "flood")) for _ in range(120)]
    df = spark.createDataFrame(rows, "cls string, score double")
    got = {(r.curve, r.at): r for r in resampling.curve_bands(df, n_boot=50, seed=9, steps=4).collect()}
    counts = df.groupBy((F.col("cls") == "flood").alias("pos"), "score").agg(F.count("*").alias("n"))
    drawn = {}
    for r in resampling.replicates(counts, 50, 9).collect():
        drawn.setdefault(r.replicate, []).append((r.score, r.pos, r.w))
    values = {k: [] for k in got}
    for table in drawn.values():
        p, n = sum(w for _, pos, w in table if pos), sum(w for _, pos, w in table if not pos)
        points = []
        for t in {s for s, _, _ in table}:
            tp, fp = (sum(w for s, pos, w in table if s >= t and pos == side) for side in (True, False))
            points.append((tp / p, fp / n, tp / (tp + fp)))
        for curve, at in values:
            values[curve, at].append(max([a for a, b, _ in points if b <= at], default=0.0) if curve == "roc" else max(c for a, _, c in points if a >= at))
    for k, v in values.items():
        assert got[k].mean == pytest.approx(np.mean(v))
        assert (got[k].low, got[k].high) == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])))


def test_solver_runs_that_do_not_end_are_errors(monkeypatch):
    z = np.zeros((4, 4))
    monkeypatch.setattr(solver, "RAIN_STEPS", 3)
    monkeypatch.setattr(solver, "INERTIAL_STEPS", 3)
    edge = np.zeros((4, 4), bool)
    edge[:, 0] = True
    with pytest.raises(RuntimeError, match="3 steps"):
        solver.inertial_run(z, edge, 1.0, total_s=5000.0, dt_max=1.0, window=10)


def test_registers_are_assessed_by_ground_and_distance(spark):
    g = grid_of(spark, [[1.0, 30.0, None, 2.0]])
    rows = [(1, "flood", 0, 0, 0.0, 0.0), (2, "flood", 0, 1, 900.0, 0.0), (3, "dry", 0, 2, 1800.0, 0.0), (4, "dry", 0, 3, 5000.0, 0.0), (5, "dry", 0, 0, 100.0, 0.0), (6, "dry", 0, 3, None, None), (7, "dry", 0, 0, 100.0, 0.0)]
    points = spark.createDataFrame(rows, "label int, cls string, row int, col int, x double, y double")
    got = {r.label: (r.flag, r.confidence) for r in controls.assessed_register(points, g).collect()}
    assert got == {1: ("ok", "high"), 2: ("flood on high ground", "low"), 3: ("off the ground", "low"), 4: ("ok", "high"), 5: ("dry beside a flood", "low"), 6: ("no place", "failed"), 7: ("dry beside a flood", "low")}


def test_pooled_law_is_that_of_all_station_years(spark):
    from tidemark.operators.series import fit_values
    from tidemark.plans import checks, forcing

    rng = np.random.default_rng(3)
    rows = [(f"s{s}", 2000 + y, float(v)) for s in range(4) for y, v in enumerate(rng.gumbel(50 + s, 12, size=20 if s else 2))]
    maxima = spark.createDataFrame(rows, "series_id string, year int, max_value double")
    reference = spark.createDataFrame([(0.0, 52.0, 12.0)], "xi double, mu double, sigma double")
    got = checks.pooled_bias(maxima, reference, forcing.return_periods(spark)).collect()
    xi, mu, sigma = fit_values(np.array([v for s, _, v in rows if s != "s0"]))
    assert {r.n_years for r in got} == {60} and got[0].mu == pytest.approx(mu, abs=0.05) and got[0].sigma == pytest.approx(sigma, abs=0.05)
    assert all(r.ratio == pytest.approx(r.reference / r.pooled) for r in got)
