"""Runs reach the solvers sorted, batch by batch; bands of rows change no bit."""

import numpy as np
import pytest

from tidemark.operators import solver


def ground(seed, shape=(23, 17)):
    z = np.random.default_rng(seed).normal(1.0, 0.5, shape)
    z[3, 4] = np.nan
    return z


def test_bands_change_no_bit(monkeypatch):
    z, flat = ground(1), np.full((23, 17), 0.05)
    outlet, net, edge = z < 0.2, np.full(z.shape, 0.2), np.zeros(z.shape, bool)
    edge[0] = True
    whole = solver.rain_run(z, outlet, net, flat, storm_s=60, total_s=120, dt_max=5, conveyance=0.001), solver.inertial_run(z, edge, 1.4, total_s=120, dt_max=5)
    for band in (1, 17, 40, 100):
        monkeypatch.setattr(solver, "BAND", band)
        again = solver.rain_run(z, outlet, net, flat, storm_s=60, total_s=120, dt_max=5, conveyance=0.001), solver.inertial_run(z, edge, 1.4, total_s=120, dt_max=5)
        for a, b in zip(whole, again):
            assert a[2:] == b[2:] and all(np.array_equal(x, y, equal_nan=True) for x, y in zip(a[:2], b[:2]))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_runs_cut_by_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        z = ground(2)
        rows = [(s, rp, r, c, None if np.isnan(z[r, c]) else float(z[r, c]), r == 0, 1.0 + rp / 10 + (s == "b"), 0.0, 0.0) for s in "ab" for rp in (2, 5) for r in range(23) for c in range(17) if (r, c) != (9, 9)]
        cells = spark.createDataFrame(rows, "scenario string, return_period int, row int, col int, z double, boundary boolean, level double, floor double, start double")
        got = {(r.scenario, r.return_period, r.row, r.col): r.depth for r in solver.inertial(cells, total_s=60.0, dt_max=5.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    ok, edge = z.copy(), np.zeros(z.shape, bool)
    edge[0], ok[9, 9] = True, np.nan
    for s in "ab":
        start = np.zeros(z.shape)
        for rp in (2, 5):
            peak = solver.inertial_run(ok, edge, 1.0 + rp / 10 + (s == "b"), total_s=60.0, dt_max=5.0, start=start)[0]
            start = np.nan_to_num(peak)
            assert all(got[s, rp, r, c] == (None if np.isnan(peak[r, c]) else peak[r, c]) for r in range(23) for c in range(17) if (r, c) != (9, 9))
