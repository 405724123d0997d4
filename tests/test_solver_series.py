import numpy as np
import pytest

from tidemark.operators import series as S
from tidemark.operators import solver as V


def test_flat_box_holds_the_rain():
    z = np.zeros((20, 20))
    peak, _, t, _ = V.rain_run(z, z > 1, np.full_like(z, 0.05), np.full_like(z, 0.05), storm_s=600, total_s=900)
    assert t == 900 and np.allclose(peak, 0.05, atol=1e-4)


def test_mass_is_kept_and_outlets_drain():
    z = np.zeros((30, 30))
    _, final, _, _ = V.rain_run(z, z > 9, np.full_like(z, 0.04), np.full_like(z, 0.05), storm_s=600, total_s=1200)
    assert final.sum() == pytest.approx(0.04 * 900, rel=1e-3)
    tilt = np.linspace(4, 0, 40)[:, None] + np.zeros((40, 40))
    outlet = np.zeros_like(tilt, bool)
    outlet[-1] = True
    peak, final, _, _ = V.rain_run(tilt, outlet, np.full_like(tilt, 0.05), np.full_like(tilt, 0.05), storm_s=600, total_s=3600)
    assert peak[:-1].max() < 0.15 and final.sum() < 0.5 * 0.05 * 1600


def test_cap_and_nodata():
    z = np.full((15, 15), 10.0)
    z[7, 7], z[0, 0] = 4.0, np.nan
    peak, _, _, _ = V.rain_run(z, np.zeros_like(z, bool), np.full_like(z, 1.0), np.full_like(z, 0.05), storm_s=300, total_s=300, cap=0.5)
    assert np.nanmax(peak) <= 0.5 and np.isnan(peak[0, 0])


def test_channel_floods_what_it_reaches():
    z = np.full((12, 40), 0.5)
    z[:, 0], z[:, 20] = -2.0, 5.0
    z[:, 30] = -1.0
    boundary = np.zeros_like(z, bool)
    boundary[:, 0] = True
    peak, *_ = V.inertial_run(z, boundary, 2.0, total_s=7200, tolerance=0)
    assert peak[5, 3] > 0.3 and peak[5, 10] > 0.05 and peak[5, 30] < 0.02


def test_parallel_runs_equal_serial_bits(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.grid import filled_grid

    bowl = filled_grid(spark, 20, 20).withColumn("z", F.abs(F.col("row") - 10) * 0.05 + F.abs(F.col("col") - 10) * 0.05)
    three = spark.createDataFrame([(2, 0.02), (10, 0.05), (100, 0.1)], "return_period int, net_rain double")
    runs = bowl.join(F.broadcast(three)).withColumn("outlet", F.col("row") == 19).withColumn("n", F.lit(0.05))
    together = {tuple(r)[:3]: r.depth for r in V.rain_on_grid(runs, storm_s=60.0, total_s=120.0).collect()}
    alone = {}
    for rp in (2, 10, 100):
        alone.update({tuple(r)[:3]: r.depth for r in V.rain_on_grid(runs.where(F.col("return_period") == rp).repartition(3), storm_s=60.0, total_s=120.0).collect()})
    assert together == alone


def test_gev_fit_recovers_parameters(spark):
    u = (np.arange(1, 401) - 0.5) / 400
    xi, mu, sigma = 0.15, 100.0, 25.0
    x = mu + sigma / xi * ((-np.log(u)) ** -xi - 1)
    got = S.fit_values(x)
    assert got == pytest.approx((xi, mu, sigma), rel=0.05)
    assert S.fit_values(mu + sigma / 0.6 * ((-np.log(u)) ** -0.6 - 1))[0] == 0.30
    few = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "series_id string, max_value double")
    assert S.gev_fit(few).first().xi is None


def test_rolling_and_gated_maxima(spark):
    rows = [("s", i, 1.0 if i < 6 else 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "series_id string, h int, value double").selectExpr("series_id", "timestamp '2001-01-01 00:00:00' + make_interval(0,0,0,0,h,0,0) ts", "value")
    rolled = [r.rolled for r in S.rolling_sum(df, 6).orderBy("ts").collect()]
    assert rolled[5] == 6 and rolled[1] is None and rolled[11] == 0
    assert S.annual_maxima(df, 12).first().max_value == 1 and S.annual_maxima(df, 13).isEmpty()
