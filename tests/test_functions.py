import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import depth as D
from tidemark.functions import geo
from tidemark.functions import hydrology as H


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_gev_chain_of_pluvial_levels(spark):
    expected = (0.001864, 0.019999, 0.032006, 0.047177, 0.058431, 0.069602, 0.080733, 0.095418, 0.106516)
    got = one(spark, *[H.excess_rain(H.gev_quantile(0, 46, 16, rp), 50) for rp in H.RETURN_PERIODS])
    assert got == pytest.approx(expected, abs=5e-7)


def test_gev_scs_manning_chain_of_fluvial_levels(spark):
    expected = (1.2642, 1.5103, 1.6684, 1.8645, 2.0080, 2.1493, 2.2893, 2.4733, 2.6123)
    stage = [H.manning_stage(H.scs_peak_discharge(H.scs_runoff(H.gev_quantile(0.05, 129, 30, rp), 85), 10, 24, 0.5), 10, 0.04, 0.002) for rp in H.RETURN_PERIODS]
    assert one(spark, *stage) == pytest.approx(expected, abs=5e-5)


def test_manning_and_scs_limits(spark):
    assert one(spark, H.manning_stage(1, 1, 1, 1), H.manning_stage(0, 1, 1, 1), H.scs_runoff(5, 85), H.scs_peak_discharge(50, 10, 24, 0.5)) == pytest.approx((1, 0, 0, 8.455), abs=1e-3)
    with pytest.raises(Exception, match="positive"):
        one(spark, H.manning_stage(1, 0, 1, 1))
    with pytest.raises(Exception, match="curve number"):
        one(spark, H.scs_runoff(5, 100))


def test_overbank_and_climate(spark):
    args = (0.2835, 149.5, 44.7, 100)
    assert one(spark, H.overbank_stage(*args, 1.0, 98, 30, 0.035, 0.002), H.overbank_stage(*args, 2.06, 98, 30, 0.035, 0.002)) == pytest.approx((3.3095, 6.0594), abs=1e-3)
    assert one(spark, H.climate_factor(4.0), H.climate_factor(4.0, 0.6)) == pytest.approx((1.28, 1.159647), abs=1e-6)
    with pytest.raises(Exception, match="baseline quantile"):
        one(spark, H.checked_climate_factor(0.0, 4.0))


def test_quantile_and_period_are_inverse(spark):
    for xi in (-0.2, 0.0, 0.3):
        assert one(spark, H.gev_return_period(xi, 10, 3, H.gev_quantile(xi, 10, 3, 50)))[0] == pytest.approx(50, rel=1e-6)
    density = one(spark, *[H.gev_pdf(0.1, 10, 3, x / 10) for x in range(-300, 1200, 5)])
    assert sum(density) * 0.5 == pytest.approx(1, abs=5e-3)


def test_two_anchor_gumbel(spark):
    mu, sigma = one(spark, H.gumbel_location(2, 51.864207, 100, 119.6022), H.gumbel_scale(2, 51.864207, 100, 119.6022))
    assert (mu, sigma) == pytest.approx((46, 16), abs=1e-3)


def test_surge(spark):
    got = one(spark, *[H.surge_level(t, 2.0, 0.5) for t in (0, 5400, 10800, 14400, 18000, 21600, 90000)])
    assert got == pytest.approx((0, 1, 2, 2, 1.25, 0.5, 0.5))


def test_null_never_becomes_zero(spark):
    null = F.lit(None).cast("double")
    exprs = [D.bathtub(null, 1), D.lumped_ponding(null, 2, 1), D.floored(null), D.capped(null, 1), D.zeroed(null, F.lit(True)), D.preflooded(null, F.lit(True)), D.burned(null, F.lit(True), 1), D.crested(null, 2.0), D.protected(null, F.lit(True), 3, 2, 0.5), D.present_day(null, 1), D.coastal_capped(null, F.lit(1.0), 2), H.manning_stage(null, 1, 1, 1), H.scs_runoff(null, 85), H.excess_rain(null, 5), H.gev_quantile(0.1, null, 1, 2), H.surge_level(null, 2.0)]
    assert one(spark, *exprs) == (None,) * len(exprs)


def test_severity_composite_and_dominant(spark):
    null = F.lit(None).cast("double")
    assert one(spark, *[D.severity(x) for x in (null, 0, 0.15, 0.16, 0.5, 1.0, 1.01)]) == (255, 0, 1, 2, 2, 3, 4)
    assert one(spark, D.composite(0.0, 0.3), D.composite(null, 0.2), D.composite(null, null)) == (0.3, 0.2, None)
    assert one(spark, D.dominant({"a": F.lit(0.5), "b": F.lit(0.5)}), D.dominant({"a": null, "b": F.lit(0.0)}), D.dominant({"a": F.lit(0.2), "b": F.lit(0.5)}, {"b": 0.6})) == ("a", None, "a")
    assert one(spark, D.runoff_coefficient(F.lit(50)), D.runoff_coefficient(F.lit(7)), D.runoff_coefficient(F.lit(None).cast("int"))) == (0.85, 0.40, 0.40)


@pytest.mark.parametrize(("epsg", "lon", "lat", "x", "y"), [(32648, 103.8198, 1.3521, 368697, 149495), (32748, 106.8456, -6.2088, 704182, 9313374)])
def test_utm(spark, epsg, lon, lat, x, y):
    ex, ny = geo.to_utm(lon, lat, epsg)
    gx, gy = one(spark, ex, ny)
    assert abs(gx - x) < 500 and abs(gy - y) < 500
    assert one(spark, *geo.from_utm(gx, gy, epsg)) == pytest.approx((lon, lat), abs=1e-9)


def test_polygon_and_segment(spark):
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))])
    assert one(spark, *[geo.in_ring(x, y, ring) for x, y in ((1.0, 1.0), (2.0, 2.0), (3.5, 2.0), (5.0, 1.0))]) == (True, False, True, False)
    assert one(spark, geo.segment_distance(0.0, 3.0, 0.0, 0.0, 0.0, 1.0), geo.segment_distance(1.0, 0.5, 0.0, 0.0, 0.0, 1.0), geo.segment_distance(3.0, 4.0, 0.0, 0.0, 0.0, 0.0)) == pytest.approx((2, 1, 5))
    assert one(spark, geo.tile_name(-7, 106), geo.tile_name(1, -2)) == ("S09E105", "N00W003")
    assert math.isclose(one(spark, geo.pixel_area(30.0, -30.0, F.lit(32648)))[0], 900)
