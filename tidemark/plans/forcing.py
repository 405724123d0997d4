"""Forcing tables: baselines, scenario levels, sea-level deltas, datum patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hydrology import (
    FLUVIAL_EXPONENT, RETURN_PERIODS, anchored_level, climate_factor, datum_note, excess_rain, gev_quantile, gumbel_location, gumbel_scale, manning_stage, ponding_cap, scs_peak_discharge, scs_runoff,
)
from tidemark.operators.series import HALF_DAYS, HALF_HOURS, annual_maxima, anomalies, gev_fit, rolling_sum
from tidemark.sources.storage import by_merge

#: Warming in degrees by scenario and horizon (global surface air; over sea).
WARMING = {("SSP5-8.5", 2020): (0.0, 0.0), ("SSP2-4.5", 2050): (0.9, 0.7), ("SSP5-8.5", 2050): (1.3, 1.0), ("SSP2-4.5", 2100): (1.8, 1.4), ("SSP5-8.5", 2100): (4.0, 3.0)}


def return_periods(spark: SparkSession, periods: tuple[int, ...] = RETURN_PERIODS) -> DataFrame:
    return spark.createDataFrame([(p,) for p in periods], "return_period int")


def warming(spark: SparkSession, region: str = "GSAT") -> DataFrame:
    """(scenario, horizon, warming)"""
    at = {"GSAT": 0, "SEA": 1}[region]
    return spark.createDataFrame([(s, h, w[at]) for (s, h), w in WARMING.items()], "scenario string, horizon int, warming double")


def coastal_baseline(gauge: DataFrame, offset: float, periods: DataFrame, floor: float = 0.05) -> DataFrame:
    """Still-water levels from hourly gauge levels: less their long mean, yearly maxima, fit without limits, plus the datum offset."""
    maxima = annual_maxima(anomalies(gauge), HALF_HOURS)
    return coastal_levels(gev_fit(maxima, xi_max=None), offset, periods, floor)


def coastal_levels(params: DataFrame, offset: float, periods: DataFrame, floor: float = 0.05) -> DataFrame:
    """Still-water levels for each parameter row (xi, mu, sigma in metres) and return period, with the datum offset."""
    level = F.round(F.greatest(gev_quantile("xi", "mu", "sigma", "return_period") + offset, F.lit(floor)), 3)
    return params.join(F.broadcast(periods)).select("series_id", F.lit("coastal").alias("hazard_type"), "return_period", level.alias("baseline_water_level_m"), F.col("xi").alias("gev_shape"), (F.col("mu") * 1000).alias("gev_loc_mm"), (F.col("sigma") * 1000).alias("gev_scale_mm"), datum_note(F.lit(offset)).alias("datum_note"))


def rain_maxima(rain: DataFrame, hours: int) -> DataFrame:
    """Annual maxima of rain over a sliding window of hours."""
    return annual_maxima(rolling_sum(rain, hours), HALF_HOURS, "rolled")


def fluvial_from_rain(params: DataFrame, periods: DataFrame, basin: dict[str, float], max_stage: float = 8.0, floor: float = 0.05) -> DataFrame:
    """Stages by way of rain quantile, curve-number runoff, unit hydrograph and normal depth, for each parameter row (xi, mu, sigma).

    ``basin`` has cn, area_km2, duration_h, concentration_h, width, n, slope.
    """
    rain = gev_quantile("xi", "mu", "sigma", "return_period")
    q = scs_peak_discharge(scs_runoff(rain, basin["cn"]), basin["area_km2"], basin["duration_h"], basin["concentration_h"])
    stage = manning_stage(q, basin["width"], basin["n"], basin["slope"])
    level = F.round(F.least(F.greatest(stage, F.lit(floor)), F.lit(max_stage)), 4)
    return params.join(F.broadcast(periods)).withColumn("hazard_type", F.lit("fluvial")).withColumn("baseline_water_level_m", level)


def fluvial_from_discharge(daily: DataFrame, periods: DataFrame, channel: dict[str, float], bankfull_rp: int = 2, scale: float = 1.0, max_stage: float = 8.0, floor: float = 0.05) -> DataFrame:
    """Stages over bankfull from daily discharge: yearly maxima, fit, normal depth less that of the bankfull discharge."""
    fitted = gev_fit(annual_maxima(daily.withColumn("value", F.col("value") * scale), HALF_DAYS))
    return fluvial_levels(fitted, periods, channel, bankfull_rp, max_stage, floor)


def fluvial_levels(params: DataFrame, periods: DataFrame, channel: dict[str, float], bankfull_rp: int = 2, max_stage: float = 8.0, floor: float = 0.05) -> DataFrame:
    """Stages over that of the bankfull return period for each parameter row (xi, mu, sigma in m3/s); discharge counts as 1 at least."""
    stage = lambda rp: manning_stage(F.greatest(gev_quantile("xi", "mu", "sigma", rp), F.lit(1.0)), channel["width"], channel["n"], channel["slope"])
    level = F.least(F.greatest(stage(F.col("return_period")) - stage(bankfull_rp), F.lit(floor)), F.lit(max_stage))
    return params.join(F.broadcast(periods)).select("series_id", F.lit("fluvial").alias("hazard_type"), "return_period", level.alias("baseline_water_level_m"), "xi", "mu", "sigma")


def pluvial_levels(params: DataFrame, periods: DataFrame, drain_mm: float) -> DataFrame:
    """Excess rain depth for each parameter row (xi, mu, sigma) and return period."""
    level = excess_rain(gev_quantile("xi", "mu", "sigma", "return_period"), drain_mm)
    return params.join(F.broadcast(periods)).withColumn("hazard_type", F.lit("pluvial")).withColumn("baseline_water_level_m", level)


def pluvial_baseline(rain: DataFrame, periods: DataFrame, hours: int, drain_mm: float) -> DataFrame:
    return pluvial_levels(gev_fit(rain_maxima(rain, hours)), periods, drain_mm)


def idf_refit(anchors: DataFrame, periods: DataFrame, drain_mm: float, runoff: float = 1.0, drained: float = 1.0) -> DataFrame:
    """Levels of all return periods from two anchors (rp_a, x_a, rp_b, x_b) by the Gumbel law, and their ponding cap."""
    law = anchors.withColumn("sigma", gumbel_scale("rp_a", "x_a", "rp_b", "x_b")).withColumn("mu", gumbel_location("rp_a", "x_a", "rp_b", "x_b")).withColumn("xi", F.lit(0.0))
    level = gev_quantile("xi", "mu", "sigma", "return_period")
    excess = F.greatest(level - drain_mm, F.lit(0.0))
    return law.join(F.broadcast(periods)).withColumn("rain_mm", level).withColumn("cap_m", ponding_cap(excess, runoff, drained))


def scenario_levels(baseline: DataFrame, scenarios: DataFrame, rate: float = 0.07, exponent: float = FLUVIAL_EXPONENT, uniform: tuple[float, float] | None = None) -> DataFrame:
    """Hazard levels of every scenario and horizon (columns scenario, horizon, warming, coastal_delta_m).

    Coastal levels rise by the delta; fluvial and pluvial ones are multiplied
    by the climate factor, or by ``uniform`` (fluvial, pluvial) if given or if
    a row has no GEV parameters.
    """
    h = F.col("hazard_type")
    simple = F.lit(uniform is not None) | F.col("gev_scale_mm").isNull()
    by_law = F.when(h == "fluvial", climate_factor("warming", exponent, rate)).when(h == "pluvial", climate_factor("warming", 1.0, rate))
    fluvial, pluvial = uniform or (1.10, 1.15)
    factor = F.when(h == "coastal", F.lit(None)).when(simple, F.when(h == "fluvial", fluvial).otherwise(pluvial)).otherwise(by_law)
    method = F.when(h == "coastal", "additive").when(simple, "uniform").otherwise("gev_cc")
    out = baseline.join(F.broadcast(scenarios)).withColumn("scaling_factor", factor).withColumn("scaling_method", method)
    level = F.when(h == "coastal", F.col("baseline_water_level_m") + F.col("coastal_delta_m")).otherwise(F.col("baseline_water_level_m") * F.col("scaling_factor"))
    return out.withColumn("water_level_m", level)


def sea_level_delta(samples: DataFrame, year: int, base: int, percentile: float, *by: str) -> DataFrame:
    """Percentile over samples of the change from base to year, each sample against itself; both years must exist.

    ``samples`` has sample, year, slc and units (m or mm).
    """
    to_m = F.when(F.col("units") == "m", 1.0).when(F.col("units") == "mm", 0.001).otherwise(F.raise_error(F.lit("units must be m or mm")).cast("double"))
    value = F.col("slc") * to_m
    pairs = samples.where(F.col("year").isin(year, base)).groupBy(*by, "sample").agg(F.max(F.when(F.col("year") == year, value)).alias("then"), F.max(F.when(F.col("year") == base, value)).alias("now"))
    delta = F.percentile(F.col("then") - F.col("now"), F.lit(percentile / 100))
    missing = (F.count("then") == 0) | (F.count("now") == 0)
    return pairs.groupBy(*by).agg(F.when(missing, F.raise_error(F.lit("projection lacks the year or its base")).cast("double")).otherwise(delta).alias("delta_m"))


def scenario_table(wanted: DataFrame, cache: DataFrame, samples: DataFrame, *, workflow: str, lat: float, lon: float, percentile: float, base: int) -> DataFrame:
    """scenario, horizon, water_level_m, source_note for every wanted scenario and horizon: cached answers first, the rest from samples.

    ``samples`` has scenario, sample, year, slc and units; a miss whose year or
    base no sample has gets a null level.
    """
    from tidemark.sources.tables import cache_key, cached

    key = cache_key(F.lit(workflow), F.col("scenario"), F.lit(lat), F.lit(lon), F.lit(percentile), F.lit(base), F.col("horizon"))
    hits, misses = cached(wanted.withColumn("key", key), cache)
    to_m = F.when(F.col("units") == "m", 1.0).when(F.col("units") == "mm", 0.001)
    metres = samples.select("scenario", "sample", "year", (F.col("slc") * to_m).alias("slc"))
    now = metres.where(F.col("year") == base).select("scenario", "sample", F.col("slc").alias("now"))
    then = metres.withColumnRenamed("year", "horizon").join(now, ["scenario", "sample"])
    deltas = then.groupBy("scenario", "horizon").agg(F.percentile(F.col("slc") - F.col("now"), F.lit(percentile / 100)).alias("water_level_m"))
    told = misses.join(deltas, ["scenario", "horizon"], "left").withColumn("source_note", F.lit("samples"))
    columns = ["scenario", "horizon", "water_level_m", "source_note"]
    return hits.select(*columns).union(told.select(*columns))


def interpolated_levels(base: DataFrame, reference: DataFrame, warming_degrees: float, reference_degrees: float, cap: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Pluvial levels between a baseline and a reference scenario, and whether they rise with the return period in each group ``by``."""
    keys = [*by, "return_period"]
    joined = base.select(*keys, F.col("water_level_m").alias("b")).join(reference.select(*keys, F.col("water_level_m").alias("r")), keys)
    level = joined.select(*keys, anchored_level("b", "r", warming_degrees, reference_degrees, cap).alias("water_level_m"))
    before = F.lag("water_level_m").over(Window.partitionBy(*by).orderBy("return_period"))
    return level.withColumn("rises", F.coalesce(F.col("water_level_m") >= before, F.lit(True)))


def noted_offset(note: Column) -> Column:
    """The offset in a datum note, null without one."""
    return F.regexp_extract(note, r"MSL\+(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def patched_datum(baseline: DataFrame, offset: float, tag: str) -> DataFrame:
    """Coastal levels moved to a new offset; rows that bear the tag stay, so a second run changes nothing.

    The offset already applied is read from the first coastal row's note.
    """
    prior = baseline.where("hazard_type = 'coastal'").agg(F.min_by(F.coalesce(noted_offset(F.col("datum_note")), F.lit(0.0)), "return_period").alias("prior"))
    due = (F.col("hazard_type") == "coastal") & ~F.coalesce(F.col("source_note").contains(tag), F.lit(False))
    todo = F.col("_todo")
    out = baseline.join(F.broadcast(prior)).withColumn("_todo", due)
    level = F.when(todo, F.round(F.col("baseline_water_level_m") + F.lit(offset) - F.col("prior"), 4)).otherwise(F.col("baseline_water_level_m"))
    note = F.when(todo, F.concat_ws("; ", "source_note", F.lit(tag))).otherwise(F.col("source_note"))
    return out.withColumn("baseline_water_level_m", level).withColumn("source_note", note).withColumn("datum_note", F.when(todo, datum_note(F.lit(offset))).otherwise(F.col("datum_note"))).drop("prior", "_todo")


def grid_value(field: DataFrame, points: DataFrame, step: float, value: str = "mdt", reach: float = 1.0) -> DataFrame:
    """Bilinear value of a latitude-longitude field at points; where a corner is missing the nearest known within ``reach`` degrees."""
    known = field.where(F.col(value).isNotNull()).select(F.round(F.col("lat") / step).cast("int").alias("_i"), F.round(F.col("lon") / step).cast("int").alias("_j"), F.col(value).alias("_v"))
    n = int(reach / step)
    i, j = F.floor(F.col("lat") / step).cast("int"), F.floor(F.col("lon") / step).cast("int")
    asks = points.withColumn("_a", F.explode(F.sequence(F.lit(-n), F.lit(n + 1)))).withColumn("_b", F.explode(F.sequence(F.lit(-n), F.lit(n + 1)))).withColumn("_i", i + F.col("_a")).withColumn("_j", j + F.col("_b"))
    met = by_merge(asks).join(known, ["_i", "_j"])
    dy, dx = F.col("lat") / step - F.col("_i"), F.col("lon") / step - F.col("_j")
    corner = F.col("_a").isin(0, 1) & F.col("_b").isin(0, 1)
    w = F.when(corner, (1 - F.abs(dy)) * (1 - F.abs(dx)))
    d2 = (dy * dy + dx * dx) * step * step
    near = F.min(F.when(d2 <= reach * reach, F.struct(d2.alias("d"), F.col("_v").alias("v"))))
    found = met.groupBy(*points.columns).agg(F.when(F.count_if(corner) == 4, F.sum(F.col("_v") * w)).otherwise(near["v"]).alias(value))
    return points.join(found, points.columns, "left")
