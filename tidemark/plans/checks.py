"""Plausibility checks over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hydrology import excess_rain, gev_quantile, gev_return_period, gumbel_location, gumbel_scale, ponding_cap
from tidemark.operators.series import gev_fit

#: Scenarios in order of severity.
SEVERITY_ORDER = (("SSP2-4.5", 2050), ("SSP5-8.5", 2050), ("SSP2-4.5", 2100), ("SSP5-8.5", 2100))


def rp_monotonicity(summary: DataFrame, land_km2: float | None = None, most_wet: float = 0.6, slack: float = 1e-9) -> DataFrame:
    """Rows whose area or depth falls as the return period grows, or that wet too large a share of the land."""
    w = Window.partitionBy("hazard_type", "scenario", "horizon").orderBy("return_period")
    out = summary.withColumn("area_before", F.lag("flooded_area_km2").over(w)).withColumn("depth_before", F.lag("max_depth_m").over(w))
    told = [F.when(F.col("flooded_area_km2") < F.col("area_before") - slack, F.lit("area falls")), F.when(F.col("max_depth_m") < F.col("depth_before") - slack, F.lit("depth falls"))]
    if land_km2:
        told.append(F.when(F.col("flooded_area_km2") / land_km2 > most_wet, F.lit("too wet")))
    return out.select("hazard_type", "scenario", "horizon", "return_period", F.explode(F.array_compact(F.array(*told))).alias("problem"))


def forcing_problems(levels: DataFrame, cap: float = 0.5) -> DataFrame:
    """Pluvial levels over the plausible cap, or under those of a less severe scenario."""
    rank = F.coalesce(*[F.when((F.col("scenario") == s) & (F.col("horizon") == h), n) for n, (s, h) in enumerate(SEVERITY_ORDER)])
    own = levels.where("hazard_type = 'pluvial'").withColumn("severity", rank).where("severity is not null")
    before = F.lag("water_level_m").over(Window.partitionBy("return_period").orderBy("severity"))
    told = F.array_compact(F.array(F.when(F.col("water_level_m") > cap, F.lit("over cap")), F.when(F.col("water_level_m") < F.col("before"), F.lit("under a milder scenario"))))
    return own.withColumn("before", before).select("return_period", "scenario", "horizon", "water_level_m", F.explode(told).alias("problem"))


def defence_problems(defended: DataFrame, plain: DataFrame, slack: float = 0.05, rp2_cap_km2: float | None = None) -> DataFrame:
    """Defended areas over undefended ones, falling with the return period, or too large at two years."""
    joined = defended.select("hazard_type", "return_period", F.col("flooded_area_km2").alias("area")).join(plain.select("hazard_type", "return_period", F.col("flooded_area_km2").alias("plain")), ["hazard_type", "return_period"])
    before = F.lag("area").over(Window.partitionBy("hazard_type").orderBy("return_period"))
    told = [F.when(F.col("area") > F.col("plain") * (1 + slack), F.lit("over undefended")), F.when(F.col("area") < F.col("before") * (1 - slack), F.lit("falls"))]
    if rp2_cap_km2 is not None:
        told.append(F.when((F.col("return_period") == 2) & (F.col("area") > rp2_cap_km2), F.lit("two-year area too large")))
    return joined.withColumn("before", before).select("hazard_type", "return_period", F.explode(F.array_compact(F.array(*told))).alias("problem"))


def anchor_deviation(params: DataFrame, anchors: DataFrame, warn: float = 0.25, fail: float = 0.25) -> DataFrame:
    """Fitted levels against published anchors (series_id, anchor_rp, anchor_value): deviation and PASS, WARN or FAIL."""
    level = gev_quantile("xi", "mu", "sigma", "anchor_rp")
    out = anchors.join(params, "series_id").withColumn("fitted", level).withColumn("deviation", F.col("fitted") / F.col("anchor_value") - 1)
    size = F.abs(F.col("deviation"))
    return out.withColumn("verdict", F.when(size <= warn, "PASS").when(size <= fail, "WARN").otherwise("FAIL"))


def cap_reproduction(stored: DataFrame, drain_mm: float, runoff: float = 1.0, drained: float = 1.0, slack: float = 0.001, by: tuple[str, ...] = ()) -> DataFrame:
    """Stored pluvial caps (return_period, cap_m, rp_a, x_a, rp_b, x_b) against the Gumbel chain that should give them."""
    sigma, mu = gumbel_scale("rp_a", "x_a", "rp_b", "x_b"), gumbel_location("rp_a", "x_a", "rp_b", "x_b")
    excess = F.greatest(gev_quantile(F.lit(0.0), mu, sigma, "return_period") - drain_mm, F.lit(0.0))
    out = stored.withColumn("expected_m", ponding_cap(excess, runoff, drained))
    before = F.lag("cap_m").over(Window.partitionBy(*by).orderBy("return_period"))
    verdict = F.when(F.abs(F.col("cap_m") - F.col("expected_m")) > slack, "FAIL").when(F.col("cap_m") < F.col("before"), "FAIL").when(F.col("cap_m") <= 0.005, "WARN").when(F.col("cap_m") >= 3.0, "FAIL").otherwise("PASS")
    return out.withColumn("before", before).withColumn("verdict", verdict).drop("before")


def depth_anchors(pluvial: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Point depths by return period: at least half of 7 cm from ten years on, the thousand-year between 0.38 and 3 m, never falling."""
    before = F.lag("max_depth_m").over(Window.partitionBy(*by).orderBy("return_period"))
    told = F.array_compact(F.array(F.when((F.col("return_period") >= 10) & (F.col("max_depth_m") < 0.035), F.lit("too shallow")), F.when((F.col("return_period") == 1000) & ~F.col("max_depth_m").between(0.38, 3.0), F.lit("thousand-year depth")), F.when(F.col("max_depth_m") < F.col("before"), F.lit("falls"))))
    return pluvial.withColumn("before", before).select(*by, "return_period", F.explode(told).alias("problem"))


def bracket(levels: DataFrame, values: DataFrame) -> DataFrame:
    """For each value's return period the stored ones around it: ``lower`` and ``upper``, null outside."""
    rp = F.col("rp")
    return values.join(F.broadcast(levels.select("return_period").distinct())).groupBy(*values.columns).agg(F.max(F.when(F.col("return_period") <= rp, F.col("return_period"))).alias("lower"), F.min(F.when(F.col("return_period") >= rp, F.col("return_period"))).alias("upper"))


def redone_excess(stored: DataFrame) -> DataFrame:
    """Pluvial levels computed again from stored location and scale and the drain capacity in the note."""
    drain = F.regexp_extract("source_note", r"drain(?:age)?_?(?:capacity)?=(\d+(?:\.\d+)?)", 1).try_cast("double")
    return stored.withColumn("level_m", excess_rain(gev_quantile(F.coalesce("gev_shape", F.lit(0.0)), "gev_loc_mm", "gev_scale_mm", "return_period"), drain))


def bias_by_period(levels: DataFrame, pooled: DataFrame) -> DataFrame:
    """Levels (series_id, return_period, level) over the pooled level of their return period: ``ratio``, null where that is zero."""
    return levels.join(F.broadcast(pooled), "return_period").withColumn("ratio", F.col("level") / F.when(F.col("pooled") != 0, F.col("pooled")))


def pooled_bias(maxima: DataFrame, reference: DataFrame, periods: DataFrame, least_years: int = 3) -> DataFrame:
    """return_period, pooled, reference, ratio and the pooled parameters: levels of one law fitted to all station years against a reference's.

    ``maxima`` has series_id, year and max_value, ``reference`` one row of xi,
    mu and sigma.  Stations with fewer than ``least_years`` known maxima take no
    part.  The fit is one task over a number a station and year.
    """
    known = maxima.where(F.col("max_value").isNotNull())
    enough = known.groupBy("series_id").agg(F.count("*").alias("years")).where(F.col("years") >= least_years)
    pooled = gev_fit(known.join(enough, "series_id", "left_semi").select(F.lit("pooled").alias("series_id"), "max_value"))
    other = reference.select(F.col("xi").alias("r_xi"), F.col("mu").alias("r_mu"), F.col("sigma").alias("r_sigma"))
    both = periods.join(pooled.join(other))
    level, held = gev_quantile("xi", "mu", "sigma", "return_period"), gev_quantile("r_xi", "r_mu", "r_sigma", "return_period")
    told = both.select("return_period", level.alias("pooled"), held.alias("reference"), "xi", "mu", "sigma", "n_years")
    return told.withColumn("ratio", F.col("reference") / F.when(F.col("pooled") != 0, F.col("pooled")))


def event_bracket(peaks: DataFrame, params: DataFrame, periods: DataFrame) -> DataFrame:
    """Event peaks (series_id, peak) to their return period by the series' law, and the stored periods around it."""
    rp = peaks.join(params, "series_id").select("series_id", gev_return_period("xi", "mu", "sigma", "peak").alias("rp"))
    return bracket(periods, rp)
