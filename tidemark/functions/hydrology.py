"""Extreme-value and hydrology formulas as column expressions.

All take Columns (or column names) and numbers alike; a null argument gives
null.  Arguments outside a formula's domain raise while the query runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Return periods in years that every hazard table holds.
RETURN_PERIODS = (2, 5, 10, 25, 50, 100, 200, 500, 1000)
#: Share of warming that rain gains per degree, and the power by which discharge levels follow rain.
CC_RATE, FLUVIAL_EXPONENT = 0.07, 0.6
#: Mekong backwater: share of the discharge excess, and metres per m3/s.
BACKWATER_SHARE, BACKWATER_RATE = 0.5, 1.053e-5

Value = Column | str | float | int


def col(x: Value) -> Column:
    """A column from a name, a number or a column."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _checked(ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok``; null arguments pass as null."""
    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def gumbel_variate(rp: Value) -> Column:
    """-ln(-ln(1 - 1/T))"""
    return -F.ln(-F.ln(1 - 1 / col(rp)))


def gev_quantile(xi: Value, mu: Value, sigma: Value, rp: Value) -> Column:
    """Level of return period ``rp`` of a GEV with shape ``xi`` (positive: heavy tail), location and scale."""
    xi, mu, sigma, rp = map(col, (xi, mu, sigma, rp))
    y = -F.ln(1 - 1 / rp)
    heavy = mu + sigma / F.when(xi != 0, xi) * (F.pow(y, -xi) - 1)
    return _checked((rp > 1) & (sigma > 0), F.when(F.abs(xi) > 1e-12, heavy).when(xi.isNotNull(), mu - sigma * F.ln(y)), "return period must exceed 1 and scale must be positive")


def gev_cdf(xi: Value, mu: Value, sigma: Value, x: Value) -> Column:
    """Probability of not exceeding ``x``."""
    xi, mu, sigma, x = map(col, (xi, mu, sigma, x))
    z = (x - mu) / sigma
    t = 1 + xi * z
    heavy = F.when(t > 0, F.exp(-F.pow(F.when(t > 0, t), -1 / F.when(xi != 0, xi)))).when(xi > 0, 0.0).otherwise(1.0)
    return F.when(F.abs(xi) > 1e-12, heavy).when(xi.isNotNull(), F.exp(-F.exp(-z)))


def gev_pdf(xi: Value, mu: Value, sigma: Value, x: Value) -> Column:
    """Density at ``x``."""
    xi, mu, sigma, x = map(col, (xi, mu, sigma, x))
    z = (x - mu) / sigma
    t = 1 + xi * z
    u = F.when(F.abs(xi) > 1e-12, F.pow(F.when(t > 0, t), -1 / F.when(xi != 0, xi))).otherwise(F.exp(-z))
    return F.coalesce(F.pow(u, xi + 1) * F.exp(-u) / sigma, F.when(xi.isNotNull() & x.isNotNull(), F.lit(0.0)))


def gev_return_period(xi: Value, mu: Value, sigma: Value, x: Value) -> Column:
    """1 / (1 - F(x)), with F held within 1e-9 of 0 and 1."""
    p = gev_cdf(xi, mu, sigma, x)
    return F.when(p.isNotNull(), 1 / (1 - F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))))


def gumbel_scale(rp_a: Value, x_a: Value, rp_b: Value, x_b: Value) -> Column:
    """Scale of the Gumbel law through two levels of known return periods."""
    return (col(x_b) - col(x_a)) / (gumbel_variate(rp_b) - gumbel_variate(rp_a))


def gumbel_location(rp_a: Value, x_a: Value, rp_b: Value, x_b: Value) -> Column:
    return col(x_a) - gumbel_scale(rp_a, x_a, rp_b, x_b) * gumbel_variate(rp_a)


def scs_runoff(rain_mm: Value, curve_number: Value) -> Column:
    """Curve-number runoff depth in mm."""
    p, cn = col(rain_mm), col(curve_number)
    s = 25400 / cn - 254
    ia = 0.2 * s
    return _checked((cn > 0) & (cn < 100), F.when(p <= ia, 0.0).otherwise((p - ia) * (p - ia) / (p + 0.8 * s)), "curve number must lie between 0 and 100")


def scs_peak_discharge(runoff_mm: Value, area_km2: Value, duration_h: Value, concentration_h: Value) -> Column:
    """Peak of the triangular unit hydrograph in m3/s, never below zero."""
    q = 0.208 * col(area_km2) * col(runoff_mm) / (col(duration_h) / 2 + 0.6 * col(concentration_h))
    return F.when(q.isNotNull(), F.greatest(q, F.lit(0.0)))


def manning_stage(discharge: Value, width: Value, n: Value, slope: Value) -> Column:
    """Normal depth in a wide rectangular channel; zero without flow."""
    q, w, n, s = map(col, (discharge, width, n, slope))
    return _checked((w > 0) & (n > 0) & (s > 0), F.when(q <= 0, 0.0).when(q > 0, F.pow(q * n / (w * F.sqrt(s)), F.lit(0.6))), "channel width, roughness and slope must be positive")


def narrow_channel(discharge: Value, width: Value, n: Value, slope: Value) -> Column:
    """True where width is under five times the depth, so that the wide-channel formula is doubtful."""
    stage = manning_stage(discharge, width, n, slope)
    return (stage > 0) & (col(width) < 5 * stage)


def overbank_stage(xi: Value, mu: Value, sigma: Value, rp: Value, factor: Value, bankfull: Value, width: Value, n: Value, slope: Value) -> Column:
    """Stage over bankfull of the return period's discharge times a bias factor."""
    rise = manning_stage(col(factor) * gev_quantile(xi, mu, sigma, rp), width, n, slope) - manning_stage(bankfull, width, n, slope)
    return F.when(rise.isNotNull(), F.greatest(rise, F.lit(0.0)))


def excess_rain(level_mm: Value, drain_mm: Value) -> Column:
    """Rain over drainage capacity in metres; rain counts as 1 mm at least."""
    x = F.when(col(level_mm).isNotNull(), F.greatest(col(level_mm), F.lit(1.0))) - col(drain_mm)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)) / 1000)


def ponding_cap(excess_mm: Value, runoff: Value, drained_share: Value) -> Column:
    """Ponding depth of excess rain on the undrained share, between 5 mm and 3 m."""
    d = col(excess_mm) / 1000 * col(runoff) / col(drained_share)
    return F.when(d.isNotNull(), F.round(F.least(F.greatest(d, F.lit(0.005)), F.lit(3.0)), 4))


def climate_factor(warming: Value, exponent: Value = 1.0, rate: Value = CC_RATE) -> Column:
    """Factor on levels after ``warming`` degrees: (1 + rate * warming) ** exponent.

    Scaling location and scale of a GEV alike scales all its quantiles, so the
    factor is the same for every return period.
    """
    return F.pow(1 + col(rate) * col(warming), col(exponent))


def checked_climate_factor(base_quantile: Value, warming: Value, exponent: Value = 1.0) -> Column:
    q = col(base_quantile)
    return _checked(q > 0, F.when(q.isNotNull(), climate_factor(warming, exponent)), "baseline quantile must be positive")


def to_egm2008(level: Value, offset: Value, chart_to_msl: Value = 0.0) -> Column:
    """A level above mean sea level (or chart datum, with ``chart_to_msl``) in metres EGM2008."""
    return col(level) + col(chart_to_msl) + col(offset)


def datum_note(offset: Value) -> Column:
    return F.format_string("EGM2008; MSL+%.3f m", col(offset))


def datum_note_valid(note: Column) -> Column:
    return F.coalesce(note.rlike(r"^EGM2008; MSL[+]-?\d+\.\d{3} m"), F.lit(False))


def surge_level(seconds: Value, peak: Value, floor: Value = 0.0, rise_s: float = 10_800, hold_s: float = 3_600, fall_s: float = 7_200) -> Column:
    """Surge hydrograph: from zero to the peak, a hold, and down to the floor, which is clamped to [0, peak]."""
    t, peak = col(seconds), col(peak)
    low = F.greatest(F.least(col(floor), peak), F.lit(0.0))
    end = rise_s + hold_s
    level = F.when(t < rise_s, peak * F.greatest(t, F.lit(0.0)) / rise_s).when(t <= end, peak).when(t < end + fall_s, peak - (peak - low) * (t - end) / fall_s).otherwise(low)
    return F.when(t.isNotNull() & peak.isNotNull(), F.greatest(level, F.when(t < rise_s, F.lit(0.0)).otherwise(low)))


def backwater_stage(stage: Value, discharge: Value, bankfull: Value, share: Value = BACKWATER_SHARE, rate: Value = BACKWATER_RATE) -> Column:
    """Stage plus the backwater of the discharge over bankfull."""
    extra = col(share) * (col(discharge) - col(bankfull)) * col(rate)
    return F.when(extra.isNotNull(), col(stage) + F.greatest(extra, F.lit(0.0)))


def anchored_level(base: Value, reference: Value, warming: Value, reference_warming: Value, cap: Value = 0.5) -> Column:
    """Level between a baseline and a reference scenario in proportion to warming, capped."""
    x = col(base) + (col(reference) - col(base)) * col(warming) / col(reference_warming)
    return F.when(x.isNotNull(), F.least(x, col(cap)))
