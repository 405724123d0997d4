"""Depth expressions on a cell's columns.  Null (no data) stays null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.hydrology import Value, col

#: Upper bounds in metres of the severity classes 1 to 3; above is 4, dry is 0, no data 255.
SEVERITY_EDGES, SEVERITY_NODATA = (0.15, 0.5, 1.0), 255
#: Land-cover class to runoff coefficient (fixed values), and what unknown classes get.
RUNOFF = {10: 0.15, 20: 0.25, 30: 0.30, 40: 0.35, 50: 0.85, 60: 0.50, 70: 0.05, 80: 1.00, 90: 0.60, 95: 0.60, 100: 0.10}
RUNOFF_OTHER = 0.40


def where_known(x: Column, value: Column) -> Column:
    return F.when(x.isNotNull(), value)


def bathtub(z: Value, level: Value) -> Column:
    """Depth of a flat water level over the ground."""
    z = col(z)
    return where_known(z, F.greatest(col(level) - z, F.lit(0.0)))


def hand_depth(hand: Value, stage: Value) -> Column:
    """Depth where the stage exceeds the height above the nearest drainage."""
    return bathtub(hand, stage)


def lumped_ponding(z: Value, filled: Value, level: Value) -> Column:
    """Water held by a depression, at most ``level`` deep."""
    z = col(z)
    return where_known(z, F.least(col(level), F.greatest(col(filled) - z, F.lit(0.0))))


def severity(depth: Value) -> Column:
    d = col(depth)
    ladder = F.when(d.isNull(), SEVERITY_NODATA).when(d <= 0, 0)
    for number, edge in enumerate(SEVERITY_EDGES, 1):
        ladder = ladder.when(d <= edge, number)
    return ladder.otherwise(len(SEVERITY_EDGES) + 1).cast("int")


def composite(*depths: Value) -> Column:
    """Deepest hazard; no data only where all have none."""
    return F.greatest(*[col(d) for d in depths])


def dominant(depths: dict[str, Value], floors: dict[str, float] | None = None) -> Column:
    """Name of the deepest hazard, ties to the first; null where none is wet.  Depths under a hazard's floor count as dry."""
    wet = []
    for number, (name, depth) in enumerate(depths.items()):
        d = F.greatest(F.coalesce(col(depth), F.lit(0.0)), F.lit(0.0))
        d = F.when(d < (floors or {}).get(name, 0.0), 0.0).otherwise(d)
        wet.append(F.struct(d.alias("d"), F.lit(-number).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*wet))
    return F.when(best["d"] > 0, best["name"])


def floored(depth: Value, floor: Value = 0.05) -> Column:
    """Depths under the floor become zero."""
    d = col(depth)
    return F.when(d < col(floor), 0.0).otherwise(d)


def capped(depth: Value, cap: Value) -> Column:
    d = col(depth)
    return where_known(d, F.least(d, col(cap)))


def coastal_capped(depth: Value, bed: Value, level: Value, margin: float = 0.2) -> Column:
    """At most the still-water depth over ground (or over sea level, below it) plus a margin."""
    return capped(depth, F.greatest(col(level) - F.greatest(col(bed), F.lit(0.0)), F.lit(0.0)) + margin)


def zeroed(depth: Value, mask: Column) -> Column:
    """Zero on masked cells (channel, sea); no data stays."""
    d = col(depth)
    return where_known(d, F.when(F.coalesce(mask, F.lit(False)), 0.0).otherwise(d))


def land_clamped(z: Value, land: Column, retain: bool = False) -> Column:
    """Land below sea level raised to zero, unless retained."""
    z = col(z)
    return z if retain else F.when(land & (z < 0), 0.0).otherwise(z)


def preflooded(z: Value, land: Column) -> Column:
    """Initial depth on land below sea level when it is not clamped."""
    z = col(z)
    return where_known(z, F.when(land & (z < 0), -z).otherwise(0.0))


def runoff_coefficient(land_cover: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RUNOFF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, land_cover.cast("int")), F.lit(RUNOFF_OTHER))


def roughness(runoff: Value | None) -> Column:
    """Manning n from the runoff coefficient, between 0.03 and 0.10; 0.05 where unknown or not positive."""
    if runoff is None:
        return F.lit(0.05)
    n = F.least(F.greatest(0.11 - 0.08 * col(runoff), F.lit(0.03)), F.lit(0.10))
    return F.when(col(runoff).isNotNull() & ~F.isnan(col(runoff)) & (n > 0), n).otherwise(0.05)


def net_rain(level: Value, runoff: Value, outlet: Column) -> Column:
    """Rain that runs off; none on outlets."""
    r = col(level) * col(runoff)
    return F.when(F.coalesce(outlet, F.lit(False)), 0.0).otherwise(r)


def burned(z: Value, channel: Column, by: Value) -> Column:
    """Channels lowered."""
    z = col(z)
    return F.when(F.coalesce(channel, F.lit(False)), z - col(by)).otherwise(z)


def crested(z: Value, crest: Value) -> Column:
    """Ground raised to a crest; where there is no crest (null) it stays."""
    z = col(z)
    return where_known(z, F.greatest(z, col(crest)))


def protected(depth: Value, inside: Column, crest: Value, level: Value, attenuation: Value) -> Column:
    """Inside a defended polygon: dry if the crest holds the level, else attenuated; no data stays."""
    d = col(depth)
    held = F.when(col(crest) >= col(level), 0.0).otherwise(d * col(attenuation))
    return where_known(d, F.when(F.coalesce(inside, F.lit(False)), held).otherwise(d))


def present_day(depth: Value, sea_level_rise: Value) -> Column:
    d = col(depth)
    return where_known(d, F.greatest(d - col(sea_level_rise), F.lit(0.0)))


def banded(depth: Value, edges: tuple[float, ...]) -> Column:
    """Number of the display band: how many edges the depth reaches."""
    d = col(depth)
    return where_known(d, reduce(lambda a, b: a + b, [F.when(d >= e, 1).otherwise(0) for e in edges], F.lit(0)))


def decoded(value: Value, *sentinels: float) -> Column:
    """Stored no-data values and NaN read as null."""
    v = col(value)
    return F.when(~F.isnan(v) & ~v.isin(*[float(s) for s in sentinels]) if sentinels else ~F.isnan(v), v)
