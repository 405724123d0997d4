"""Aggregates over cells: depth summaries, percentiles, flags, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.depth import severity
from tidemark.operators.grid import keys

#: Decimals to which indices are told apart.
TIE = 9


def depth_summary(cells: DataFrame, *by: str, depth: str = "depth", cell_area_m2: float = 900.0) -> DataFrame:
    """Per group: flooded area, mean and largest depth of wet cells, their number; zeros where none is wet."""
    wet = F.col(depth) > 0
    n = F.count_if(wet)
    return cells.groupBy(*by).agg(
        (n * F.lit(cell_area_m2)).cast("double").alias("flooded_area_m2"),
        (n * F.lit(cell_area_m2) / 1e6).cast("double").alias("flooded_area_km2"),
        F.coalesce(F.avg(F.when(wet, F.col(depth))), F.lit(0.0)).alias("mean_depth_m"),
        F.coalesce(F.max(F.when(wet, F.col(depth))), F.lit(0.0)).alias("max_depth_m"),
        n.alias("wet_pixels"),
    )


def severity_areas(cells: DataFrame, *by: str, depth: str = "depth", cell_area_m2: float = 900.0) -> DataFrame:
    """km2 per severity class."""
    s = severity(depth)
    return cells.groupBy(*by).agg(*[(F.count_if(s == i) * F.lit(cell_area_m2) / 1e6).cast("double").alias(f"{name}_area_km2") for i, name in enumerate(("minor", "moderate", "major", "severe"), 1)])


def composite_max(stack: DataFrame, depth: str = "depth") -> DataFrame:
    """Per cell the deepest of all layers; null only where all are."""
    return stack.groupBy(*keys(stack)).agg(F.max(depth).alias(depth))


def mosaic(sources: list[DataFrame], depth: str = "depth") -> DataFrame:
    """Grids already on one reference, combined by the larger known value."""
    first, *rest = [s.select(*keys(s), depth) for s in sources]
    for s in rest:
        first = first.unionByName(s)
    return composite_max(first, depth)


def depth_percentiles(stack: DataFrame, percents: list[float], depth: str = "depth") -> DataFrame:
    """Per cell exact percentiles over the layers; no data counts as dry unless all layers lack data."""
    known = F.count(depth) > 0
    p = F.percentile(F.coalesce(F.col(depth), F.lit(0.0)), F.array(*[F.lit(x / 100) for x in percents]))
    found = stack.groupBy(*keys(stack)).agg(F.when(known, p).alias("p"))
    return found.select(*keys(stack), *[F.col("p")[i].alias(f"p{x:g}".replace(".", "_")) for i, x in enumerate(percents)])


def quantile_flag(cells: DataFrame, index: str, fraction: float, depth: float) -> DataFrame:
    """Cells in the top ``fraction`` of an index get a constant depth, other known cells zero; fraction 0 flags none.

    Indices that agree to TIE decimals are a tie: means of the same heights
    differ in their last bits by the order in which they were summed, and
    which cells are flagged must not follow from how the table is partitioned.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    known = F.col(index).isNotNull()
    if fraction == 0:
        return cells.select(*keys(cells), F.when(known, 0.0).alias("depth"))
    even = F.round(index, TIE)
    cut = cells.agg(F.round(F.percentile(even, F.lit(1 - fraction)), TIE).alias("cut"))
    return cells.join(F.broadcast(cut)).select(*keys(cells), F.when(known, F.when(even >= F.col("cut"), depth).otherwise(0.0)).alias("depth"))


def area_over(cells: DataFrame, threshold: float, *by: str, depth: str = "depth", cell_area_m2: float = 900.0) -> DataFrame:
    """km2 deeper than a threshold."""
    return cells.groupBy(*by).agg((F.count_if(F.col(depth) > threshold) * F.lit(cell_area_m2) / 1e6).cast("double").alias("area_km2"))


def bias_factor(modelled: Column, observed: Column) -> Column:
    """Modelled over observed area; null without an observed area."""
    return modelled / F.when(observed > 0, observed)


def median_change(scenes: DataFrame, threshold: float, value: str = "backscatter") -> DataFrame:
    """Flooded where, in any orbit, the median during the event falls under that before by more than the threshold.

    ``scenes`` has row, col, orbit, event (boolean) and the value; the
    threshold is negative.
    """
    k = keys(scenes)
    medians = scenes.groupBy(*k, "orbit").agg(F.median(F.when(F.col("event"), F.col(value))).alias("during"), F.median(F.when(~F.col("event"), F.col(value))).alias("before"))
    return medians.groupBy(*k).agg(F.bool_or(F.coalesce(F.col("during") - F.col("before") < threshold, F.lit(False))).alias("flood"))


def otsu_threshold(values: DataFrame, value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """One row: the bin edge that separates a histogram into the two classes of largest variance between them."""
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = values.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumn("m", F.col("n") * (low + (F.col("bin") + 0.5) * width))
    # at most ``bins`` rows from here on
    upto, everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = counts.select("bin", F.sum("n").over(upto).alias("n1"), F.sum("m").over(upto).alias("m1"), F.sum("n").over(everything).alias("n"), F.sum("m").over(everything).alias("m"))
    n2 = F.when(F.col("n") > F.col("n1"), F.col("n") - F.col("n1"))
    apart = F.col("m1") / F.col("n1") - (F.col("m") - F.col("m1")) / n2
    between = F.col("n1") * n2 * apart * apart
    return c.where(n2.isNotNull()).agg(F.max_by(low + (F.col("bin") + 1) * width, F.struct(between, -F.col("bin"))).alias("threshold"))


def flood_mosaic(passes: DataFrame, value: str = "code") -> DataFrame:
    """Several satellite passes: flooded where the largest code other than 255 is 1 or 2; null where all lack data."""
    code = F.max(F.when(F.col(value) != 255, F.col(value)))
    return passes.groupBy(*keys(passes)).agg(F.when(code.isNotNull(), code.isin(1, 2)).alias("flood"))


def corrected_for_subsidence(cells: DataFrame, bands: DataFrame, years: float, z: str = "z", lat: str = "lat") -> DataFrame:
    """Ground lowered by rate (cm a year) times years in each latitude band, lat_min < lat <= lat_max."""
    sink = F.round(F.col("rate_cm_per_year") / 100 * F.lit(years), 3)
    b = F.broadcast(bands.select("lat_min", "lat_max", sink.alias("sink")))
    return cells.join(b, (F.col(lat) > F.col("lat_min")) & (F.col(lat) <= F.col("lat_max")), "left").withColumn(z, F.col(z) - F.coalesce("sink", F.lit(0.0))).drop("lat_min", "lat_max", "sink")


def sea_restricted(cells: DataFrame, limit: float, sea: str = "sea", lat: str = "lat") -> DataFrame:
    """Cells north of the limit are not sea."""
    return cells.withColumn(sea, F.when(F.col(lat) > limit, False).otherwise(F.col(sea)))


def zones_raised(cells: DataFrame, zones: DataFrame, x: str = "x", y: str = "y", z: str = "z", overlap: str = "last") -> DataFrame:
    """Ground raised inside boxes (x_min, x_max, y_min, y_max, raise_m, zone_no).

    In overlaps the last zone wins, or the largest raise with overlap="max".
    The zone table is a short configuration, joined by range.
    """
    k = keys(cells)
    order = F.col("zone_no") if overlap == "last" else F.col("raise_m")
    inside = F.col(x).between(F.col("x_min"), F.col("x_max")) & F.col(y).between(F.col("y_min"), F.col("y_max"))
    hit = cells.select(*k, x, y).join(F.broadcast(zones), inside).groupBy(*k).agg(F.max_by("raise_m", order).alias("raise_m"))
    return cells.join(hit, k, "left").withColumn(z, F.col(z) + F.coalesce("raise_m", F.lit(0.0))).drop("raise_m")


def deepest(cells: DataFrame, n: int, *by: str, depth: str = "depth") -> DataFrame:
    """The ``n`` deepest known cells of each group with their rank, ties by row and column."""
    w = Window.partitionBy(*by).orderBy(F.desc(depth), "row", "col")
    return cells.where(F.col(depth).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
