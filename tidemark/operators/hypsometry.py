"""Hypsometric curves of depressions as tables, and the levels at which they hold a volume.

A curve has a row for each distinct bed height of a depression: how many cells
lie at or under it and the sum of their heights, hence the volume that stands
when water reaches it.  Rows are dealt into ranges of (depression, height);
sums run within a range, and what the ranges before hold is carried in, so a
depression of any size is shared by as many tasks as it has ranges.  A level is
found by an as-of join: first to the range whose volumes enclose the supply,
then to the row within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.storage import cut_cells

#: Cells in a range of heights.
RANGE_ROWS = 50_000


def curves(beds: DataFrame, cell_area: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(dep, part, z, n, total, volume, until) from ``beds`` (dep, z); z null takes no part.

    n and total count and sum the beds at or under z, ``volume`` is what stands
    when water reaches z, ``until`` the volume of the next row, null on a
    depression's last.  ``part`` names the range that holds the row; ranges
    hold about ``range_rows`` cells, or more where there are fewer tasks.
    """
    steps = cut_cells(beds.where("z is not null").select("dep", "z"))
    # heights are added cell by cell from the lowest, as one would by hand; only ranges before are added in one sum
    parts = min(int(beds.sparkSession.conf.get("spark.sql.shuffle.partitions")), steps.count() // range_rows + 1)
    # the range is stored with its rows: another run of the same plan may cut ranges elsewhere
    ranged = cut_cells(steps.repartitionByRange(parts, "dep", "z").withColumn("part", F.spark_partition_id()))
    # a row for each range that a depression reaches into
    earlier = Window.partitionBy("dep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("dep", "part").agg(F.count("*").alias("m"), F.sum("z").alias("s"))
    carried = held.select("dep", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("m0"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s0"))
    upto = Window.partitionBy("dep", "part").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.col("m0") + F.count("*").over(upto), F.col("s0") + F.sum("z").over(upto)
    each = ranged.join(carried, ["dep", "part"]).select("dep", "part", "z", n.alias("n"), total.alias("total"))
    summed = each.groupBy("dep", "part", "z").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    rising = cut_cells(summed.withColumn("volume", F.lit(cell_area) * (F.col("n") * F.col("z") - F.col("total"))))
    following = Window.partitionBy("dep").orderBy("part")
    starts = rising.groupBy("dep", "part").agg(F.min("volume").alias("first")).select("dep", "part", F.lead("first").over(following).alias("beyond"))
    ahead = F.lead("volume").over(Window.partitionBy("dep", "part").orderBy("z"))
    return cut_cells(rising.withColumn("ahead", ahead).join(starts, ["dep", "part"]).select("dep", "part", "z", "n", "total", "volume", F.coalesce("ahead", "beyond").alias("until")))


def levels_of(curve: DataFrame, asked: DataFrame, cell_area: float, supply: str = "supply") -> DataFrame:
    """``asked`` (dep, ``supply`` and other columns) with ``level``: where the water stands that the supply fills in, without an upper end.

    The lowest bed without supply; rows of depressions without a curve are left out.
    """
    ranges = curve.groupBy("dep", "part").agg(F.min("volume").alias("_from"), F.max(F.coalesce("until", F.lit(float("inf")))).alias("_to"))
    v = F.greatest(F.coalesce(F.col(supply), F.lit(0.0)), F.lit(0.0))
    # volumes start at 0 with the lowest bed alone
    within = lambda low, high: ((F.col("_v") > low) | (low == 0)) & (F.col("_v") <= high)
    placed = asked.withColumn("_v", v).join(ranges, "dep").where(within(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    rows = curve.select("dep", "part", F.col("n").alias("_n"), F.col("total").alias("_total"), F.col("volume").alias("_low"), F.coalesce("until", F.lit(float("inf"))).alias("_high"))
    found = placed.join(rows, ["dep", "part"]).where(within(F.col("_low"), F.col("_high")))
    return found.select(*asked.columns, ((F.col("_v") / F.lit(cell_area) + F.col("_total")) / F.col("_n")).alias("level"))
