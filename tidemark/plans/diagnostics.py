"""Diagnostics over finished runs: sensitivity, trade-offs, catchment areas, over-ponding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.graph import accumulation, d8, flow_edges
from tidemark.operators.grid import id_parts, keys
from tidemark.operators.ponding import catchment_supply, inventory
from tidemark.operators.scoring import contingency, windows
from tidemark.operators.terrain import filled_surface
from tidemark.sources.storage import by_merge, cut_cells


def threshold_sensitivity(cells: DataFrame, thresholds: tuple[float, ...], *by: str, depth: str = "depth") -> DataFrame:
    """Cells deeper than each threshold and their share of the wet ones, in one aggregation."""
    d = F.col(depth)
    counts = cells.groupBy(*by).agg(F.count_if(d > 0).alias("wet"), F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(d > t).alias("cells")) for t in thresholds]).alias("t"))
    each = counts.select(*by, "wet", F.explode("t").alias("t")).select(*by, "t.threshold", "t.cells", "wet")
    return each.withColumn("share", F.col("cells") / F.when(F.col("wet") > 0, F.col("wet"))).drop("wet")


def depression_sweep(cells: DataFrame, runoff: Column, thresholds: tuple[float, ...], z: str = "z", max_depth: float = 3.0, min_cells: int = 9, cell_area_m2: float = 900.0) -> DataFrame:
    """Per least depth of a depression that counts: how many count, their footprint, the share of all runoff they catch and their median depth.

    The surface is filled, labelled and routed once; the thresholds share one
    table of depressions, of which each row goes to the thresholds it passes.
    """
    k = keys(cells)
    surface = cut_cells(filled_surface(cells, z))
    inside, found = inventory(surface, cell_area_m2, min(thresholds), max_depth, min_cells)
    inside = cut_cells(inside)
    depth = inside.join(surface.select(*k, "filled"), k).groupBy("dep").agg(F.max(F.col("filled") - F.col("z")).alias("depth"))
    known = cells.where(F.col(z).isNotNull())
    caught = catchment_supply(known, d8(cells, z), inside, runoff)
    every = known.agg(F.sum(F.coalesce(runoff, F.lit(0.0))).alias("every"))
    table = cut_cells(found.select("dep", "n_cells").join(depth, "dep").join(caught, "dep", "left"))
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    passed = table.withColumn("threshold", F.explode(F.filter(steps, lambda t: F.col("depth") >= t)))
    sums = passed.groupBy("threshold").agg(F.count("*").alias("depressions"), F.sum("n_cells").alias("n"), F.sum("supply").alias("caught"), F.median("depth").alias("median_depth_m"))
    # a row a threshold, and one of the total
    asked = cells.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double").join(every)
    told = asked.join(sums, "threshold", "left")
    share = F.when(F.col("every") > 0, F.coalesce("caught", F.lit(0.0)) / F.when(F.col("every") > 0, F.col("every"))).otherwise(0.0)
    return told.select("threshold", F.coalesce("depressions", F.lit(0)).cast("long").alias("depressions"), (F.coalesce("n", F.lit(0)) * F.lit(cell_area_m2) / 1e6).alias("footprint_km2"), share.alias("caught"), "median_depth_m")


def extent_tradeoff(cells: DataFrame, stages: tuple[float, ...], observed: str, hand: str = "hand", cell_area_m2: float = 900.0) -> DataFrame:
    """Extent, hit rate and false-alarm ratio of the ground below each stage over the drainage."""
    at = F.explode(F.array(*[F.lit(float(s)) for s in stages]))
    masks = cells.select(at.alias("stage"), F.col(hand).alias("h"), F.col(observed).alias("observed")).withColumn("modelled", F.col("h") < F.col("stage"))
    found = contingency(masks, "stage", cell_area_m2=cell_area_m2)
    return found.withColumn("extent_km2", (F.col("tp") + F.col("fp")) * F.lit(cell_area_m2) / 1e6)


def area_at_points(points: DataFrame, directions: DataFrame, half: int, cell_area_m2: float = 900.0) -> DataFrame:
    """Points with the largest upstream area within ``half`` cells, so that a point beside the channel finds it."""
    acc = accumulation(flow_edges(directions))
    _, row, column = id_parts(F.col("cell"))
    cells = acc.select(row.alias("row"), column.alias("col"), F.col("amount").alias("depth"))
    return windows(points, cells, half).groupBy(*points.columns).agg((F.coalesce(F.max("_d"), F.lit(0.0)) * F.lit(cell_area_m2) / 1e6).alias("area_km2"))


def over_ponding(points: DataFrame, cells: DataFrame, radius_m: float = 50.0, cell_m: float = 30.0, context: int = 11, wet: float = 0.10) -> DataFrame:
    """Per point its wettest cell within the radius, and whether that is a lower cell beside it, a pit in the terrain, or a depression.

    ``drop`` is how far the cell lies below the point's own, ``pit`` how far
    below the median of the ground around.  Points without a wet cell are left
    out.
    """
    half = int(-(-radius_m // cell_m))
    at = F.struct("row", "col", "z", "depth").alias("cell")
    steps = lambda n: F.explode(F.sequence(F.lit(-n), F.lit(n)))

    def around(n: int) -> DataFrame:
        asks = points.select("label", "row", "col").withColumn("dr", steps(n)).withColumn("dc", steps(n))
        placed = asks.select("label", "dr", "dc", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
        return by_merge(placed).join(cells.select("row", "col", "z", "depth"), ["row", "col"])

    distance = F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) * cell_m
    near = around(half).withColumn("distance", distance).where((F.col("distance") <= radius_m) & (F.col("depth") > wet))
    first = Window.partitionBy("label").orderBy(F.desc("depth"), "row", "col")
    best = near.select("label", "distance", at, F.row_number().over(first).alias("n")).where("n = 1")
    ground = around(context).groupBy("label").agg(F.median("z").alias("median"))
    own = points.select("label", "row", "col").join(cells.select("row", "col", F.col("z").alias("pin")), ["row", "col"], "left").select("label", "pin")
    told = best.join(ground, "label").join(own, "label").select("label", F.col("cell.depth").alias("depth"), "distance", (F.col("pin") - F.col("cell.z")).alias("drop"), (F.col("median") - F.col("cell.z")).alias("pit"))
    verdict: Column = F.when((F.col("distance") > cell_m) & (F.col("drop") > 5), "radius").when((F.col("pit") > F.col("depth")) & (F.col("distance") <= cell_m), "pit").otherwise("depression")
    return told.withColumn("verdict", verdict)
