"""The multi-hazard run: depths of all hazards, severity, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.depth import bathtub, hand_depth, lumped_ponding, zeroed
from tidemark.operators.graph import flood_fill, marked
from tidemark.operators.grid import keys
from tidemark.operators.zonal import depth_summary, severity_areas

#: Return period whose fluvial stage counts as bankfull.
BANKFULL_RP = 10


def coastal_depths(cells: DataFrame, levels: DataFrame, on_border: Column, connectivity: int = 8) -> DataFrame:
    """Bathtub depths of each coastal level, kept where the water is connected to the border at that level.

    Levels are a short table; each labels its own wet cells, as one grid of
    that number.
    """
    k = keys(cells)
    each = cells.join(F.broadcast(levels.where("hazard_type = 'coastal'"))).withColumn("depth", bathtub("z", "water_level_m"))
    flooded = flood_fill(each.withColumn("grid", F.col("return_period")), F.col("depth") > 0, connectivity, on_border=on_border)
    wet = flooded.select(F.col("grid").alias("return_period"), *[c for c in k if c != "grid"]).withColumn("reached", F.lit(True))
    joined = each.join(wet, ["return_period", *[c for c in k if c != "grid"]], "left")
    return joined.withColumn("depth", F.when(F.col("depth").isNotNull(), F.when(F.coalesce("reached", F.lit(False)), F.col("depth")).otherwise(0.0))).drop("reached")


def fluvial_depths(cells: DataFrame, levels: DataFrame, bankfull_rp: int = BANKFULL_RP, river: str | None = None) -> DataFrame:
    """Depth over the height above drainage of the stage less that of the bankfull return period; channels are dry."""
    own = levels.where("hazard_type = 'fluvial'")
    base = own.where(F.col("return_period") == bankfull_rp).select("scenario", "horizon", F.col("water_level_m").alias("bankfull"))
    net = own.join(F.broadcast(base), ["scenario", "horizon"]).withColumn("stage", F.greatest(F.col("water_level_m") - F.col("bankfull"), F.lit(0.0))).drop("bankfull")
    out = cells.join(F.broadcast(net)).withColumn("depth", hand_depth("hand", "stage")).drop("stage")
    return out if river is None else out.withColumn("depth", zeroed("depth", F.col(river)))


def pluvial_depths(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Excess rain ponding in depressions of the filled surface."""
    return cells.join(F.broadcast(levels.where("hazard_type = 'pluvial'"))).withColumn("depth", lumped_ponding("z", "filled", "water_level_m"))


def routed_depths(cells: DataFrame, levels: DataFrame, stops: Column, **limits) -> DataFrame:
    """Excess rain filled into depressions and spilled from one to the next, down to cells that are ``stops``."""
    from tidemark.operators import ponding

    k = keys(cells)
    own = levels.where("hazard_type = 'pluvial'")
    topo = ponding.topography(cells.select(*k, "z"), cells.where(F.coalesce(stops, F.lit(False))).select(*k), **limits)
    depths = ponding.route(topo, own.select("return_period", F.col("water_level_m").alias("excess_m")))
    return depths.select(*k, "return_period", "depth").join(F.broadcast(own), "return_period")


def rained_depths(cells: DataFrame, levels: DataFrame, outlet: Column, n: float = 0.05, **options) -> DataFrame:
    """Peak depths of net rain that runs off over the ground, one solve for each return period."""
    from tidemark.operators.solver import rain_on_grid

    own = levels.where("hazard_type = 'pluvial'")
    runs = cells.withColumn("outlet", F.coalesce(outlet, F.lit(False))).select("row", "col", "z", "outlet").join(F.broadcast(own.select("return_period", F.col("water_level_m").alias("net_rain")))).withColumn("n", F.lit(n))
    return rain_on_grid(runs, **options).select("row", "col", "return_period", "depth").join(F.broadcast(own), "return_period")


def surged_depths(cells: DataFrame, levels: DataFrame, boundary: Column, **options) -> DataFrame:
    """Peak depths of sea water that comes in over boundary cells at each coastal level, each return period from the one before."""
    from tidemark.operators.solver import inertial

    own = levels.where("hazard_type = 'coastal'")
    start = cells.withColumn("boundary", F.coalesce(boundary, F.lit(False))).select("row", "col", "z", "boundary")
    runs = start.join(F.broadcast(own.select("return_period", "scenario", F.col("water_level_m").alias("level")))).withColumns({"floor": F.lit(0.0), "start": F.lit(0.0)})
    return inertial(runs, **options).select("row", "col", "scenario", "return_period", "depth").join(F.broadcast(own), ["scenario", "return_period"])


def multihazard_depths(
    cells: DataFrame, levels: DataFrame, on_border: Column, sea: str | None = None, river: str | None = None, coastal: str = "bathtub", pluvial: str = "ponding", options: dict[str, dict] | None = None
) -> DataFrame:
    """hazard_type, return_period, scenario, horizon, water_level_m, keys and depth for every level.

    ``cells`` has z, hand and filled.  ``coastal`` is bathtub or inertial,
    ``pluvial`` ponding, fill_spill or rain_on_grid; ``options`` holds keyword
    arguments by those names.  Water leaves over river cells, or where there
    are none over the border.  Sea cells are dry, no data stays.
    """
    given, outlet = options or {}, on_border if river is None else F.col(river)
    ways = {
        "bathtub": lambda: coastal_depths(cells, levels, on_border), "inertial": lambda: surged_depths(cells, levels, on_border, **given.get("inertial", {})), "ponding": lambda: pluvial_depths(cells, levels),
        "fill_spill": lambda: routed_depths(cells, levels, outlet, **given.get("fill_spill", {})), "rain_on_grid": lambda: rained_depths(cells, levels, outlet, **given.get("rain_on_grid", {})),
    }
    if coastal not in ("bathtub", "inertial") or pluvial not in ("ponding", "fill_spill", "rain_on_grid"):
        raise ValueError("coastal must be bathtub or inertial; pluvial ponding, fill_spill or rain_on_grid")
    parts = [ways[coastal](), fluvial_depths(cells, levels, river=river), ways[pluvial]()]
    k = keys(cells)
    wanted = ["hazard_type", "return_period", "scenario", "horizon", "water_level_m", *k]
    first, *rest = [p.select(*wanted, "depth") for p in parts]
    for p in rest:
        first = first.unionByName(p)
    return first if sea is None else first.join(cells.select(*k, sea), k).withColumn("depth", zeroed("depth", F.col(sea))).drop(sea)


def summary(depths: DataFrame, cell_area_m2: float = 900.0) -> DataFrame:
    """One row per hazard, return period, scenario and horizon, in one aggregation."""
    by = ["hazard_type", "return_period", "scenario", "horizon", "water_level_m"]
    a, b = depth_summary(depths, *by, cell_area_m2=cell_area_m2), severity_areas(depths, *by, cell_area_m2=cell_area_m2)
    return a.join(b, by)


def single_scenario(cells: DataFrame, level: float, on_border: Column, connectivity: int = 8) -> DataFrame:
    """Keys, z and connected bathtub depth of one level."""
    wet = cells.withColumn("depth", bathtub("z", level))
    found = flood_fill(wet, F.col("depth") > 0, connectivity, on_border=on_border)
    return marked(wet, found, "_in").withColumn("depth", F.when(F.col("depth").isNotNull(), F.when(F.col("_in"), F.col("depth")).otherwise(0.0))).drop("_in")


def riverine_run(cells: DataFrame, source: Column, overbank_m: float, lowest: float = -3.0, **options) -> DataFrame:
    """Keys and peak depth of water that leaves channels standing ``overbank_m`` over their beds, by the inertial solver.

    Ground under ``lowest`` counts as that; channel cells themselves are dry,
    cells without ground null.
    """
    from tidemark.operators.solver import inertial

    k = keys(cells)
    ground = cells.select(*k, F.when(F.col("z").isNotNull(), F.greatest("z", F.lit(lowest))).alias("z"), F.coalesce(source & F.col("z").isNotNull(), F.lit(False)).alias("boundary"))
    run = ground.withColumns({"scenario": F.lit("river"), "return_period": F.lit(0), "level": F.when(F.col("boundary"), F.col("z") + overbank_m).otherwise(0.0), "floor": F.lit(0.0), "start": F.lit(0.0)})
    peak = inertial(run, **options).select(*[c for c in k if c != "grid"], "depth")
    out = ground.join(peak, [c for c in k if c != "grid"], "left")
    return out.select(*k, F.when(F.col("z").isNotNull(), F.when(F.col("boundary"), 0.0).otherwise(F.coalesce("depth", F.lit(0.0)))).alias("depth"))
