"""Fill-and-spill ponding: depressions, their supply, the spill cascade and depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cascade import acyclic, settled
from tidemark.operators.graph import d8, flow_edges, label_components, terminals
from tidemark.operators.grid import keys, with_id
from tidemark.operators.hypsometry import curves, levels_of
from tidemark.operators.terrain import conditioned_directions, filled_surface
from tidemark.sources.storage import cut_cells, cut_round

#: Depth limits in metres and least size in cells of a depression that counts; wet depth.
MIN_DEPTH, MAX_DEPTH, MIN_CELLS, WET = 0.5, 3.0, 9, 0.05


def inventory(surface: DataFrame, cell_area: float, min_depth: float = MIN_DEPTH, max_depth: float = MAX_DEPTH, min_cells: int = MIN_CELLS) -> tuple[DataFrame, DataFrame]:
    """(cells, depressions) of a surface with z and ``filled``.

    cells: keys, z, ``dep``.  depressions: dep, pour_elev, capacity_m3 and
    n_cells.  ``dep`` is the number of the depression's first cell.
    """
    k = keys(surface)
    labels = cut_cells(label_components(surface, F.col("filled") - F.col("z") > 0))
    inside = surface.join(labels, k)
    pour = F.max("filled")
    found = inside.groupBy(F.col("label").alias("dep")).agg(pour.alias("pour_elev"), F.sum(F.greatest(F.col("filled") - F.col("z"), F.lit(0.0))).alias("volume"), F.count("*").alias("n_cells"), F.max(F.col("filled") - F.col("z")).alias("depth"))
    kept = cut_cells(found.where((F.col("n_cells") >= min_cells) & F.col("depth").between(min_depth, max_depth)).select("dep", "pour_elev", (F.col("volume") * cell_area).alias("capacity_m3"), "n_cells"))
    cells = inside.select(*k, "z", F.col("label").alias("dep")).join(kept.select("dep"), "dep", "left_semi")
    return cells, kept


def catchment_supply(cells: DataFrame, directions: DataFrame, depression_cells: DataFrame, runoff: Column) -> DataFrame:
    """(dep, supply): the runoff of all cells whose descent ends in a depression's cell."""
    ends = terminals(flow_edges(directions))
    gives = with_id(cells).select("cell", F.coalesce(runoff, F.lit(0.0)).alias("w"))
    pits = with_id(depression_cells).select(F.col("cell").alias("terminal"), "dep")
    # sums per terminal first, so that the join meets one row per pit
    by_end = ends.join(gives, "cell").groupBy("terminal").agg(F.sum("w").alias("w"))
    return by_end.join(pits, "terminal").groupBy("dep").agg(F.sum("w").alias("supply"))


def spill_graph(depressions: DataFrame, depression_cells: DataFrame, conditioned: DataFrame, stops: DataFrame) -> DataFrame:
    """(dep, spill_to): the first other depression down the conditioned path from a depression's first cell.

    Null where the path first meets a stop cell (sea or river) outside other
    depressions, leaves the grid or ends.  Paths are followed by pointer
    doubling over cells, each pausing where it enters a depression or meets a
    stop; the few that come back into their own depression go on from there.
    """
    edges = flow_edges(conditioned)
    own = with_id(depression_cells).select("cell", "dep")
    stop = with_id(stops).select("cell").distinct().withColumn("stop", F.lit(True))
    at = cut_cells(edges.join(own, "cell", "left").join(stop, "cell", "left").select("cell", "next", "dep", F.coalesce("stop", F.lit(False)).alias("stop")))
    ahead = at.select(F.col("cell").alias("next"), F.col("dep").alias("next_dep"))
    # a path pauses at a stop, and before a cell of a depression that its own cell is not of
    enters = F.col("next_dep").isNotNull() & ~F.col("next_dep").eqNullSafe(F.col("dep"))
    pauses = F.col("stop") | enters | (F.col("next") == F.col("cell"))
    ways = at.join(ahead, "next").select("cell", "next", F.when(pauses, F.col("cell")).otherwise(F.col("next")).alias("to"), F.when(enters & ~F.col("stop"), F.col("next_dep")).alias("found"))
    ways = cut_cells(ways)
    ends = cut_cells(terminals(ways.select("cell", F.col("to").alias("next"))).join(ways.select(F.col("cell").alias("terminal"), F.col("next").alias("entered"), "found"), "terminal", "left").select("cell", "entered", "found"))
    walks = cut_cells(depressions.select("dep", F.col("dep").alias("cell")).join(ends, "cell", "left").select("dep", "entered", "found"))
    while True:
        back = walks.where("found = dep")
        if back.isEmpty():
            return walks.select("dep", F.col("found").alias("spill_to"))
        again = back.select("dep", F.col("entered").alias("cell")).join(ends, "cell", "left").select("dep", "entered", "found")
        walks = cut_round(walks.where("found is null or found <> dep").unionByName(again))


def fill_level(beds: Column, pour: Column, area: float, supply: Column) -> Column:
    """Level at which the sorted beds hold the supply, at most the pour height; the lowest bed without supply."""
    need = supply / F.lit(area)
    # over the first i beds the level is (need + their sum) / i, valid once the next bed is not under it
    steps = F.aggregate(
        beds,
        F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("level")),
        lambda s, bed: F.struct(
            F.when(s["level"].isNull() | (bed < s["level"]), s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when(s["level"].isNull() | (bed < s["level"]), s["sum"] + bed).otherwise(s["sum"]).alias("sum"),
            F.when(s["level"].isNull() | (bed < s["level"]), (need + s["sum"] + bed) / (s["n"] + 1)).otherwise(s["level"]).alias("level"),
        ),
        lambda s: s["level"],
    )
    return F.when(supply <= 0, F.array_min(beds)).otherwise(F.least(steps, pour))


def cascade(depressions: DataFrame, spill: DataFrame, supply: DataFrame, by: str | None = None) -> DataFrame:
    """(dep, inflow, full): water that reaches each depression from its catchment and from those above that overflow.

    Depressions that spill into one another form trees, which are contracted;
    members of cycles are settled by number, and what reaches one already
    settled is lost.  ``by`` names a column of ``supply`` (such as the return
    period) that separates runs.
    """
    extra = [by] if by else []
    base = depressions.select("dep", F.col("capacity_m3").alias("capacity"))
    if by:
        # one row a return period
        base = base.join(F.broadcast(supply.select(by).distinct()))
    nodes = base.join(supply, ["dep", *extra], "left").select(*extra, "dep", "capacity", F.coalesce("supply", F.lit(0.0)).alias("water"))
    found = settled(nodes, acyclic(spill, depressions), extra)
    return found.select(*extra, "dep", "inflow", (F.col("inflow") >= F.col("capacity")).alias("full"))


def levels(depressions: DataFrame, inflow: DataFrame, cell_area: float) -> DataFrame:
    """``inflow`` with ``level`` for depressions that carry their sorted ``beds``: the pour height where full, else the hypsometric level."""
    beds = depressions.select("dep", "pour_elev", "beds")
    level = F.when(F.col("full"), F.col("pour_elev")).otherwise(fill_level(F.col("beds"), F.col("pour_elev"), cell_area, F.col("inflow")))
    return inflow.join(beds, "dep").withColumn("level", level).drop("beds", "pour_elev")


def curve_levels(depressions: DataFrame, curve: DataFrame, inflow: DataFrame, cell_area: float) -> DataFrame:
    """As ``levels``, from the table of hypsometric curves, however large a depression is."""
    pours = depressions.select("dep", "pour_elev")
    part = levels_of(curve, inflow.where("not full"), cell_area, "inflow").join(pours, "dep").withColumn("level", F.least("level", "pour_elev"))
    full = inflow.where("full").join(pours, "dep").withColumn("level", F.col("pour_elev"))
    return part.unionByName(full).drop("pour_elev")


def topography(cells: DataFrame, stops: DataFrame, cell_area: float = 900.0, z: str = "z", **limits) -> dict[str, DataFrame]:
    """What every return period shares: surface, directions, depressions, their cells and curves, spill graph."""
    surface = cut_cells(filled_surface(cells, z))
    inside, depressions = inventory(surface, cell_area, **limits)
    inside = cut_cells(inside)
    spill = cut_cells(spill_graph(depressions, inside, conditioned_directions(cells, z, surface=surface), stops))
    return {"surface": surface, "directions": cut_cells(d8(cells, z)), "cells": inside, "depressions": depressions, "spill": spill, "curves": curves(inside, cell_area)}


def route(topo: dict[str, DataFrame], excess: DataFrame, runoff: Column | float = 1.0, cell_area: float = 900.0, wet: float = WET, by: str = "return_period") -> DataFrame:
    """Keys, ``by`` and depth for each row of ``excess`` (``by``, excess_m).

    Supply is linear in the excess, so one pass over the flow paths serves all
    return periods.
    """
    share = runoff if isinstance(runoff, Column) else F.lit(float(runoff))
    unit = cut_cells(catchment_supply(topo["surface"], topo["directions"], topo["cells"], F.when(F.col("z").isNotNull(), F.coalesce(share, F.lit(0.0)) * cell_area)))
    supply = unit.join(F.broadcast(excess)).select("dep", by, (F.col("supply") * F.col("excess_m")).alias("supply"))
    level = cut_cells(curve_levels(topo["depressions"], topo["curves"], cascade(topo["depressions"], topo["spill"], supply, by), cell_area))
    k = keys(topo["surface"])
    depth = F.greatest(F.col("level") - F.col("z"), F.lit(0.0))
    wetted = topo["cells"].join(level.select("dep", by, "level"), "dep").select(*k, by, F.when(depth < wet, 0.0).otherwise(depth).alias("depth"))
    everywhere = topo["surface"].select(*k, "z").join(F.broadcast(excess.select(by)))
    return everywhere.join(wetted, [*k, by], "left").select(*k, by, F.when(F.col("z").isNotNull(), F.coalesce("depth", F.lit(0.0))).alias("depth"))
