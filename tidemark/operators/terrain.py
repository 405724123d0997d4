"""Terrain conditioning: filled surfaces, flow across flats, depitting, wetness.

The filled surface is the smallest height at which each cell can drain to the
outside.  Cells are first gathered into basins by their descent; only the
lowest passes between neighbouring basins matter from then on, a table of a few
rows per basin, over which spill heights are relaxed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.flats import TILE, flat_distances
from tidemark.operators.graph import FLOW, accumulation, d8, flow_edges, hand, label_components, marked, terminals
from tidemark.operators.grid import OFFSETS, keys, reached, with_id
from tidemark.sources.storage import by_merge, cut_cells, cut_round

#: Number of the basin that stands for everything outside the grid.
OUTSIDE = -1
#: Up to so many passes one task does the work of the rounds; the result is the same.
SMALL = 20_000


def _on_edge(cells: DataFrame, z: str) -> DataFrame:
    """Keys of known cells with fewer than eight known neighbours: they drain outwards."""
    k = keys(cells)
    known = cells.where(F.col(z).isNotNull()).select(*k)
    around = reached(known, OFFSETS).groupBy(*k).agg(F.count("*").alias("n"))
    return known.join(around, k, "left").where(F.coalesce("n", F.lit(0)) < 8).select(*k)


def filled_surface(cells: DataFrame, z: str = "z") -> DataFrame:
    """Keys, z and ``filled`` of every cell; no-data cells stay null and let water out."""
    k = keys(cells)
    known = with_id(cells.where(F.col(z).isNotNull()).select(*k, F.col(z).alias("z")))
    ends = terminals(flow_edges(d8(cells, z)))
    at = cut_cells(known.join(ends, "cell").select(*k, "cell", "z", F.col("terminal").alias("basin")))
    sent = reached(at, OFFSETS, F.col("basin").alias("other"), F.col("z").alias("zo"))
    inner = sent.join(at, k).where("basin <> other").select("basin", "other", F.greatest("z", "zo").alias("height"))
    out = at.join(_on_edge(cells, z), k, "left_semi").select("basin", F.lit(OUTSIDE).cast("long").alias("other"), F.col("z").alias("height"))
    passes = cut_cells(inner.union(out).groupBy("basin", "other").agg(F.min("height").alias("height")))
    full = at.join(spill_levels(passes), "basin", "left").select(*k, F.greatest("z", "level").alias("filled"))
    # who asks for filled cells alone makes this an inner join, which may send either side
    return by_merge(cells.select(*k, F.col(z).alias("z"))).join(full, k, "left")


def _flooded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``spill_levels``, for a small table in one task: water rises from the outside, always over the lowest pass."""
    ways: dict[int, list[tuple[float, int]]] = {}
    for batch in batches:
        for a, b, height in zip(*(batch[c].to_pylist() for c in ("a", "b", "height"))):
            ways.setdefault(b, []).append((height, a))
            ways.setdefault(a, [])
    level: dict[int, float] = {}
    waiting = [(float("-inf"), OUTSIDE)] if OUTSIDE in ways else []
    while waiting:
        height, basin = heapq.heappop(waiting)
        if basin not in level:
            level[basin] = height
            for pass_height, other in ways[basin]:
                if other not in level:
                    heapq.heappush(waiting, (max(height, pass_height), other))
    basins = [b for b in ways if b != OUTSIDE]
    yield pa.RecordBatch.from_arrays([pa.array(basins, pa.int64()), pa.array([level.get(b) for b in basins], pa.float64())], names=["basin", "level"])


def spill_levels(passes: DataFrame) -> DataFrame:
    """(basin, level): the lowest water level at which each basin reaches the outside, from passes (basin, other, height) in both directions.

    As in Boruvka's spanning trees: every group of basins takes its lowest
    pass, groups that these join become one, and half of them at most are left.
    Seen from the group's root no way within it stands higher than a pass out
    of it, so a basin's level is the highest pass that its groups have taken.
    """
    edges = cut_cells(passes.select(F.col("basin").alias("a"), F.col("other").alias("b"), "height"))
    if edges.limit(SMALL + 1).count() <= SMALL:
        return cut_cells(edges.coalesce(1).mapInArrow(_flooded, "basin long, level double"))
    held = cut_cells(passes.select("basin", F.col("basin").alias("root"), F.lit(None).cast("double").alias("level")).distinct())
    while not edges.isEmpty():
        first = F.min(F.struct("height", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
        taken = cut_cells(edges.groupBy("a").agg(first.alias("m")).select("a", (F.col("m.lo") + F.col("m.hi") - F.col("a")).alias("next"), F.col("m.height").alias("height")))
        # of two groups that take the same pass the smaller is the root
        back = taken.select(F.col("a").alias("next"), F.col("next").alias("back"))
        turned = taken.join(back, "next", "left").withColumn("root", (F.col("back") == F.col("a")) & (F.col("a") < F.col("next")))
        steps = cut_cells(turned.select("a", F.when(F.col("root"), F.col("a")).otherwise(F.col("next")).alias("next"), F.when(~F.coalesce("root", F.lit(False)), F.col("height")).alias("height")))
        outside = steps.sparkSession.range(1).select(F.lit(OUTSIDE).cast("long").alias("cell"), F.lit(OUTSIDE).cast("long").alias("next"))
        roots = cut_cells(terminals(steps.select(F.col("a").alias("cell"), "next").union(outside)).select(F.col("cell").alias("g"), F.col("terminal").alias("to")))
        risen = steps.select(F.col("a").alias("root"), "height").join(roots.withColumnRenamed("g", "root"), "root")
        held = cut_round(held.join(risen, "root", "left").select("basin", F.coalesce("to", "root").alias("root"), F.greatest("level", "height").alias("level")))
        moved = edges.join(roots.select(F.col("g").alias("a"), F.col("to").alias("x")), "a").join(roots.select(F.col("g").alias("b"), F.col("to").alias("y")), "b")
        edges = cut_round(moved.where(F.col("x") != F.col("y")).where(F.col("x") != OUTSIDE).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.min("height").alias("height")))
    return held.select("basin", F.when(F.col("root") == OUTSIDE, F.col("level")).alias("level"))


def conditioned_directions(cells: DataFrame, z: str = "z", surface: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Keys and ``d8`` on the filled surface; flats drain towards their nearest outlet, -1 only at the outside.

    A cell of a flat without a lower neighbour takes the lowest direction that
    leads to a cell of the same height one step nearer to where the flat drains.
    A filled ``surface`` that is at hand is not computed again.
    """
    k = keys(cells)
    full = filled_surface(cells, z) if surface is None else surface
    surface = cut_cells(full.where("filled is not null").select(*k, "filled"))
    edge = marked(surface, _on_edge(surface, "filled"), "edge")
    flow = cut_round(edge.join(d8(surface, "filled"), k).select(*k, F.col("filled").alias("height"), "d8", ((F.col("d8") >= 0) | F.col("edge")).alias("drains")))
    waiting = flow.where("not drains").select(*k, "height")
    if waiting.isEmpty():
        return flow.select(*k, "d8")
    # of the cells that drain only those beside a waiting one matter
    beside = reached(waiting, OFFSETS, F.col("height").alias("theirs")).join(flow.where("drains").select(*k, "height"), k).where("height = theirs").select(*k, "height").distinct()
    start = waiting.withColumn("distance", F.lit(None).cast("int")).unionByName(beside.withColumn("distance", F.lit(0)))
    far = cut_cells(flat_distances(start, tile))
    sent = reached(far, tuple((-dr, -dc) for dr, dc in FLOW), F.col("height").alias("theirs"), (F.col("distance") + 1).alias("further"))
    ways = sent.join(far.where("distance > 0"), k).where("height = theirs and distance = further").groupBy(*k).agg(F.min("direction").alias("way"))
    return flow.join(ways, k, "left").select(*k, F.coalesce("way", "d8").alias("d8"))


def drainage_mask(directions: DataFrame, threshold: int = 500) -> DataFrame:
    """Keys, ``cells`` (upstream cells, own included) and ``drain`` where these reach the threshold."""
    at = with_id(directions)
    return at.join(accumulation(flow_edges(directions)), "cell").select(*keys(directions), F.col("amount").cast("long").alias("cells"), (F.col("amount") >= threshold).alias("drain"))


def hand_product(cells: DataFrame, drainage: DataFrame | None = None, threshold: int = 500, z: str = "z") -> DataFrame:
    """Keys, ``d8``, ``drain`` and ``hand``: conditioned flow, the drainage given (keys and drain) or else that of ``threshold`` cells upstream, and the height over it."""
    k = keys(cells)
    flow = cut_cells(conditioned_directions(cells, z))
    given = drainage is not None and not drainage.where("drain").isEmpty()
    mask = cut_cells(drainage.where("drain").select(*k) if given else drainage_mask(flow, threshold).where("drain").select(*k))
    at = marked(cells.select(*k, F.col(z).alias("z")), mask, "drain")
    return at.select(*k, "drain").join(flow, k, "left").join(hand(at, flow, F.col("drain")), k, "left").select(*k, "d8", "drain", "hand")


def depitted(cells: DataFrame, z: str = "z", noise: float = 0.5, deep: float | None = None, sea: float = 0.0) -> DataFrame:
    """Keys, ``z`` and ``raised``: pits shallower than ``noise`` are filled; with ``deep`` also those as deep or with a floor under the sea."""
    k = keys(cells)
    surface = cut_cells(filled_surface(cells, z))
    labels = cut_cells(label_components(surface, F.col("filled") - F.col("z") > 0))
    pits = surface.join(labels, k).groupBy("label").agg(F.max(F.col("filled") - F.col("z")).alias("depth"), F.min("z").alias("floor"))
    fill = F.col("depth") < noise
    if deep is not None:
        fill = fill | (F.col("depth") >= deep) | (F.col("floor") < sea)
    chosen = labels.join(pits.where(fill), "label", "left_semi")
    out = marked(surface, chosen, "raised")
    return out.select(*k, F.when(F.col("raised"), F.col("filled")).otherwise(F.col("z")).alias("z"), "raised")


def slope(cells: DataFrame, cell_m: float, z: str = "z") -> DataFrame:
    """Keys and ``slope``: the steepest fall to a neighbour, at least zero."""
    k = keys(cells)
    known = cells.where(F.col(z).isNotNull()).select(*k, F.col(z).alias("z"))
    sent = reached(known, tuple((-dr, -dc) for dr, dc in FLOW), F.col("z").alias("zn"))
    apart = F.when(F.col("direction").isin(0, 2, 5, 7), 2**0.5).otherwise(1.0) * cell_m
    return sent.join(known, k).groupBy(*k).agg(F.greatest(F.max((F.col("z") - F.col("zn")) / apart), F.lit(0.0)).alias("slope"))


def twi(cells: DataFrame, cell_m: float = 30.0, z: str = "z") -> DataFrame:
    """Keys and ``twi``: ln of upstream area per cell width over slope, on the conditioned surface; slopes under 0.001 count as that."""
    k = keys(cells)
    surface = cut_cells(filled_surface(cells, z))
    area = drainage_mask(conditioned_directions(cells, z, surface=surface)).select(*k, "cells")
    index = F.ln((F.col("cells") + 1) * cell_m / F.greatest(F.coalesce("slope", F.lit(0.0)), F.lit(1e-3)))
    return by_merge(cells.select(*k)).join(area.join(slope(surface.select(*k, F.col("filled").alias("z")), cell_m), k, "left").select(*k, index.alias("twi")), k, "left")


def burned_median_depitted(cells: DataFrame, channel: Column, land: Column, burn: float = 2.0, window: int = 3, **depit) -> DataFrame:
    """The conditioning chain: channels burned in, median on land, pits filled."""
    from tidemark.functions.depth import burned
    from tidemark.operators.grid import median_filtered

    low = cells.withColumn("z", burned("z", channel, burn))
    # filling reads the medians several times
    return depitted(cut_cells(median_filtered(low, "z", window, land)), "z", **depit)


def pit_sizes(cells: DataFrame, z: str = "z", smallest: float = 0.5, largest: float = 3.0, edges: tuple[int, ...] = (1, 9, 25, 100, 1000)) -> DataFrame:
    """Number and cells of depressions per size bucket, among those of plausible depth."""
    k = keys(cells)
    surface = cut_cells(filled_surface(cells, z))
    labels = label_components(surface, F.col("filled") - F.col("z") > 0)
    pits = surface.join(labels, k).groupBy("label").agg(F.count("*").alias("n"), F.max(F.col("filled") - F.col("z")).alias("depth"))
    bucket = F.element_at(F.array(*[F.lit(e) for e in edges]), F.greatest(F.lit(1), sum((F.when(F.col("n") >= e, 1).otherwise(0) for e in edges), F.lit(0))).cast("int"))
    return pits.where(F.col("depth").between(smallest, largest)).groupBy(bucket.alias("at_least")).agg(F.count("*").alias("depressions"), F.sum("n").alias("cells"))
