"""Connectivity and flow on cell tables, by contraction and pointer doubling.

Components are labelled in two phases: within tiles by small array code, one
task per tile, and across tile borders by contracting the few links between
tile labels.  Flow paths are followed by pointer doubling, so a path of n cells
takes about log2(n) joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.components import connected_components
from tidemark.operators.grid import cell_id, keys, offsets, reached, with_id
from tidemark.sources.storage import by_merge, cut_cells, cut_round

#: Side of the tiles of the first labelling phase.
TILE = 128
#: Flow directions 0 to 7 in row-major order of the neighbours; -1 is none.
FLOW = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def tile_labels(active: np.ndarray, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Smallest flat index of each component of a small boolean array; -1 elsewhere."""
    h, w = active.shape
    label = np.where(active, np.arange(h * w).reshape(h, w), h * w)
    while True:
        padded = np.pad(label, 1, constant_values=h * w)
        near = label.copy()
        for dr, dc in steps:
            np.minimum(near, padded[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w], out=near)
        near = np.where(active, near, h * w)
        jumped = np.append(near.ravel(), h * w)[near]
        jumped = np.where(active, np.minimum(near, jumped), h * w)
        if (jumped == label).all():
            return np.where(active, label, -1)
        label = jumped


def label_components(cells: DataFrame, active: Column, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """Keys and ``label`` of every active cell: the number of the component's first cell in row-major order."""
    steps = offsets(connectivity)
    k = keys(cells)
    extra = [c for c in k if c == "grid"]
    on = cells.where(F.coalesce(active, F.lit(False))).select(*k)
    tiled = on.withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    kinds = "".join(f"{c} int, " for c in k)

    def within(group: pa.Table) -> pa.Table:
        row, column = group["row"].to_numpy(), group["col"].to_numpy()
        r0, c0 = row.min(), column.min()
        mask = np.zeros((row.max() - r0 + 1, column.max() - c0 + 1), bool)
        mask[row - r0, column - c0] = True
        label = tile_labels(mask, steps)[row - r0, column - c0]
        first_row, first_col = label // mask.shape[1] + r0, label % mask.shape[1] + c0
        return group.select(k).append_column("lr", pa.array(first_row.astype(np.int32))).append_column("lc", pa.array(first_col.astype(np.int32)))

    typed = tiled.select(*[F.col(c).cast("int") for c in k], "tr", "tc")
    labelled = typed.groupBy(*extra, "tr", "tc").applyInArrow(within, f"{kinds}lr int, lc int")
    local = cut_cells(labelled.select(*k, cell_id(F.col("grid") if extra else None, F.col("lr"), F.col("lc")).alias("local")))
    # only cells on a tile's edge can have neighbours in another tile
    at = lambda x: F.pmod(F.col(x), F.lit(tile))
    edge = local.where((at("row") == 0) | (at("row") == tile - 1) | (at("col") == 0) | (at("col") == tile - 1))
    links = reached(edge, steps, F.col("local").alias("other")).join(edge, k).where("local < other").select(F.col("local").alias("a"), F.col("other").alias("b"))
    roots = connected_components(links.distinct())
    return local.join(roots, F.col("local") == F.col("node"), "left").select(*k, F.coalesce("root", "local").alias("label"))


def flood_fill(cells: DataFrame, active: Column, connectivity: int = 8, seed: Column | None = None, on_border: Column | None = None) -> DataFrame:
    """Keys of the active cells that are reachable through active cells from active seeds.

    Without ``seed``, ``on_border`` says which cells lie on the border and are
    the seeds.
    """
    start = seed if seed is not None else on_border
    if start is None:
        raise ValueError("give seed or on_border")
    labels = cut_cells(label_components(cells, active, connectivity))
    k = keys(cells)
    seeded = cells.where(F.coalesce(active & start, F.lit(False))).select(*k).join(labels, k).select("label").distinct()
    return labels.join(seeded, "label", "left_semi").select(*k)


def marked(cells: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``cells`` with a boolean column: whether the cell is among ``found``."""
    k = keys(cells)
    return by_merge(cells).join(found.select(*k).withColumn(name, F.lit(True)), k, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def connectivity_filter(cells: DataFrame, depth: str = "depth", connectivity: int = 8, seed: Column | None = None, on_border: Column | None = None) -> DataFrame:
    """Wet cells that no seed reaches become dry."""
    kept = flood_fill(cells, F.col(depth) > 0, connectivity, seed, on_border)
    out = marked(cells, kept, "_kept")
    return out.withColumn(depth, F.when(F.col(depth).isNotNull(), F.when(F.col("_kept"), F.col(depth)).otherwise(0.0))).drop("_kept")


def sea_mask(cells: DataFrame, on_border: Column, z: str = "z", connectivity: int = 8, through_nodata: bool = True, extra_seed: Column | None = None, lake_seeds: list[tuple[Column, float]] | None = None) -> DataFrame:
    """Keys and ``sea``: low cells (z <= 0) reached from the border or extra seeds, no-data cells likewise, and lakes.

    A lake is (seed, highest elevation): cells not above it that are reached
    from the seed alone, never from the border.
    """
    low, missing = F.col(z) <= 0, F.col(z).isNull()
    start = on_border if extra_seed is None else on_border | F.coalesce(extra_seed, F.lit(False))
    found = flood_fill(cells, low, connectivity, start)
    if through_nodata:
        found = found.union(flood_fill(cells, missing, connectivity, start))
    for seed, highest in lake_seeds or []:
        found = found.union(flood_fill(cells, F.col(z) <= highest, connectivity, seed))
    return marked(cells, found.distinct(), "sea").select(*keys(cells), "sea")


def sea_code(sea: Column, z: Column) -> Column:
    """Product coding: 0 sea, 1 land, 255 no data on land."""
    return F.when(sea, 0).when(z.isNull(), 255).otherwise(1)


def tidal_seeds(cells: DataFrame, sea: str, channel: str, highest: float, z: str = "z", connectivity: int = 8) -> DataFrame:
    """Keys of channel cells off the sea and not above ``highest`` that are reached through such cells from beside the sea."""
    k = keys(cells)
    eligible = F.col(channel) & ~F.col(sea) & (F.col(z) <= highest)
    beside = reached(cells.where(F.col(sea)), offsets(connectivity)).select(*k).distinct()
    start = marked(cells, beside, "_beside")
    return flood_fill(start, eligible, connectivity, F.col("_beside"))


def denoised(cells: DataFrame, depth: str = "depth", wet: float = 0.05, smallest: int = 6, connectivity: int = 8) -> DataFrame:
    """Wet patches of fewer than ``smallest`` cells become dry."""
    k = keys(cells)
    labels = cut_cells(label_components(cells, F.col(depth) > wet, connectivity))
    small = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < smallest)
    gone = labels.join(small, "label", "left_semi")
    return marked(cells, gone, "_gone").withColumn(depth, F.when(F.col("_gone"), 0.0).otherwise(F.col(depth))).drop("_gone")


def d8(cells: DataFrame, z: str = "z") -> DataFrame:
    """Keys and ``d8``: direction of the steepest descent, diagonals over sqrt(2), ties to the lowest direction; -1 if none."""
    k = keys(cells)
    # read three times below
    known = cut_cells(cells.where(F.col(z).isNotNull()).select(*k, F.col(z).alias("z")))
    # a neighbour in direction i sends its height back along the opposite step
    sent = reached(known, tuple((-dr, -dc) for dr, dc in FLOW), F.col("z").alias("zn"))
    apart = F.when(F.col("direction").isin(0, 2, 5, 7), 2**0.5).otherwise(1.0)
    slope = (F.col("z") - F.col("zn")) / apart
    best = sent.join(known, k).where("z > zn").groupBy(*k).agg(F.max_by("direction", F.struct(slope, -F.col("direction"))).alias("d8"))
    return known.select(*k).join(best, k, "left").select(*k, F.coalesce("d8", F.lit(-1)).alias("d8"))


def flow_edges(directions: DataFrame) -> DataFrame:
    """(cell, next): where each cell drains; a cell without a direction, or whose target is not in the table, drains to itself."""
    dr, dc = (F.array(*[F.lit(step[i]) for step in FLOW]) for i in (0, 1))
    at = cut_cells(with_id(directions))
    grid = F.col("grid") if "grid" in directions.columns else None
    target = F.when(F.col("d8") >= 0, cell_id(grid, F.col("row") + F.get(dr, F.col("d8")), F.col("col") + F.get(dc, F.col("d8"))))
    to = at.select("cell", target.alias("to"))
    there = at.select(F.col("cell").alias("to"), F.lit(True).alias("there"))
    return to.join(there, "to", "left").select("cell", F.when(F.col("there"), F.col("to")).otherwise(F.col("cell")).alias("next"))


def _rounds(step: Callable[[DataFrame], DataFrame], state: DataFrame, done: Callable[[DataFrame], bool], most: int = 64) -> DataFrame:
    state = cut_cells(state)
    for _ in range(most):
        if done(state):
            return state
        state = cut_round(step(state))
    raise RuntimeError("flow paths do not end; is there a cycle?")


def terminals(edges: DataFrame) -> DataFrame:
    """(cell, terminal): the cell at which each flow path ends, by pointer doubling."""

    def step(s: DataFrame) -> DataFrame:
        # a path that did not move has ended and asks itself, else all cells of a basin would meet at its end
        asked = s.withColumn("at", F.when(F.col("moved"), F.col("terminal")).otherwise(F.col("cell")))
        ahead = s.select(F.col("cell").alias("at"), F.col("terminal").alias("after"))
        return asked.join(ahead, "at").select("cell", F.col("after").alias("terminal"), (F.col("after") != F.col("terminal")).alias("moved"))

    start = edges.select("cell", F.col("next").alias("terminal"), F.lit(True).alias("moved"))
    return _rounds(step, start, lambda s: s.where("moved").isEmpty()).select("cell", "terminal")


def accumulation(edges: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """(cell, amount): the weight (1 each by default) of all cells that drain through a cell, its own included.

    Doubling: after k rounds a cell has the sum of all within 2**k steps
    upstream, and every pointer leads 2**k steps down.
    """
    own = edges.withColumn("amount", F.lit(1.0)) if weight is None else edges.join(weight.select("cell", F.col("weight").cast("double").alias("amount")), "cell")
    start = own.select("cell", F.when(F.col("next") != F.col("cell"), F.col("next")).alias("to"), "amount")

    def step(s: DataFrame) -> DataFrame:
        sent = s.where("to is not null").groupBy(F.col("to").alias("cell")).agg(F.sum("amount").alias("more"))
        # a cell whose pointer has run out asks itself and learns null again: as nulls all of these would meet in one task
        asked = s.withColumn("at", F.coalesce("to", "cell"))
        ahead = s.select(F.col("cell").alias("at"), F.col("to").alias("after"))
        return asked.join(ahead, "at", "left").join(sent, "cell", "left").select("cell", F.col("after").alias("to"), (F.col("amount") + F.coalesce("more", F.lit(0.0))).alias("amount"))

    return _rounds(step, start, lambda s: s.where("to is not null").isEmpty()).select("cell", "amount")


def hand(cells: DataFrame, directions: DataFrame, drainage: Column, z: str = "z") -> DataFrame:
    """Keys and ``hand``: height over the first drainage cell down the path, at least 0; null where none is reached."""
    k = keys(cells)
    at = with_id(cells.select(*k, F.col(z).alias("z"), F.coalesce(drainage, F.lit(False)).alias("drain")))
    if at.where("drain").isEmpty():
        raise ValueError("the drainage mask is empty")
    stops = at.where("drain").select("cell").withColumn("stop", F.lit(True))
    edges = flow_edges(directions).join(stops, "cell", "left").select("cell", F.when(F.col("stop"), F.col("cell")).otherwise(F.col("next")).alias("next"))
    ends = terminals(edges)
    base = at.where("drain").select(F.col("cell").alias("terminal"), F.col("z").alias("base"))
    rise = F.col("z") - F.col("base")
    found = ends.join(base, "terminal").select("cell", "base")
    return at.join(found, "cell", "left").select(*k, F.when(rise <= 1e6, F.greatest(rise, F.lit(0.0))).alias("hand"))


def outlet_distance(cells: DataFrame, outlet: Column, cell_m: float = 1.0) -> DataFrame:
    """Keys and ``distance`` in metres to the nearest outlet cell, exactly; null without one.

    First down each column by two window passes, one from either end; then, row
    by row, the lower envelope of the parabolas over the column distances.  Work
    grows with the cells, and a task holds one row of the grid.
    """
    k = keys(cells)
    extra = [c for c in k if c == "grid"]
    at = cells.select(*k, F.when(F.coalesce(outlet, F.lit(False)), F.col("row")).alias("o"))
    # a frame that is open ahead is summed anew for every row, so the second pass runs upwards
    by_column, passed = Window.partitionBy(*extra, "col"), (Window.unboundedPreceding, 0)
    above = F.last("o", ignorenulls=True).over(by_column.orderBy("row").rowsBetween(*passed))
    below = F.last("o", ignorenulls=True).over(by_column.orderBy(F.col("row").desc()).rowsBetween(*passed))
    flat = at.select(*k, F.least(F.col("row") - above, below - F.col("row")).cast("long").alias("_down"))

    def across(group: pa.Table) -> pa.Table:
        column, near = group["col"].to_numpy(), group["_down"].to_numpy()
        squared = lower_envelope(column, near)
        distance = pa.array(np.sqrt(squared) * cell_m, from_pandas=True)
        return group.drop_columns(["_down"]).append_column("distance", distance)

    kinds = dict(flat.dtypes)
    return flat.groupBy(*extra, "row").applyInArrow(across, ", ".join(f"{c} {kinds[c]}" for c in k) + ", distance double")


def lower_envelope(column: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each column the smallest (column - c)**2 + near(c)**2 over all columns c with a known ``near``; NaN without any."""
    known = np.flatnonzero(~np.isnan(near.astype(float)))
    if not len(known):
        return np.full(len(column), np.nan)
    known = known[np.argsort(column[known], kind="stable")]
    c, f = column[known].astype(float), near[known].astype(float) ** 2
    hull, starts = [0], [-np.inf]
    for i in range(1, len(c)):
        while True:
            j = hull[-1]
            meet = (f[i] + c[i] ** 2 - f[j] - c[j] ** 2) / (2 * (c[i] - c[j]))
            if meet > starts[-1]:
                break
            # never the first, whose start is minus infinity
            hull.pop()
            starts.pop()
        hull.append(i)
        starts.append(meet)
    best = np.array(hull)[np.searchsorted(np.array(starts), column.astype(float), side="right") - 1]
    return (column - c[best]) ** 2 + f[best]
