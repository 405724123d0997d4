"""Drainage across flats: how far each cell of a flat lies from where the flat drains.

Distances are fewest steps over neighbours of the same height.  They are found
within tiles by array code, one task a tile; from then on only border cells of
tiles offer their distances to their neighbours across the border, and only
tiles in which an offer is better are spread anew.  Rounds follow the number of
tiles that a shortest way crosses, never its cells: a flat of 2,000 cells across
takes as many rounds as one of 1,100.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grid import OFFSETS, keys, reached
from tidemark.sources.storage import cut, cut_round

#: Side of a tile in cells: a task holds a million heights and distances.
TILE = 1024
#: A distance that is not known.
FAR = np.iinfo(np.int32).max


def spread(height: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The least distances that follow from those known (others ``FAR``), a step to any of eight neighbours of equal height."""
    h = np.pad(height, 1, constant_values=np.nan).ravel()
    d = np.pad(distance, 1, constant_values=FAR).ravel()
    wide = height.shape[1] + 2
    steps = [dr * wide + dc for dr, dc in OFFSETS]
    known = np.flatnonzero(d < FAR)
    known = known[np.argsort(d[known], kind="stable")]
    values, first = np.unique(d[known], return_index=True)
    waiting = {int(v): [part] for v, part in zip(values, np.split(known, first[1:]))}
    order = sorted(waiting)
    while order:
        level = heapq.heappop(order)
        at = np.concatenate(waiting.pop(level))
        at = at[d[at] == level]
        reached_now = []
        for step in steps:
            there = at + step
            there = there[(h[there] == h[at]) & (d[there] > level + 1)]
            d[there] = level + 1
            reached_now.append(there)
        found = np.concatenate(reached_now)
        if len(found):
            if level + 1 not in waiting:
                waiting[level + 1] = []
                heapq.heappush(order, level + 1)
            waiting[level + 1].append(found)
    return d.reshape(height.shape[0] + 2, wide)[1:-1, 1:-1]


def _spread_tiles(cells: DataFrame, k: list[str]) -> DataFrame:
    """``cells`` (keys, height, distance, tr, tc) with distances spread within each tile."""

    def within(group: pa.Table) -> pa.Table:
        row, column = group["row"].to_numpy(), group["col"].to_numpy()
        r0, c0 = row.min(), column.min()
        shape = (row.max() - r0 + 1, column.max() - c0 + 1)
        height, distance = np.full(shape, np.nan), np.full(shape, FAR, np.int32)
        height[row - r0, column - c0] = group["height"].to_numpy()
        distance[row - r0, column - c0] = group["distance"].fill_null(FAR).to_numpy()
        found = spread(height, distance)[row - r0, column - c0]
        return group.set_column(group.column_names.index("distance"), "distance", pa.array(found, pa.int32(), mask=found == FAR))

    extra = [c for c in k if c == "grid"]
    kinds = "".join(f"{c} int, " for c in k)
    return cells.groupBy(*extra, "tr", "tc").applyInArrow(within, f"{kinds}height double, distance int, tr long, tc long")


def flat_distances(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Keys, ``height`` and ``distance`` from ``cells`` (keys, height, distance: 0 where it drains, else null); null where no cell that drains is reached."""
    k = keys(cells)
    extra = [c for c in k if c == "grid"]
    tiles = [*extra, "tr", "tc"]
    typed = cells.select(*[F.col(c).cast("int") for c in k], F.col("height").cast("double"), F.col("distance").cast("int"), F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    state = cut_round(_spread_tiles(typed, k))
    at = lambda x: F.pmod(F.col(x), F.lit(tile))
    while True:
        border = state.where(at("row").isin(0, tile - 1) | at("col").isin(0, tile - 1))
        offers = reached(border.where("distance is not null"), OFFSETS, F.col("height").alias("theirs"), (F.col("distance") + 1).alias("offer"))
        better = cut(offers.join(border, k).where("height = theirs and (distance is null or offer < distance)").groupBy(*k, "tr", "tc").agg(F.min("offer").alias("offer")))
        if better.isEmpty():
            return state.select(*k, "height", "distance")
        # a row a tile of a million cells
        active = cut(better.select(*tiles).distinct())
        anew = state.join(F.broadcast(active), tiles, "left_semi").join(better.select(*k, "offer"), k, "left")
        told = anew.select(*k, "height", F.least("distance", "offer").alias("distance"), "tr", "tc")
        state = cut_round(_spread_tiles(told, k).unionByName(state.join(F.broadcast(active), tiles, "left_anti")))
