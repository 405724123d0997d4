"""Lines on the grid: every cell that a line touches, culverts aside, and drainage from lines and from flow.

Lines are rows of segments x1, y1, x2, y2 in columns and rows, a cell being the
unit square from its own column and row on.  A segment is cut where it crosses
the grid's lines; each piece lies in one cell, so work and rows grow with its
length, not with its box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import segment_distance
from tidemark.operators.grid import keys
from tidemark.operators.terrain import conditioned_directions, drainage_mask
from tidemark.sources.storage import by_merge

#: Tags of waterways under ground.
UNDERGROUND = ("culvert", "yes", "covered", "building_passage")
#: Pieces of a segment shorter than this share of it are a corner that it only touches.
LEAST = 1e-12


def open_lines(lines: DataFrame) -> DataFrame:
    """Lines that run above ground by their tags ``tunnel``, ``covered`` and ``layer``."""
    tag = lambda name: F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))
    below = F.coalesce(F.col("layer").cast("string").try_cast("int") < 0, F.lit(False))
    return lines.where(~(tag("tunnel").isin(*UNDERGROUND) | (tag("covered") == "yes") | below))


def _crossings(a: Column, b: Column) -> Column:
    """Where, from 0 at ``a`` to 1 at ``b``, whole numbers are passed."""
    low, high = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
    whole = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(whole, lambda w: (w - a) / (b - a))


def touched(lines: DataFrame) -> DataFrame:
    """The columns of ``lines`` with ``row`` and ``col``, once for every cell that a segment runs through."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    marks = F.array_sort(F.concat(F.array(F.lit(0.0)), _crossings(x1, x2), _crossings(y1, y2), F.array(F.lit(1.0))))
    pieces = F.transform(F.slice("_marks", F.lit(2), F.size("_marks") - 1), lambda t, i: F.struct(F.get("_marks", i).alias("a"), t.alias("b")))
    point = (x1 == x2) & (y1 == y2)
    cut_up = lines.withColumn("_marks", marks).withColumn("_t", F.explode(pieces)).where((F.col("_t.b") - F.col("_t.a") > LEAST) | point)
    middle = (F.col("_t.a") + F.col("_t.b")) / 2
    at = cut_up.withColumn("row", F.floor(y1 + middle * (y2 - y1)).cast("int")).withColumn("col", F.floor(x1 + middle * (x2 - x1)).cast("int"))
    return at.drop("_marks", "_t").distinct()


def square_distance(row: Column, column: Column) -> Column:
    """How far a segment passes by a cell's square that it does not run through: a corner or an end of it is nearest."""
    corners = [segment_distance(column + a, row + b, "x1", "y1", "x2", "y2") for a in (0, 1) for b in (0, 1)]
    off = lambda v, low: F.greatest(low - v, v - low - 1, F.lit(0.0))
    ends = [F.hypot(off(F.col(x), column), off(F.col(y), row)) for x, y in (("x1", "y1"), ("x2", "y2"))]
    return F.least(*corners, *ends)


def touched_within(cells: DataFrame, lines: DataFrame, width: float) -> DataFrame:
    """Cells that a line widened by ``width`` cells to either side touches at all."""
    reach = int(-(-width // 1))
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    through = touched(lines.select("x1", "y1", "x2", "y2"))
    around = through.withColumn("dr", step).withColumn("dc", step).select("x1", "y1", "x2", "y2", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), ((F.col("dr") == 0) & (F.col("dc") == 0)).alias("own"))
    near = around.where(F.col("own") | (square_distance(F.col("row"), F.col("col")) <= width)).select("row", "col").distinct()
    return cells.join(by_merge(near), ["row", "col"], "left_semi")


def drainage_network(cells: DataFrame, lines: DataFrame | None, width: float, threshold: int = 200, how: str = "union", z: str = "z") -> DataFrame:
    """Keys and ``drain``: cells that open lines touch, cells with ``threshold`` cells upstream, or either.

    ``how`` is lines, accumulation or union; where no open line is left to go
    by, accumulation serves for lines too.
    """
    if how not in ("lines", "accumulation", "union"):
        raise ValueError("how must be lines, accumulation or union")
    k = keys(cells)
    above = None if lines is None else open_lines(lines)
    none = above is None or above.isEmpty()
    found = []
    if not none and how != "accumulation":
        found.append(touched_within(cells, above, width).select(*k))
    if none or how != "lines":
        found.append(drainage_mask(conditioned_directions(cells, z), threshold).where("drain").select(*k))
    both = found[0] if len(found) == 1 else found[0].union(found[1]).distinct()
    return by_merge(cells.select(*k)).join(both.withColumn("drain", F.lit(True)), k, "left").select(*k, F.coalesce("drain", F.lit(False)).alias("drain"))
