"""Rasters as tiled text grids: one file a tile in the plain ESRI ASCII format.

A tile's file starts with its header (columns, rows, lower left corner, cell
size, no-data value) and goes on with its rows from the north.  Files lie in
folders ``tile_r=``/``tile_c=``, so a window prunes tiles before anything is
read; each file that is left is one task's work at most.  The grid's geometry is
read from the headers and can be held against another's.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0
#: Side of a tile in cells.
TILE = 256


class Geometry(NamedTuple):
    """UTM zone or EPSG number, west and north edge, and cell size, in metres."""

    epsg: int
    west: float
    north: float
    size: float


def write_raster(cells: DataFrame, path: str, value: str, at: Geometry, tile: int = TILE) -> None:
    """Write a grid without a ``grid`` column; nulls and cells that lie in no row are no data.

    A tile is gathered in one task, and holds ``tile`` squared numbers at most.
    """
    tr, tc = (F.floor(F.col(c) / tile).cast("int") for c in ("row", "col"))
    text = F.coalesce(F.col(value).cast("double"), F.lit(NODATA)).cast("string")
    rows = cells.select(tr.alias("tile_r"), tc.alias("tile_c"), F.pmod("row", F.lit(tile)).alias("r"), F.pmod("col", F.lit(tile)).alias("c"), text.alias("v"))
    line = F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(str(NODATA))))
    by_row = rows.groupBy("tile_r", "tile_c", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m")).select("tile_r", "tile_c", "r", F.array_join(line, " ").alias("line"))
    none = F.array_join(F.array_repeat(F.lit(str(NODATA)), tile), " ")
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda i: F.coalesce(F.try_element_at("m", i), none)), "\n")
    tiles = by_row.groupBy("tile_r", "tile_c").agg(F.map_from_entries(F.collect_list(F.struct("r", "line"))).alias("m"))
    corner = lambda c, edge, sign, step: (F.lit(edge) + F.lit(sign * at.size * tile) * (F.col(c) + step)).cast("string")
    header = F.concat_ws(
        "\n", F.lit(f"ncols {tile}"), F.lit(f"nrows {tile}"), F.concat(F.lit("xllcorner "), corner("tile_c", at.west, 1, 0)), F.concat(F.lit("yllcorner "), corner("tile_r", at.north, -1, 1)), F.lit(f"cellsize {at.size}"), F.lit(f"NODATA_value {NODATA}")
    )
    tiles.select("tile_r", "tile_c", F.concat_ws("\n", header, body).alias("value")).repartition("tile_r", "tile_c").write.partitionBy("tile_r", "tile_c").option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each tile's file: tile_r, tile_c and its lines."""
    return spark.read.text(path, wholetext=True).select("tile_r", "tile_c", F.split("value", r"\r?\n").alias("lines"))


def _header(name: str) -> Column:
    line = F.filter("lines", lambda x: F.lower(x).startswith(name + " "))
    return F.split(F.trim(F.get(line, F.lit(0))), r"\s+")[1].cast("double")


def read_raster(spark: SparkSession, path: str, value: str = "z", rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, tile: int | None = None) -> DataFrame:
    """row, col and ``value`` of the known cells, of a window of rows and columns (ends included) where one is given.

    The window reaches the listing of files: tiles outside it are not read.
    """
    files = spark.read.text(path, wholetext=True)
    side = tile or int(_files(spark, path).select(_header("ncols")).first()[0])
    for name, ends in (("tile_r", rows), ("tile_c", columns)):
        if ends is not None:
            files = files.where(F.col(name).between(ends[0] // side, ends[1] // side))
    told = files.select("tile_r", "tile_c", F.split("value", r"\r?\n").alias("lines")).select("tile_r", "tile_c", _header("nodata_value").alias("none"), F.filter("lines", lambda x: x.rlike(r"^\s*[-+0-9.]")).alias("lines"))
    lines = told.select("tile_r", "tile_c", "none", F.posexplode("lines").alias("r", "line"))
    cells = lines.select("tile_r", "tile_c", "none", "r", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "v"))
    v = F.col("v").cast("double")
    out = cells.select((F.col("tile_r") * side + F.col("r")).cast("int").alias("row"), (F.col("tile_c") * side + F.col("c")).cast("int").alias("col"), F.when((v != F.col("none")) & ~F.isnan(v), v).alias(value)).where(F.col(value).isNotNull())
    for name, ends in (("row", rows), ("col", columns)):
        if ends is not None:
            out = out.where(F.col(name).between(*ends))
    return out


def read_geometry(spark: SparkSession, path: str, epsg: int) -> DataFrame:
    """One row (epsg, a, c, e, f, width, height) of a raster's tiles, from their headers."""
    h = _files(spark, path).select("tile_r", "tile_c", _header("ncols").alias("n"), _header("xllcorner").alias("x"), _header("yllcorner").alias("y"), _header("cellsize").alias("a"))
    far = h.select("n", "a", (F.col("x") - F.col("tile_c") * F.col("n") * F.col("a")).alias("c"), (F.col("y") + (F.col("tile_r") + 1) * F.col("n") * F.col("a")).alias("f"), "tile_r", "tile_c")
    return far.agg(F.lit(epsg).alias("epsg"), F.max("a").alias("a"), F.min("c").alias("c"), (-F.max("a")).alias("e"), F.max("f").alias("f"), (F.max((F.col("tile_c") + 1) * F.col("n"))).cast("int").alias("width"), (F.max((F.col("tile_r") + 1) * F.col("n"))).cast("int").alias("height"))


def geometry_table(cells: DataFrame, at: Geometry) -> DataFrame:
    """One row (epsg, a, c, e, f, width, height) of a cell table placed at ``at``."""
    return cells.agg(F.lit(at.epsg).alias("epsg"), F.lit(at.size).alias("a"), F.lit(at.west).alias("c"), F.lit(-at.size).alias("e"), F.lit(at.north).alias("f"), (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))


def misaligned(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Fields in which two one-row geometries differ: (field, expected, found); ``e`` goes with ``a``."""
    fields = ("epsg", "a", "c", "f", "width", "height")
    spread = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields])).alias("x")).select("x.*")
    both = spread(expected, "expected").join(spread(found, "found"), "field")
    return both.where(~F.col("expected").eqNullSafe(F.col("found"))).select("field", "expected", "found")
