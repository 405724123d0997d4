"""Grids on other projections: each target cell asks for its fractional place in the source grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import from_utm, to_utm
from tidemark.operators.grid import keys, resample
from tidemark.operators.zonal import mosaic
from tidemark.sources.rasters import Geometry
from tidemark.sources.storage import cut


def placed(target: DataFrame, at: Geometry, source_at: Geometry) -> DataFrame:
    """Keys of ``target`` with ``src_row`` and ``src_col``: where their centres lie in the source, counted from the centre of its first cell."""
    k = keys(target)
    x, y = F.lit(at.west) + (F.col("col") + 0.5) * at.size, F.lit(at.north) - (F.col("row") + 0.5) * at.size
    there = target.select(*k, x.alias("_x"), y.alias("_y"))
    if at.epsg != source_at.epsg:
        lon, lat = from_utm("_x", "_y", at.epsg)
        there = there.select(*k, lon.alias("_lon"), lat.alias("_lat"))
        x, y = to_utm("_lon", "_lat", source_at.epsg)
        there = there.select(*k, x.alias("_x"), y.alias("_y"))
    return there.select(*k, ((F.lit(source_at.north) - F.col("_y")) / source_at.size - 0.5).alias("src_row"), ((F.col("_x") - F.lit(source_at.west)) / source_at.size - 0.5).alias("src_col"))


def reprojected(source: DataFrame, source_at: Geometry, target: DataFrame, at: Geometry, value: str = "depth", method: str = "bilinear") -> DataFrame:
    """Keys of ``target`` and the source's value there, null outside the source and where it knows nothing.

    Only target cells that lie on the source or a cell beside it meet its cells.
    """
    ends = source.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    # stored, or a filter on places would be pushed down through the series of both projections, multiplied out
    asked = cut(placed(target, at, source_at))
    if ends[0] is None:
        return asked.select(*keys(target), F.lit(None).cast("double").alias(value))
    near = asked.where(F.col("src_row").between(ends[0] - 1, ends[1] + 1) & F.col("src_col").between(ends[2] - 1, ends[3] + 1))
    return asked.select(*keys(target)).join(resample(source, value, near, method), keys(target), "left")


def composite(sources: list[tuple[DataFrame, Geometry]], target: DataFrame, at: Geometry, value: str = "depth") -> DataFrame:
    """The deepest known value of several grids, each on its own projection, on the cells of ``target``; depths are not negative."""
    return mosaic([reprojected(s.withColumn(value, F.when(F.col(value).isNotNull(), F.greatest(F.col(value), F.lit(0.0)))), g, target, at, value) for s, g in sources], value)
