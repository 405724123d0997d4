"""The library's expressions as SQL functions of the session, an aggregate, and table functions over tiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from tidemark.functions import depth as D
from tidemark.functions import hydrology as H
from tidemark.operators.graph import tile_labels
from tidemark.operators.grid import OFFSETS
from tidemark.operators.series import fit_values

#: Name, parameters, type, and the expression over them; the body in SQL is made from it.
FUNCTIONS = (
    ("bathtub_depth", "z DOUBLE, level DOUBLE", "DOUBLE", lambda: D.bathtub("z", "level")),
    ("hand_stage", "hand DOUBLE, stage DOUBLE", "DOUBLE", lambda: D.hand_depth("hand", "stage")),
    ("depth_severity", "depth DOUBLE", "INT", lambda: D.severity("depth")),
    ("gumbel_level", "mu DOUBLE, sigma DOUBLE, return_period DOUBLE", "DOUBLE", lambda: H.gev_quantile(0.0, "mu", "sigma", "return_period")),
    ("gev_level", "xi DOUBLE, mu DOUBLE, sigma DOUBLE, return_period DOUBLE", "DOUBLE", lambda: H.gev_quantile("xi", "mu", "sigma", "return_period")),
    ("curve_number_runoff", "rain_mm DOUBLE, curve_number DOUBLE", "DOUBLE", lambda: H.scs_runoff("rain_mm", F.col("curve_number"))),
    ("manning_depth", "discharge DOUBLE, width DOUBLE, n DOUBLE, slope DOUBLE", "DOUBLE", lambda: H.manning_stage("discharge", F.col("width"), F.col("n"), F.col("slope"))),
    ("warming_factor", "degrees DOUBLE, exponent DOUBLE", "DOUBLE", lambda: H.climate_factor("degrees", F.col("exponent"))),
)


def body(spark: SparkSession, parameters: str, expression: Column) -> str:
    """An expression over ``parameters`` as SQL text."""
    made = spark.createDataFrame([], parameters).select(expression.alias("x"))
    text = made._jdf.queryExecution().analyzed().expressions().head().child().sql()
    # the analysed form of an error has a class that SQL text does not take
    return re.sub(r"raise_error\('USER_RAISED_EXCEPTION', map\('errorMessage', ('(?:[^'\\]|\\.)*')\)\)", r"raise_error(\1)", text)


@pandas_udf(T.ArrayType(T.DoubleType()))
def gev_parameters(value: pd.Series) -> list:
    """Shape, location and scale by maximum likelihood; a group holds the annual maxima of a series, null with fewer than three."""
    x = value.dropna().to_numpy(float)
    return None if len(x) < 3 else list(fit_values(x))


class _Tile:
    """Collects the cells of one tile (row, col, a value) and tells them as an array with its corner."""

    def __init__(self) -> None:
        self.cells: list[tuple[int, int, object]] = []

    def dense(self, empty) -> tuple[np.ndarray, int, int]:
        r0, c0 = min(r for r, _, _ in self.cells), min(c for _, c, _ in self.cells)
        out = np.full((max(r for r, _, _ in self.cells) - r0 + 1, max(c for _, c, _ in self.cells) - c0 + 1), empty)
        for r, c, v in self.cells:
            if v is not None:
                out[r - r0, c - c0] = v
        return out, r0, c0


@udtf(returnType=T.StructType([T.StructField(n, T.IntegerType()) for n in ("row", "col", "label_row", "label_col")]))
class TileLabels(_Tile):
    """Cells (row, col, active) of a tile that are active, with the first cell of their component in the tile."""

    def eval(self, cell) -> None:
        self.cells.append((cell["row"], cell["col"], cell["active"]))

    def terminate(self) -> Iterator[tuple[int, int, int, int]]:
        if not self.cells:
            return
        mask, r0, c0 = self.dense(False)
        labels = tile_labels(mask, OFFSETS)
        for r, c in zip(*np.nonzero(mask)):
            yield int(r) + r0, int(c) + c0, int(labels[r, c]) // mask.shape[1] + r0, int(labels[r, c]) % mask.shape[1] + c0


@udtf(returnType=T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("low", T.DoubleType())]))
class TileLowest(_Tile):
    """Cells (row, col, z) of a tile with the lowest known height among themselves and their neighbours in the tile."""

    def eval(self, cell) -> None:
        self.cells.append((cell["row"], cell["col"], cell["z"]))

    def terminate(self) -> Iterator[tuple[int, int, float]]:
        if not self.cells:
            return
        z, r0, c0 = self.dense(np.inf)
        z = z.astype(float)
        wide = np.pad(z, 1, constant_values=np.inf)
        low = np.min([wide[1 + dr : 1 + dr + z.shape[0], 1 + dc : 1 + dc + z.shape[1]] for dr, dc in ((0, 0), *OFFSETS)], axis=0)
        for r, c, v in self.cells:
            if v is not None:
                yield r, c, float(low[r - r0, c - c0])


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names; a second call changes nothing.

    The aggregate ``gev_parameters`` takes small groups, as series of yearly
    values are; the table functions ``tile_labels`` and ``tile_lowest`` take a
    table partitioned by tile, so a task holds one tile.
    """
    for name, parameters, kind, expression in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body(spark, parameters, expression())}")
    spark.udf.register("gev_parameters", gev_parameters)
    spark.udtf.register("tile_labels", TileLabels)
    spark.udtf.register("tile_lowest", TileLowest)
    return [*(f[0] for f in FUNCTIONS), "gev_parameters", "tile_labels", "tile_lowest"]
