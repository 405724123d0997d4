"""Cell tables: neighbours, blocks, windows, tiles, resampling.

A grid is a table with integer ``row`` and ``col`` and value columns; several
grids are told apart by an optional integer ``grid``.  Missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.storage import by_merge

#: Neighbour offsets (row, col); the first four are the edge neighbours.
OFFSETS = ((-1, 0), (0, 1), (1, 0), (0, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))
#: Cells are numbered in 62 bits: 14 for the grid, 24 for the row, 24 for the column.
_SHIFT = 24


def offsets(connectivity: int) -> tuple[tuple[int, int], ...]:
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    return OFFSETS[:connectivity]


def keys(df: DataFrame) -> list[str]:
    return ["grid", "row", "col"] if "grid" in df.columns else ["row", "col"]


def cell_id(grid: Column | None, row: Column, column: Column) -> Column:
    """One number per cell, ordered by grid, row, column; rows and columns below 2**24."""
    in_grid = F.shiftleft(row.cast("long"), _SHIFT) + column.cast("long")
    return in_grid if grid is None else F.shiftleft(grid.cast("long"), 2 * _SHIFT) + in_grid


def with_id(df: DataFrame, name: str = "cell") -> DataFrame:
    """``df`` with the numbers of its cells; an error where a row or column is too large for one."""
    number = cell_id(F.col("grid") if "grid" in df.columns else None, F.col("row"), F.col("col"))
    fits = F.col("row").between(0, (1 << _SHIFT) - 1) & F.col("col").between(0, (1 << _SHIFT) - 1)
    return by_merge(df).withColumn(name, F.when(fits, number).when(F.col("row").isNotNull() & F.col("col").isNotNull(), F.raise_error(F.lit("rows and columns must lie between 0 and 2**24 - 1")).cast("long")))


def id_parts(cell: Column) -> tuple[Column, Column, Column]:
    """grid, row and column of a cell number."""
    mask = F.lit((1 << _SHIFT) - 1)
    return F.shiftright(cell, 2 * _SHIFT).cast("int"), F.shiftright(cell, _SHIFT).bitwiseAND(mask).cast("int"), cell.bitwiseAND(mask).cast("int")


def reached(df: DataFrame, around: tuple[tuple[int, int], ...], *carry: Column) -> DataFrame:
    """Each cell's carried columns at every offset: keys of the cell reached, ``direction`` and the columns."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("direction"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(around)]))
    extra = ["grid"] if "grid" in df.columns else []
    sent = by_merge(df.select(*extra, "row", "col", *carry, steps.alias("_s")))
    return sent.select(
        *extra, (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"), F.col("_s.direction").alias("direction"), *[c for c in df.select(*carry).columns] if carry else []
    )


def focal(df: DataFrame, value: str, half: int, aggregate: Column, name: str, where: Column | None = None) -> DataFrame:
    """An aggregate of ``v`` (the value in reach) over the square window of ``half`` cells around each cell.

    Values travel to the cells they reach and are combined there, so the
    window's sum needs one shuffle with partial aggregation.  ``where`` limits
    the cells that receive a result.
    """
    around = tuple((dr, dc) for dr in range(-half, half + 1) for dc in range(-half, half + 1))
    sent = reached(df.where(F.col(value).isNotNull()), around, F.col(value).alias("v"))
    wanted = df if where is None else df.where(where)
    return sent.groupBy(*keys(df)).agg(aggregate.alias(name)).join(wanted.select(*keys(df)), keys(df), "right")


def border_padded(df: DataFrame, value: str, half: int, width: int, height: int) -> DataFrame:
    """The grid with its border cells repeated ``half`` cells outwards, as nearest-edge filters need."""
    r = F.explode(F.sequence(F.when(F.col("row") == 0, -half).otherwise(F.col("row")), F.when(F.col("row") == height - 1, height - 1 + half).otherwise(F.col("row"))))
    c = F.explode(F.sequence(F.when(F.col("col") == 0, -half).otherwise(F.col("col")), F.when(F.col("col") == width - 1, width - 1 + half).otherwise(F.col("col"))))
    extra = ["grid"] if "grid" in df.columns else []
    rows = df.select(*extra, r.alias("row2"), "col", "row", value).withColumn("col2", c)
    return rows.select(*extra, F.col("row2").cast("int").alias("row"), F.col("col2").cast("int").alias("col"), value)


def block_aggregate(df: DataFrame, factor: int, aggregate: Column, name: str) -> DataFrame:
    """One value per block of factor x factor cells; nulls take no part."""
    extra = ["grid"] if "grid" in df.columns else []
    return df.groupBy(*extra, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(aggregate.alias(name))


def block_max(df: DataFrame, value: str, factor: int) -> DataFrame:
    return block_aggregate(df, factor, F.max(value), value)


def block_fraction(df: DataFrame, mask: str, factor: int) -> DataFrame:
    """Share of covered cells in each block."""
    return block_aggregate(df, factor, F.avg(F.col(mask).cast("double")), "fraction")


def tpi(df: DataFrame, value: str = "z", window: int = 5, width: int | None = None, height: int | None = None) -> DataFrame:
    """Topographic position: mean of the known cells in the window minus the cell, borders repeated outwards."""
    if window % 2 != 1:
        raise ValueError("the window must be odd")
    half = window // 2
    if width is None or height is None:
        size = df.agg(F.max("row"), F.max("col")).first()
        height, width = (size[0] or 0) + 1, (size[1] or 0) + 1
    padded = border_padded(df, value, half, width, height)
    mean = focal(padded, value, half, F.avg("v"), "mean", F.lit(True))
    return df.join(mean, keys(df), "left").select(*keys(df), F.when(F.col(value).isNotNull(), F.col("mean") - F.col(value)).alias("tpi"))


def median_filtered(df: DataFrame, value: str = "z", window: int = 3, where: Column | None = None) -> DataFrame:
    """Median of the known cells in the window, on cells that ``where`` selects; others keep their value.

    The window is cut at the border rather than mirrored.
    """
    half = window // 2
    found = focal(df, value, half, F.median("v"), "m", (F.col(value).isNotNull() if where is None else where & F.col(value).isNotNull()))
    return df.join(found, keys(df), "left").withColumn(value, F.coalesce("m", value)).drop("m")


def spikes_repaired(df: DataFrame, value: str = "z", floor: float = -10.0, window: int = 5) -> DataFrame:
    """Cells under the floor take the median of the known cells in their window that are not; the spikes alone are joined."""
    half = window // 2
    around = tuple((dr, dc) for dr in range(-half, half + 1) for dc in range(-half, half + 1) if (dr, dc) != (0, 0))
    k = keys(df)
    spikes = df.where(F.col(value) < floor).select(*k)
    asks = reached(spikes, tuple((-a, -b) for a, b in around), *[F.col(c).alias(f"to_{c}") for c in k])
    answers = asks.join(df.where(F.col(value) >= floor).select(*k, F.col(value).alias("v")), k)
    median = answers.groupBy(*[F.col(f"to_{c}").alias(c) for c in k]).agg(F.median("v").alias("m"))
    return df.join(median, k, "left").withColumn(value, F.when(F.col(value) < floor, F.col("m")).otherwise(F.col(value))).drop("m")


def void_filled(df: DataFrame, value: str, void: Column, radius: int = 5, smoothing: int = 0) -> DataFrame:
    """Void cells take the inverse-distance mean of the nearest known cell in each of eight directions, then ``smoothing`` passes of 3x3 means.

    Rows, columns and both diagonals are searched by windows over them, up to
    ``radius`` cells away; cells that see no known one stay null.
    """
    k = keys(df)
    extra = [c for c in k if c == "grid"]
    marked = df.withColumn("_void", F.coalesce(void, F.lit(False)) | F.col(value).isNull())
    known = F.when(~F.col("_void"), F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("v")))
    seen = marked.withColumn("_known", known)
    axes = ((F.col("row"), "col", 1.0), (F.col("col"), "row", 1.0), (F.col("row") - F.col("col"), "row", 2**0.5), (F.col("row") + F.col("col"), "row", 2**0.5))
    found = []
    for i, (line, order, step) in enumerate(axes):
        far = int(radius / step)
        if far < 1:
            continue
        along = Window.partitionBy(*extra, line).orderBy(order)
        seen = seen.withColumn(f"_b{i}", F.last("_known", ignorenulls=True).over(along.rangeBetween(-far, -1))).withColumn(f"_a{i}", F.first("_known", ignorenulls=True).over(along.rangeBetween(1, far)))
        found += [(F.col(f"_{side}{i}"), step, order) for side in "ba"]
    weight = lambda x, step, order: F.when(x.isNotNull(), 1.0 / (F.abs(x["r" if order == "row" else "c"] - F.col(order)) * step))
    weighed = [(x["v"], weight(x, step, order)) for x, step, order in found]
    total = sum((F.coalesce(w, F.lit(0.0)) for _, w in weighed), F.lit(0.0))
    mean = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in weighed), F.lit(0.0)) / F.when(total > 0, total)
    out = seen.withColumn(value, F.when(F.col("_void"), mean).otherwise(F.col(value))).select(*df.columns, "_void")
    for _ in range(smoothing):
        means = focal(out, value, 1, F.avg("v"), "m", F.col("_void"))
        out = out.join(means, k, "left").withColumn(value, F.when(F.col("_void") & F.col(value).isNotNull(), F.col("m")).otherwise(F.col(value))).drop("m")
    return out.drop("_void")


def land_edge(df: DataFrame, land: str) -> DataFrame:
    """Land cells with a known edge neighbour that is not land, and the cells one step around them."""
    k = keys(df)
    shores = reached(df.where(~F.col(land)), OFFSETS[:4]).select(*k).distinct().join(df.where(F.col(land)).select(*k), k)
    wide = reached(shores, OFFSETS[:4]).select(*k).union(shores.select(*k)).distinct()
    return df.select(*k).join(wide.withColumn("edge", F.lit(True)), k, "left").select(*k, F.coalesce("edge", F.lit(False)).alias("edge"))


def resample(df: DataFrame, value: str, target: DataFrame, method: str = "bilinear") -> DataFrame:
    """Values of a source grid on the cells of ``target``.

    ``target`` has row, col and the fractional source position of each cell's
    centre, ``src_row`` and ``src_col``, counted from the centre of the first
    source cell.  Bilinear weights are shared among known cells; ``nearest``
    takes the cell whose centre is closest.
    """
    k = keys(target)
    source = by_merge(df).select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("v")).where("v is not null")
    if method == "nearest":
        near = target.withColumn("_r", F.floor(F.col("src_row") + 0.5).cast("int")).withColumn("_c", F.floor(F.col("src_col") + 0.5).cast("int"))
        return near.join(source, ["_r", "_c"], "left").select(*k, F.col("v").alias(value))
    if method != "bilinear":
        raise ValueError("method must be bilinear or nearest")
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    at = target.select(*k, "src_row", "src_col", corners.alias("s")).withColumn("_r", (F.floor("src_row") + F.col("s.a")).cast("int")).withColumn("_c", (F.floor("src_col") + F.col("s.b")).cast("int"))
    weight = (1 - F.abs(F.col("src_row") - F.col("_r"))) * (1 - F.abs(F.col("src_col") - F.col("_c")))
    met = at.withColumn("w", weight).where("w > 0").join(source, ["_r", "_c"], "left")
    total = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return met.groupBy(*k).agg((F.sum(F.col("v") * F.col("w")) / F.when(total > 0, total)).alias(value))


def resample_average(df: DataFrame, value: str, to_row: Column, to_col: Column) -> DataFrame:
    """Mean of the source cells that fall into each target cell."""
    return df.groupBy(to_row.cast("int").alias("row"), to_col.cast("int").alias("col")).agg(F.avg(value).alias(value))


def to_tiles(df: DataFrame, value: str, size: int = 256) -> DataFrame:
    """Cells packed into tiles: tile_r, tile_c and the row-major values with nulls for missing cells."""
    extra = ["grid"] if "grid" in df.columns else []
    tr, tc = (F.floor(F.col(x) / size).cast("int") for x in ("row", "col"))
    placed = df.select(*extra, tr.alias("tile_r"), tc.alias("tile_c"), (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).alias("at"), value)
    return placed.groupBy(*extra, "tile_r", "tile_c").agg(F.map_from_entries(F.collect_list(F.struct("at", value))).alias("m")).select(
        *extra, "tile_r", "tile_c", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.try_element_at("m", i)).alias("data")
    )


def from_tiles(tiles: DataFrame, value: str, size: int = 256) -> DataFrame:
    """Cells of tiles, those with values only."""
    extra = ["grid"] if "grid" in tiles.columns else []
    cells = tiles.select(*extra, "tile_r", "tile_c", F.posexplode("data").alias("at", value)).where(F.col(value).isNotNull())
    return cells.select(*extra, (F.col("tile_r") * size + F.floor(F.col("at") / size)).cast("int").alias("row"), (F.col("tile_c") * size + F.col("at") % size).cast("int").alias("col"), value)


def aligned(a: DataFrame, b: DataFrame) -> None:
    """Raise unless two one-row geometry tables (epsg, a, c, e, f, width, height) agree."""
    fields = ("epsg", "a", "c", "e", "f", "width", "height")
    left, right = a.select(*fields).first(), b.select(*fields).first()
    odd = [f for f, x, y in zip(fields, left, right) if x != y]
    if odd:
        raise ValueError(f"grids differ in {', '.join(odd)}")


def filled_grid(spark: SparkSession, height: int, width: int, value: float = 0.0) -> DataFrame:
    """A grid of one value."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"), F.lit(value).alias("z"))


def shifted(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Cells of another grid of the same cell size placed on this one's rows and columns."""
    return df.withColumn("row", (F.col("row") + rows).cast("int")).withColumn("col", (F.col("col") + columns).cast("int"))


def buffered(df: DataFrame, lines: DataFrame, width: float) -> DataFrame:
    """Cells whose centre lies within ``width`` cells of a segment (x1, y1, x2, y2 in columns and rows).

    A segment asks for the cells of its box, so lines and cells meet by an
    equi-join on row and column.
    """
    from tidemark.functions.geo import segment_distance

    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) - width).cast("int"), F.ceil(F.greatest(a, b) + width).cast("int")))
    asked = lines.withColumn("row", span("y1", "y2")).withColumn("col", span("x1", "x2"))
    near = asked.where(segment_distance(F.col("col") + 0.5, F.col("row") + 0.5, "x1", "y1", "x2", "y2") <= width).select("row", "col").distinct()
    return df.join(by_merge(near), ["row", "col"])
