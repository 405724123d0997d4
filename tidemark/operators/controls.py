"""Points to judge a model by where nothing was flooded: spread controls, and random cells away from documented floods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scoring import nearest
from tidemark.sources.storage import cut

#: After so many choices the candidates that are left are stored anew, so conditions do not pile up.
STORE_EVERY = 24


def _square(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def dry_controls(candidates: DataFrame, floods: DataFrame, hand_low: float = 6.5, hand_high: float = 20.0, apart_m: float = 1000.0, between_m: float = 2500.0, stride: int = 3, n: int = 12) -> DataFrame:
    """At most ``n`` cells (rank, row, col, x, y, hand, distance) chosen without looking at the model.

    ``candidates`` has row, col, x, y, hand and channel, ``floods`` x and y.  Of
    the cells on every ``stride``-th row and column with a plausible height, off
    channels and ``apart_m`` from floods, the farthest comes first (ties: row,
    column), then the farthest of those ``between_m`` from all chosen.  Each
    choice is one aggregation; only the cell chosen comes to the driver.
    """
    spark = candidates.sparkSession
    fits = (F.col("row") % stride == 0) & (F.col("col") % stride == 0) & F.col("hand").between(hand_low, hand_high) & ~F.coalesce(F.col("channel"), F.lit(False))
    ok = candidates.where(fits).select("row", "col", F.col("x").cast("double"), F.col("y").cast("double"), F.col("hand").cast("double"))
    stations = floods.select(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0).alias("station_id"))
    # without floods every cell is as far as can be
    far = nearest(ok, stations, "x", "y").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))
    left = cut(far.where(F.col("distance") >= apart_m).select("row", "col", "x", "y", "hand", "distance"))
    chosen: list[tuple] = []
    while len(chosen) < n:
        first = F.max(F.struct("distance", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"), "x", "y", "hand")).alias("m")
        best = left.agg(first).first()["m"]
        if best is None:
            break
        chosen.append((len(chosen) + 1, -best["r"], -best["c"], best["x"], best["y"], best["hand"], best["distance"]))
        left = left.where(_square(F.col("x"), F.lit(best["x"])) + _square(F.col("y"), F.lit(best["y"])) >= between_m**2)
        if len(chosen) % STORE_EVERY == 0:
            left = cut(left)
    return spark.createDataFrame(chosen, "rank int, row int, col int, x double, y double, hand double, distance double")


def random_negatives(cells: DataFrame, floods: DataFrame, n: int = 60, apart_m: float = 300.0, seed: int = 2026) -> DataFrame:
    """``n`` known cells (row, col, x, y) that lie at least ``apart_m`` from every flood: those of the smallest digests of seed, row and column.

    Cells meet floods by squares of ``apart_m``, each flood standing in its own
    and the eight around.
    """
    square = lambda c: F.floor(F.col(c) / F.lit(apart_m))
    steps = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    around = floods.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct().withColumn("_i", square("_x")).withColumn("_j", square("_y")).withColumn("_di", steps).withColumn("_dj", steps)
    around = around.select("_x", "_y", (F.col("_i") + F.col("_di")).alias("_i"), (F.col("_j") + F.col("_dj")).alias("_j"))
    at = cells.select("row", "col", "x", "y").withColumn("_i", square("x")).withColumn("_j", square("y"))
    near = (F.sqrt(_square(F.col("x"), F.col("_x")) + _square(F.col("y"), F.col("_y"))) < apart_m) & (at["_i"] == around["_i"]) & (at["_j"] == around["_j"])
    far = at.join(around, near, "left_anti")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "row", "col"))
    return far.orderBy(digest, "row", "col").limit(n).select("row", "col", "x", "y")


def assessed_register(points: DataFrame, cells: DataFrame, flood_highest: float = 15.0, dry_nearest_m: float = 500.0) -> DataFrame:
    """``points`` (label, cls, row, col, x, y and other columns) with ``elevation``, ``to_flood``, ``flag`` and ``confidence``.

    A point without a place has failed; one off the known ground, a flood on
    ground above ``flood_highest``, or a dry point within ``dry_nearest_m`` of a
    flood is of low confidence.  Rules apply in that order.
    """
    ground = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("z").cast("double").alias("elevation"))
    at = points.join(ground, (points["row"] == F.col("_r")) & (points["col"] == F.col("_c")), "left").drop("_r", "_c")
    floods = points.where((F.col("cls") == "flood") & F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0).alias("station_id"))
    spots = points.where("cls = 'dry'").select(F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null").distinct()
    far = nearest(spots, floods, "x", "y").select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("distance").alias("_d"))
    dry = F.col("cls") == "dry"
    told = at.join(far, dry & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").withColumn("to_flood", F.col("_d")).drop("_x", "_y", "_d")
    flag = (
        F.when(F.col("x").isNull() | F.col("y").isNull(), "no place")
        .when(F.col("elevation").isNull(), "off the ground")
        .when((F.col("cls") == "flood") & (F.col("elevation") > flood_highest), "flood on high ground")
        .when(dry & (F.col("to_flood") < dry_nearest_m), "dry beside a flood")
        .otherwise("ok")
    )
    return told.withColumn("flag", flag).withColumn("confidence", F.when(F.col("flag") == "ok", "high").when(F.col("flag") == "no place", "failed").otherwise("low"))
