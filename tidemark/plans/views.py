"""Grids, series and point registers derived from the driver's star-schema tables.

The tables hold no rasters, so a grid is laid over ``part`` (40 columns, a
height from the size, some cells without data), series come from ``events``,
annual maxima from ``lineitem`` and points from ``supplier``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hydrology import RETURN_PERIODS, gev_quantile, gumbel_location, gumbel_scale
from tidemark.plans.forcing import return_periods

WIDTH = 40
#: Cells that a task reads, and rows of the grid that stay together.
CELLS_A_TASK, ROWS_TOGETHER = 50_000, 32
#: Gumbel location and scale in metres of the hazards' levels.
LAWS = {"coastal": (0.30, 0.12), "fluvial": (0.50, 0.20), "pluvial": (0.05, 0.05)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, z, hand, filled, channel, size; z and what follows from it are null on some cells.

    A million cells lie in a file of a few MB, which one task would read, and
    spread to neighbours, return periods or sorted files alone: they are dealt
    out by stretches of rows, so that a task's share does not grow.
    """
    p, size = F.col("p_partkey"), F.col("p_size")
    z = F.when(p % 97 != 13, (size - 10) / 10.0)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    tasks = part.count() // CELLS_A_TASK + 1
    if tasks > 1:
        part = part.repartition(tasks, F.floor(p / (WIDTH * ROWS_TOGETHER)))
    return part.select(
        F.floor(p / WIDTH).cast("int").alias("row"), (p % WIDTH).cast("int").alias("col"), z.alias("z"), F.when(z.isNotNull(), size / 10.0).alias("hand"), (z + (p % 7) / 10.0).alias("filled"), (size % 5 == 0).alias("channel"), size.alias("size")
    )


def on_border(grid: DataFrame) -> Column:
    """Whether a cell lies on the grid's border; its height is read from the data."""
    last = grid.agg(F.max("row")).first()[0]
    return (F.col("row") == 0) | (F.col("row") == last) | F.col("col").isin(0, WIDTH - 1)


def levels(spark: SparkSession) -> DataFrame:
    """hazard_type, return_period, scenario, horizon, water_level_m of the present day."""
    laws = F.broadcast(spark.createDataFrame([(h, m, s) for h, (m, s) in LAWS.items()], "hazard_type string, mu double, sigma double"))
    grid = return_periods(spark, RETURN_PERIODS).join(laws)
    return grid.select("hazard_type", "return_period", F.lit("SSP5-8.5").alias("scenario"), F.lit(2020).alias("horizon"), F.round(gev_quantile(0.0, "mu", "sigma", "return_period"), 6).alias("water_level_m"))


#: The hazard whose levels follow from each series of annual maxima, and the part of a maximum that is a metre.
SERIES_OF = {"A": "coastal", "N": "fluvial", "R": "pluvial"}
METRE = 1e5


def table_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``levels``, by the Gumbel law through median and maximum of the annual maxima of line items."""
    ends = annual_max(spark, sf_dir).groupBy("series_id").agg((F.median("max_value") / METRE).alias("lo"), (F.max("max_value") / METRE).alias("hi"))
    hazard = F.create_map(*[F.lit(x) for pair in SERIES_OF.items() for x in pair])[F.col("series_id")]
    law = ends.select(hazard.alias("hazard_type"), gumbel_scale(2, "lo", 100, "hi").alias("sigma"), gumbel_location(2, "lo", 100, "hi").alias("mu"))
    # a row a return period
    grid = law.join(F.broadcast(return_periods(spark, RETURN_PERIODS)))
    return grid.select("hazard_type", "return_period", F.lit("SSP5-8.5").alias("scenario"), F.lit(2020).alias("horizon"), F.round(gev_quantile(0.0, "mu", "sigma", "return_period"), 6).alias("water_level_m"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts (hour), value: hourly sums of the events of each type."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("value"))


def annual_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, year, max_value from line items."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.year("l_shipdate").alias("year")).agg(F.max("l_extendedprice").alias("max_value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, row, col, cls: suppliers dealt over the first five rows of the grid."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("label"), (k % 5).cast("int").alias("row"), ((k * 13) % WIDTH).cast("int").alias("col"), F.when(k % 3 == 0, "dry").otherwise("flood").alias("cls"))


#: The same views in DuckDB.
SQL_CELLS = f"""cells AS (SELECT *, z + (k % 7) / 10.0::DOUBLE AS filled, CASE WHEN z IS NOT NULL THEN size / 10.0::DOUBLE END AS hand FROM (
  SELECT p_partkey AS k, CAST(p_partkey // {WIDTH} AS INTEGER) AS r, CAST(p_partkey % {WIDTH} AS INTEGER) AS c, CASE WHEN p_partkey % 97 <> 13 THEN CAST((p_size - 10) / 10.0::DOUBLE AS DOUBLE) END AS z, p_size % 5 = 0 AS channel, p_size AS size FROM part)),
border AS (SELECT *, r = 0 OR r = (SELECT max(r) FROM cells) OR c IN (0, {WIDTH - 1}) AS b FROM cells)"""
SQL_LEVELS = f"""levels AS (SELECT hazard_type, rp AS return_period, round(mu - sigma * ln(-ln(1 - 1.0::DOUBLE / rp)), 6) AS water_level_m
  FROM (VALUES {', '.join(f"('{h}', {m}::DOUBLE, {s}::DOUBLE)" for h, (m, s) in LAWS.items())}) AS l(hazard_type, mu, sigma), (SELECT unnest([{', '.join(map(str, RETURN_PERIODS))}]) AS rp))"""
SQL_SERIES = "series AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY ALL)"
SQL_ANNUAL = "annual AS (SELECT l_returnflag AS series_id, CAST(year(l_shipdate) AS INTEGER) AS year, max(l_extendedprice) AS max_value FROM lineitem GROUP BY ALL)"
SQL_POINTS = f"points AS (SELECT s_suppkey AS label, CAST(s_suppkey % 5 AS INTEGER) AS r, CAST((s_suppkey * 13) % {WIDTH} AS INTEGER) AS c, CASE WHEN s_suppkey % 3 = 0 THEN 'dry' ELSE 'flood' END AS cls FROM supplier)"
SQL_TABLE_LEVELS = f"""{SQL_ANNUAL}, ends AS (SELECT series_id, median(max_value) / {METRE}::DOUBLE AS lo, max(max_value) / {METRE}::DOUBLE AS hi FROM annual GROUP BY 1),
laws AS (SELECT h AS hazard_type, (hi - lo) / (-ln(-ln(1 - 1 / 100.0::DOUBLE)) + ln(-ln(1 - 1 / 2.0::DOUBLE))) AS sigma, lo FROM ends JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SERIES_OF.items())}) AS named(s, h) ON s = series_id),
levels AS (SELECT hazard_type, rp AS return_period, round(lo + sigma * ln(-ln(1 - 1 / 2.0::DOUBLE)) - sigma * ln(-ln(1 - 1.0::DOUBLE / rp)), 6) AS water_level_m FROM laws, (SELECT unnest([{', '.join(map(str, RETURN_PERIODS))}]) AS rp))"""
