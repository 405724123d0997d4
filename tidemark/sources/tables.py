"""Scans and sinks: typed tables with checks, payloads, caches, upserts, discovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.depth import decoded
from tidemark.functions.hydrology import RETURN_PERIODS
from tidemark.operators.grid import from_tiles, to_tiles
from tidemark.sources.storage import stands

HAZARDS = ("coastal", "fluvial", "pluvial")
#: Stored no-data values of depth and elevation, severity and masks.
NODATA = {"dem": -9999.0, "severity": 255.0, "river": 0.0}

BASELINE = "hazard_type STRING, return_period INT, baseline_water_level_m DOUBLE, source_note STRING, gev_shape DOUBLE, gev_loc_mm DOUBLE, gev_scale_mm DOUBLE, datum_note STRING"
LEVELS = "hazard_type STRING, return_period INT, scenario STRING, horizon INT, water_level_m DOUBLE, scaling_factor DOUBLE, scaling_method STRING, source_note STRING, coastal_delta_m DOUBLE, coastal_delta_conversion STRING, coastal_source_url STRING"
SCENARIOS = "scenario STRING, horizon INT, water_level_m DOUBLE, source_note STRING, source_url STRING, location_id INT, location_lat DOUBLE, location_lon DOUBLE"
HOTSPOTS = "label STRING, lon DOUBLE, lat DOUBLE, class STRING, documented_depth_m DOUBLE, anchor_rp INT, source STRING, georef_confidence STRING"
#: Columns of the four manifest tables, and those that must not be empty.
MANIFEST = {
    "forcing_anchors": (("hazard", "duration_h", "anchor_rp", "anchor_value", "unit", "source", "citation"), True),
    "observed_events": (("event_id", "hazard", "event_date", "est_rp_low", "est_rp_high", "extent_path", "source"), False),
    "hotspots": (("name", "lon", "lat", "kind", "confidence", "source"), True),
    "gates": (("hazard", "metric", "threshold", "direction", "citation"), True),
}


def require_columns(df: DataFrame, *wanted: str) -> DataFrame:
    """``df``, or an error that lists the missing columns."""
    missing = sorted(set(wanted).difference(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str, *wanted: str) -> DataFrame:
    """A CSV file by its header; its columns are cast to those of ``schema`` and the wanted must exist."""
    raw = require_columns(spark.read.option("header", True).csv(path), *wanted)
    kinds = T.StructType.fromDDL(schema)
    return raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds])


def read_cells(spark: SparkSession, path: str, value: str = "z", nodata: float | None = None) -> DataFrame:
    """A cell table from Parquet; NaN and the no-data value read as null."""
    df = require_columns(spark.read.parquet(path), "row", "col", value)
    return df.withColumn(value, decoded(value, *([] if nodata is None else [nodata])))


def read_window(spark: SparkSession, path: str, row: int, column: int, half: int) -> DataFrame:
    """The cells around one; the range reaches the Parquet row groups."""
    return spark.read.parquet(path).where(F.col("row").between(row - half, row + half) & F.col("col").between(column - half, column + half))


def write_cells(df: DataFrame, path: str, value: str = "depth", kind: str = "float", *by: str) -> None:
    """A depth (float) or severity (smallint) table as partitioned Parquet."""
    df.withColumn(value, F.col(value).cast(kind)).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """The summary as one CSV in order; it has a row per hazard and return period."""
    df.orderBy("hazard_type", "return_period").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """Hazard levels; all three hazards must be there."""
    df = read_csv(spark, path, LEVELS, "hazard_type", "return_period", "scenario", "horizon", "water_level_m")
    absent = set(HAZARDS).difference(r.hazard_type for r in df.where(F.col("hazard_type").isin(*HAZARDS)).select("hazard_type").distinct().collect())
    if absent:
        raise ValueError(f"no levels for {', '.join(sorted(absent))}")
    return df


def table_problems(df: DataFrame | None, table: str) -> list[str]:
    """What is wrong with one manifest table: missing, lacking columns, or empty where it must not be."""
    wanted, filled = MANIFEST[table]
    if df is None:
        return [f"{table}: missing"]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        return [f"{table}: missing columns {', '.join(missing)}"]
    return [f"{table}: empty"] if filled and df.isEmpty() else []


def manifest_problems(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """All problems of a city's manifest."""
    found = [(t, p) for t in MANIFEST for p in table_problems(tables.get(t), t)]
    return spark.createDataFrame(found, "table_name string, problem string")


def hotspot_problems(points: DataFrame) -> DataFrame:
    """Rows of a hotspot table that break its rules, with the rule; ``line`` counts the header as 1."""
    rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("class").isin("flood", "dry"), F.lit(False)), "class must be flood or dry"),
            F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "source is blank"),
            F.when(~F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), "lon out of range"),
            F.when(~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "lat out of range"),
        )
    )
    return points.withColumn("problem", F.explode(rules))


def checked_hotspots(points: DataFrame) -> DataFrame:
    """The points, or an error with the first broken rule."""
    bad = hotspot_problems(points).first()
    if bad:
        raise ValueError(f"hotspot {bad.label}: {bad.problem}")
    return points


def manifest_hotspots(points: DataFrame) -> DataFrame:
    """Manifest hotspots in the scoring form: positives flood, dries dry, other kinds and unplaced points dropped."""
    cls = F.when(F.col("kind") == "positive", "flood").when(F.col("kind") == "dry", "dry")
    return points.where("lon is not null and lat is not null").select(F.col("name").alias("label"), "lon", "lat", cls.alias("cls"), "source", "confidence").where("cls is not null")


def hourly_payload(payloads: DataFrame, column: str = "payload", value: str = "precipitation", section: str = "hourly") -> DataFrame:
    """A series from JSON of parallel arrays: negatives null, the first of equal times kept."""
    parsed = payloads.select(F.from_json(column, f"{section} STRUCT<time: ARRAY<STRING>, {value}: ARRAY<DOUBLE>>").alias("p"))
    pairs = parsed.select(F.posexplode(F.arrays_zip(F.col(f"p.{section}.time").alias("t"), F.col(f"p.{section}.{value}").alias("v"))).alias("n", "z"))
    rows = pairs.select("n", F.try_to_timestamp("z.t").alias("ts"), F.when(F.col("z.v") >= 0, F.col("z.v")).alias("value")).where("ts is not null")
    first = Window.partitionBy("ts").orderBy("n")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("ts", "value")


def tide_gauge(rows: DataFrame, level: str = "sea_level") -> DataFrame:
    """Gauge rows in millimetres to metres: the row of units skipped, -32767 null."""
    v = F.col(level).try_cast("double")
    return rows.select(F.try_to_timestamp("time").alias("ts"), (F.nullif(v, F.lit(-32767.0)) / 1000).alias("value")).where("ts is not null")


def cache_key(workflow: Column, scenario: Column, lat: Column, lon: Column, percentile: Column, baseline: Column, year: Column) -> Column:
    """Key of a projection in the cache."""
    return F.concat_ws("|", workflow, scenario, F.format_string("%.4f", lat), F.format_string("%.4f", lon), percentile.cast("string"), baseline.cast("string"), year.cast("string"))


def read_cache(texts: DataFrame, column: str = "value") -> DataFrame:
    """Cache entries, one row each, from a JSON object of objects."""
    entry = "MAP<STRING, STRUCT<water_level_m: DOUBLE, source_note: STRING, source_url: STRING, location_id: INT, location_lat: DOUBLE, location_lon: DOUBLE>>"
    return texts.select(F.explode(F.from_json(column, entry)).alias("key", "entry")).select("key", "entry.*")


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, misses) of requests with a ``key``."""
    return requests.join(cache, "key"), requests.join(cache, "key", "left_anti")


def geocode_key(query: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.trim(query)).cast("binary")), 1, 16)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that stands at ``path``; where none is finished there, what ``build`` gives is written first."""
    if not stands(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_geocode(responses: DataFrame, west: float, east: float, south: float, north: float, column: str = "payload") -> DataFrame:
    """First result of each geocoder answer and whether it lies in the box."""
    hit = F.get(F.from_json(column, "results ARRAY<STRUCT<SEARCHVAL: STRING, LATITUDE: STRING, LONGITUDE: STRING>>")["results"], 0)
    placed = responses.withColumn("_h", hit).withColumn("lat", F.col("_h.LATITUDE").try_cast("double")).withColumn("lon", F.col("_h.LONGITUDE").try_cast("double")).withColumn("name", F.col("_h.SEARCHVAL")).drop("_h")
    return placed.withColumn("inside", F.coalesce(F.col("lon").between(west, east) & F.col("lat").between(south, north), F.lit(False)))


def replace_slice(table: DataFrame, new: DataFrame, hazard: str) -> DataFrame:
    """A hazard's rows replaced; columns that one side lacks are null there."""
    return table.where(F.col("hazard_type") != hazard).unionByName(new, allowMissingColumns=True)


def expected_outputs(spark: SparkSession, actual: DataFrame, hazards: tuple[str, ...] = HAZARDS, periods: tuple[int, ...] = RETURN_PERIODS) -> DataFrame:
    """Every hazard and return period, with ``done``: whether ``actual`` has it."""
    wanted = spark.createDataFrame([(h, rp) for h in hazards for rp in periods], "hazard_type string, return_period int")
    have = actual.select("hazard_type", "return_period").distinct().withColumn("done", F.lit(True))
    return wanted.join(F.broadcast(have), ["hazard_type", "return_period"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def bounded_polygons(rows: DataFrame, west: float, east: float, south: float, north: float, least: float = 0.7) -> DataFrame:
    """Footprints by confidence and box, filtered before any geometry is read."""
    return rows.where((F.col("confidence") >= least) & F.col("longitude").between(west, east) & F.col("latitude").between(south, north))


def ring_of(wkt: Column) -> Column:
    """Outer ring of a WKT polygon as structs (x, y)."""
    pairs = F.split(F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1), r"\s*,\s*")
    return F.transform(pairs, lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y")))


def decode_window(cells: DataFrame, value: str, nodata: float) -> DataFrame:
    """A window's cells with NaN and the no-data value null."""
    return cells.withColumn(value, decoded(value, nodata))


def write_tiles(cells: DataFrame, path: str, value: str = "z", size: int = 256) -> None:
    """A raster as one row per square tile of ``size`` cells, its values row by row."""
    to_tiles(cells, value, size).write.mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str, value: str = "z", size: int = 256, nodata: float | None = None) -> DataFrame:
    """The known cells of a tiled raster; NaN and the no-data value are left out."""
    cells = from_tiles(spark.read.parquet(path), value, size)
    return cells.withColumn(value, decoded(value, *([] if nodata is None else [nodata]))).where(F.col(value).isNotNull())


def packed_csv(spark: SparkSession, path: str, schema: str, *keep: Column) -> DataFrame:
    """Rows of (compressed) CSV files that pass all of ``keep``; the filters reach the scan, file by file."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    for condition in keep:
        rows = rows.where(condition)
    return rows


def first_match(spark: SparkSession, pattern: str, *names: str) -> DataFrame:
    """One row: the path of the first of ``names`` (with wildcards) that exists under a folder, the smallest of several; none if there is none."""
    found = []
    for n, name in enumerate(names):
        files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(pattern).select("path")
        found.append(files.select(F.lit(n).alias("n"), "path"))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.union(f)
    return all_.agg(F.min(F.struct("n", "path")).alias("m")).where("m is not null").select("m.path")
