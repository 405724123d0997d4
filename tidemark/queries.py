"""The library's registered queries over the derived views, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import depth as D
from tidemark.functions import geo
from tidemark.functions import hydrology as H
from tidemark.operators import graph, grid, ponding, scoring, solver, terrain, zonal
from tidemark.operators import series as S
from tidemark.plans import checks, forcing, hazard, views
from tidemark.plans.views import SQL_ANNUAL, SQL_CELLS, SQL_LEVELS, SQL_POINTS, SQL_SERIES, SQL_TABLE_LEVELS
from tidemark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def place() -> tuple[Column, Column]:
    """Row and column of a cell, named as in the SQL."""
    return F.col("row").alias("r"), F.col("col").alias("c")


LEVEL = 0.5
#: Cells reached from active border cells with z <= LEVEL; the neighbours' condition is to be filled in.
_FILL = """WITH RECURSIVE {cells}, act AS (SELECT * FROM border WHERE z <= {level}),
f(r, c) AS (SELECT r, c FROM act WHERE {seed} UNION SELECT a.r, a.c FROM f JOIN act a ON abs(a.r - f.r) <= 1 AND abs(a.c - f.c) <= 1 {near})"""


def _fill_sql(connectivity: int = 8, seed: str = "b", level: str = str(LEVEL)) -> str:
    return _FILL.format(cells=SQL_CELLS, level=level, seed=seed, near="" if connectivity == 8 else "AND abs(a.r - f.r) + abs(a.c - f.c) = 1")


# depth expressions


@query(f"WITH {SQL_CELLS}, {SQL_LEVELS} SELECT r, c, return_period, round(CASE WHEN z IS NOT NULL THEN greatest(water_level_m - z, 0) END, 6) AS depth FROM cells, levels WHERE hazard_type = 'coastal'")
def bathtub_depth(spark: SparkSession, sf: str) -> DataFrame:
    coastal = views.levels(spark).where("hazard_type = 'coastal'")
    return views.cells(spark, sf).join(F.broadcast(coastal)).select(*place(), "return_period", r6(D.bathtub("z", "water_level_m")).alias("depth"))


@query(f"WITH {SQL_CELLS}, {SQL_LEVELS} SELECT r, c, return_period, round(CASE WHEN hand IS NOT NULL THEN greatest(water_level_m - hand, 0) END, 6) AS depth FROM cells, levels WHERE hazard_type = 'fluvial'")
def hand_stage_depth(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).join(F.broadcast(views.levels(spark).where("hazard_type = 'fluvial'"))).select(*place(), "return_period", r6(D.hand_depth("hand", "water_level_m")).alias("depth"))


@query(f"WITH {SQL_CELLS} SELECT r, c, round(CASE WHEN z IS NOT NULL THEN least(0.3, greatest(filled - z, 0)) END, 6) AS depth FROM cells")
def ponding_depth(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).select(*place(), r6(D.lumped_ponding("z", "filled", 0.3)).alias("depth"))


_SEVERITY = "CASE WHEN d IS NULL THEN 255 WHEN d <= 0 THEN 0 WHEN d <= 0.15 THEN 1 WHEN d <= 0.5 THEN 2 WHEN d <= 1.0 THEN 3 ELSE 4 END"


@query(f"WITH {SQL_CELLS}, x AS (SELECT *, greatest(1.25 - z, 0) AS g FROM cells), y AS (SELECT r, c, CASE WHEN z IS NOT NULL THEN g END AS d FROM x) SELECT r, c, CAST({_SEVERITY} AS INTEGER) AS severity FROM y")
def severity_class(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).select(*place(), D.severity(D.bathtub("z", 1.25)).alias("severity"))


_BATH = f"{SQL_CELLS}, {SQL_LEVELS}, bath AS (SELECT hazard_type, return_period, r, c, CASE WHEN z IS NOT NULL THEN greatest(water_level_m - z, 0) END AS d FROM cells, levels)"


@query(
    f"WITH {_BATH} SELECT hazard_type, return_period, round(count(*) FILTER (d > 0 AND d <= 0.15) * 900.0 / 1e6, 6) AS minor_area_km2, round(count(*) FILTER (d > 0.15 AND d <= 0.5) * 900.0 / 1e6, 6) AS moderate_area_km2, "
    "round(count(*) FILTER (d > 0.5 AND d <= 1) * 900.0 / 1e6, 6) AS major_area_km2, round(count(*) FILTER (d > 1) * 900.0 / 1e6, 6) AS severe_area_km2 FROM bath GROUP BY ALL"
)
def severity_area(spark: SparkSession, sf: str) -> DataFrame:
    out = zonal.severity_areas(_bath(spark, sf), "hazard_type", "return_period")
    return out.select("hazard_type", "return_period", *[r6(c).alias(c) for c in out.columns[2:]])


def _bath(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).join(F.broadcast(views.levels(spark))).withColumn("depth", D.bathtub("z", "water_level_m"))


@query(
    f"WITH {_BATH} SELECT hazard_type, return_period, count(*) FILTER (d > 0) * 900.0::DOUBLE AS flooded_area_m2, round(count(*) FILTER (d > 0) * 900.0::DOUBLE / 1e6, 6) AS flooded_area_km2, "
    "round(coalesce(avg(d) FILTER (d > 0), 0), 6) AS mean_depth_m, round(coalesce(max(d) FILTER (d > 0), 0), 6) AS max_depth_m, count(*) FILTER (d > 0) AS wet_pixels FROM bath GROUP BY ALL"
)
def depth_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = zonal.depth_summary(_bath(spark, sf), "hazard_type", "return_period")
    return out.select("hazard_type", "return_period", "flooded_area_m2", *[r6(c).alias(c) for c in ("flooded_area_km2", "mean_depth_m", "max_depth_m")], "wet_pixels")


@query(f"WITH {SQL_CELLS}, x AS (SELECT r, c, CASE WHEN z IS NOT NULL THEN greatest(0.8 - z, 0) END AS a, CASE WHEN hand IS NOT NULL THEN greatest(1.5 - hand, 0) END AS b, CASE WHEN size % 11 <> 0 THEN size / 50.0::DOUBLE END AS d FROM cells) SELECT r, c, round(greatest(a, b, d), 6) AS depth FROM x")
def hazard_composite(spark: SparkSession, sf: str) -> DataFrame:
    return _three(spark, sf).select(*place(), r6(D.composite("a", "b", "d")).alias("depth"))


def _three(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).withColumns({"a": D.bathtub("z", 0.8), "b": D.hand_depth("hand", 1.5), "d": F.when(F.col("size") % 11 != 0, F.col("size") / 50.0)})


@query(
    f"WITH {SQL_CELLS}, x AS (SELECT r, c, coalesce(CASE WHEN z IS NOT NULL THEN greatest(0.8 - z, 0) END, 0) AS a, coalesce(CASE WHEN hand IS NOT NULL THEN greatest(1.5 - hand, 0) END, 0) AS b, coalesce(CASE WHEN size % 11 <> 0 THEN size / 50.0::DOUBLE END, 0) AS d FROM cells) "
    "SELECT r, c, CASE WHEN greatest(a, b, d) <= 0 THEN NULL WHEN a >= b AND a >= d THEN 'coastal' WHEN b >= d THEN 'fluvial' ELSE 'pluvial' END AS hazard FROM x"
)
def dominant_hazard(spark: SparkSession, sf: str) -> DataFrame:
    return _three(spark, sf).select(*place(), D.dominant({"coastal": "a", "fluvial": "b", "pluvial": "d"}).alias("hazard"))


@query(f"WITH {_BATH} SELECT r, c, round(quantile_cont(coalesce(d, 0), 0.5), 6) AS p50, round(quantile_cont(coalesce(d, 0), 0.9), 6) AS p90 FROM bath WHERE hazard_type = 'coastal' GROUP BY r, c HAVING count(d) > 0")
def depth_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = zonal.depth_percentiles(_bath(spark, sf).where("hazard_type = 'coastal'"), [50, 90])
    return out.where("p50 is not null").select(*place(), r6("p50").alias("p50"), r6("p90").alias("p90"))


@query(
    f"WITH {SQL_CELLS}, b AS (SELECT r, c, CASE WHEN z IS NOT NULL THEN greatest(1.0 - z, 0) END AS d, channel, size FROM cells) SELECT r, c, round(CASE WHEN d < 0.25 THEN 0 ELSE d END, 6) AS floored, round(CASE WHEN d IS NOT NULL THEN least(d, 0.6) END, 6) AS capped, "
    "round(CASE WHEN d IS NOT NULL THEN CASE WHEN channel THEN 0 ELSE d END END, 6) AS off_channel, round(CASE WHEN d IS NOT NULL THEN greatest(d - 0.2, 0) END, 6) AS present, CASE WHEN d IS NOT NULL THEN CAST((d >= 0.15)::INT + (d >= 0.5)::INT + (d >= 1.0)::INT AS INTEGER) END AS band FROM b"
)
def depth_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = views.cells(spark, sf).withColumn("d", D.bathtub("z", 1.0))
    return d.select(*place(), r6(D.floored("d", 0.25)).alias("floored"), r6(D.capped("d", 0.6)).alias("capped"), r6(D.zeroed("d", F.col("channel"))).alias("off_channel"), r6(D.present_day("d", 0.2)).alias("present"), D.banded("d", (0.15, 0.5, 1.0)).alias("band"))


@query(
    f"WITH {SQL_CELLS} SELECT r, c, round(CASE WHEN z IS NOT NULL THEN least(hand, greatest(0.9 - greatest(z, 0), 0) + 0.2) END, 6) AS coastal_capped, round(CASE WHEN z < 0 THEN 0 ELSE z END, 6) AS clamped, round(CASE WHEN z IS NOT NULL THEN CASE WHEN z < 0 THEN -z ELSE 0 END END, 6) AS preflood, "
    "round(CASE WHEN channel THEN z - 2 ELSE z END, 6) AS burned, round(CASE WHEN z IS NOT NULL THEN CASE WHEN size > 30 THEN greatest(z, 2.5) ELSE z END END, 6) AS crested FROM cells"
)
def terrain_rules(spark: SparkSession, sf: str) -> DataFrame:
    land = F.lit(True)
    return views.cells(spark, sf).select(
        *place(), r6(D.coastal_capped("hand", F.col("z"), 0.9)).alias("coastal_capped"), r6(D.land_clamped("z", land)).alias("clamped"), r6(D.preflooded("z", land)).alias("preflood"), r6(D.burned("z", F.col("channel"), 2.0)).alias("burned"), r6(D.crested("z", F.when(F.col("size") > 30, 2.5))).alias("crested")
    )


_RC = "CASE size * 10 % 110 WHEN 10 THEN 0.15 WHEN 20 THEN 0.25 WHEN 30 THEN 0.30 WHEN 40 THEN 0.35 WHEN 50 THEN 0.85 WHEN 60 THEN 0.50 WHEN 70 THEN 0.05 WHEN 80 THEN 1.00 WHEN 90 THEN 0.60 WHEN 95 THEN 0.60 WHEN 100 THEN 0.10 ELSE 0.40 END::DOUBLE"


@query(f"WITH {SQL_CELLS}, x AS (SELECT r, c, channel, {_RC} AS rc FROM cells) SELECT r, c, rc AS runoff, round(least(greatest(0.11 - 0.08 * rc, 0.03), 0.10), 6) AS manning_n, round(CASE WHEN channel THEN 0 ELSE 0.08 * rc END, 6) AS net_rain FROM x")
def land_cover_runoff(spark: SparkSession, sf: str) -> DataFrame:
    rc = D.runoff_coefficient(F.col("size") * 10 % 110)
    return views.cells(spark, sf).withColumn("rc", rc).select(*place(), F.col("rc").alias("runoff"), r6(D.roughness("rc")).alias("manning_n"), r6(D.net_rain(0.08, "rc", F.col("channel"))).alias("net_rain"))


# grids


@query(f"WITH {SQL_CELLS} SELECT CAST(r // 3 AS INTEGER) AS r, CAST(c // 3 AS INTEGER) AS c, round(max(z), 6) AS z FROM cells GROUP BY ALL")
def block_max(spark: SparkSession, sf: str) -> DataFrame:
    return grid.block_max(views.cells(spark, sf), "z", 3).select(*place(), r6("z").alias("z"))


@query(f"WITH {SQL_CELLS} SELECT CAST(r // 3 AS INTEGER) AS r, CAST(c // 3 AS INTEGER) AS c, round(avg(channel::INT), 6) AS fraction FROM cells GROUP BY 1, 2")
def block_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return grid.block_fraction(views.cells(spark, sf), "channel", 3).select(*place(), r6("fraction").alias("fraction"))


_TPI = f"""WITH {SQL_CELLS}, h AS (SELECT max(r) AS rm FROM cells), o AS (SELECT unnest(generate_series(-2, 2)) AS d),
w AS (SELECT a.r, a.c, any_value(a.z) AS z, avg(b.z) AS m FROM cells a CROSS JOIN o x CROSS JOIN o y CROSS JOIN h
  JOIN cells b ON b.r = least(greatest(a.r + x.d, 0), rm) AND b.c = least(greatest(a.c + y.d, 0), {views.WIDTH - 1}) GROUP BY a.r, a.c)"""


@query(f"{_TPI} SELECT r, c, round(m - z, 6) AS tpi FROM w")
def tpi_index(spark: SparkSession, sf: str) -> DataFrame:
    return grid.tpi(views.cells(spark, sf), "z", 5, width=views.WIDTH).select(*place(), r6("tpi").alias("tpi"))


@query(f"{_TPI}, t AS (SELECT r, c, m - z AS tpi FROM w), q AS (SELECT quantile_cont(tpi, 0.9) AS cut FROM t) SELECT r, c, CASE WHEN tpi IS NOT NULL THEN CASE WHEN tpi >= cut THEN 0.5 ELSE 0 END END::DOUBLE AS depth FROM t, q")
def tpi_flag(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.quantile_flag(grid.tpi(views.cells(spark, sf), "z", 5, width=views.WIDTH), "tpi", 0.1, 0.5).select(*place(), "depth")


@query(f"WITH {SQL_CELLS}, l AS (SELECT *, 1.0::DOUBLE + r * 0.01::DOUBLE AS lat FROM cells) SELECT r, c, round(z - CASE WHEN lat > 1.0 AND lat <= 1.1 THEN 0.675 WHEN lat > 1.1 AND lat <= 1.3 THEN 0.3 ELSE 0 END, 6) AS z FROM l")
def subsidence(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.createDataFrame([(1.0, 1.1, 4.5), (1.1, 1.3, 2.0)], "lat_min double, lat_max double, rate_cm_per_year double")
    lat = views.cells(spark, sf).withColumn("lat", 1.0 + F.col("row") * 0.01)
    return zonal.corrected_for_subsidence(lat, bands, 15.0).select(*place(), r6("z").alias("z"))


@query(f"WITH {SQL_CELLS} SELECT r, c, round(CASE WHEN z IS NOT NULL THEN CASE WHEN abs(r - 2) <= 1 AND c BETWEEN 5 AND 20 THEN greatest(z, 2.0) ELSE z END END, 6) AS z FROM cells")
def crest_burn(spark: SparkSession, sf: str) -> DataFrame:
    near = geo.segment_distance(F.col("col"), F.col("row"), 5.0, 2.0, 20.0, 2.0)
    inside = (near <= 1.0) & F.col("col").between(5, 20)
    return views.cells(spark, sf).select(*place(), r6(D.crested("z", F.when(inside, 2.0))).alias("z"))


@query(f"WITH {SQL_CELLS}, x AS (SELECT r, c, CASE WHEN z IS NOT NULL THEN greatest(1.0 - z, 0) END AS d, r + 0.5 BETWEEN 1 AND 4 AND c + 0.5 BETWEEN 10 AND 30 AS i, size FROM cells) SELECT r, c, round(CASE WHEN d IS NOT NULL AND i THEN CASE WHEN size / 10.0 >= 2.5 THEN 0 ELSE d * 0.4 END ELSE d END, 6) AS depth FROM x")
def polygon_protect(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 1.0), (30.0, 1.0), (30.0, 4.0), (10.0, 4.0))])
    inside = geo.in_ring(F.col("col") + 0.5, F.col("row") + 0.5, ring)
    return views.cells(spark, sf).select(*place(), r6(D.protected(D.bathtub("z", 1.0), inside, F.col("size") / 10.0, 2.5, 0.4)).alias("depth"))


@query(f"WITH {SQL_CELLS} SELECT r, c, round(z + CASE WHEN c BETWEEN 10 AND 30 THEN 0.5 WHEN c BETWEEN 5 AND 15 THEN 1.0 ELSE 0 END, 6) AS z FROM cells")
def natural_raise(spark: SparkSession, sf: str) -> DataFrame:
    zones = spark.createDataFrame([(1, 5.0, 15.0, -1.0, 1e9, 1.0), (2, 10.0, 30.0, -1.0, 1e9, 0.5)], "zone_no int, x_min double, x_max double, y_min double, y_max double, raise_m double")
    return zonal.zones_raised(views.cells(spark, sf).withColumn("x", F.col("col").cast("double")).withColumn("y", F.col("row").cast("double")), zones).select(*place(), r6("z").alias("z"))


@query(
    f"WITH {SQL_CELLS}, t AS (SELECT r * 2 + a.d AS r, c * 2 + b.d AS c, (r * 2 + a.d) / 2.0 - 0.25 AS sr, (c * 2 + b.d) / 2.0 - 0.25 AS sc FROM cells, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d)), "
    "w AS (SELECT t.r, t.c, sum(z * (1 - abs(sr - s.r)) * (1 - abs(sc - s.c))) / nullif(sum((1 - abs(sr - s.r)) * (1 - abs(sc - s.c))), 0) AS z FROM t JOIN cells s ON abs(sr - s.r) < 1 AND abs(sc - s.c) < 1 AND s.z IS NOT NULL GROUP BY t.r, t.c) SELECT CAST(t.r AS INTEGER) AS r, CAST(t.c AS INTEGER) AS c, round(CAST(w.z AS DOUBLE), 6) AS z FROM t LEFT JOIN w USING (r, c)"
)
def bilinear_resample(spark: SparkSession, sf: str) -> DataFrame:
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    fine = views.cells(spark, sf).select((F.col("row") * 2).alias("r2"), (F.col("col") * 2).alias("c2")).withColumn("a", half).withColumn("b", half).select((F.col("r2") + F.col("a")).alias("row"), (F.col("c2") + F.col("b")).alias("col"))
    target = fine.withColumn("src_row", F.col("row") / 2.0 - 0.25).withColumn("src_col", F.col("col") / 2.0 - 0.25)
    return grid.resample(views.cells(spark, sf), "z", target).select(*place(), r6("z").alias("z"))


@query(f"WITH {SQL_CELLS}, m AS (SELECT a.r, a.c, median(b.z) AS m FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.z IS NOT NULL GROUP BY a.r, a.c) SELECT r, c, round(CASE WHEN z IS NOT NULL THEN m END, 6) AS z FROM cells LEFT JOIN m USING (r, c)")
def median_filter(spark: SparkSession, sf: str) -> DataFrame:
    return grid.median_filtered(views.cells(spark, sf), "z", 3).select(*place(), r6("z").alias("z"))


@query(
    f"WITH {SQL_CELLS}, m AS (SELECT a.r, a.c, median(b.z) AS m FROM cells a JOIN cells b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 AND (a.r <> b.r OR a.c <> b.c) AND b.z >= -0.5 WHERE a.z < -0.5 GROUP BY a.r, a.c) SELECT r, c, round(CASE WHEN z < -0.5 THEN m ELSE z END, 6) AS z FROM cells LEFT JOIN m USING (r, c)"
)
def spike_repair(spark: SparkSession, sf: str) -> DataFrame:
    return grid.spikes_repaired(views.cells(spark, sf), "z", -0.5, 5).select(*place(), r6("z").alias("z"))


# connectivity and flow


@query(_fill_sql(8) + " SELECT r, c FROM f")
def flood_fill_8(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf)
    return graph.flood_fill(g, F.col("z") <= LEVEL, 8, on_border=views.on_border(g)).select(*place())


@query(_fill_sql(4) + " SELECT r, c FROM f")
def flood_fill_4(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf)
    return graph.flood_fill(g, F.col("z") <= LEVEL, 4, on_border=views.on_border(g)).select(*place())


@query(_fill_sql(8, level="0.49999999") + f" SELECT g.r, g.c, round(CASE WHEN z IS NOT NULL THEN CASE WHEN f.r IS NOT NULL THEN {LEVEL} - z ELSE 0 END END, 6) AS depth FROM cells g LEFT JOIN f USING (r, c)")
def connectivity_filter(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf)
    return hazard.single_scenario(g, LEVEL, views.on_border(g)).select(*place(), r6("depth").alias("depth"))


@query(
    f"WITH RECURSIVE {SQL_CELLS}, low AS (SELECT * FROM border WHERE z <= 0), non AS (SELECT * FROM border WHERE z IS NULL), lake AS (SELECT * FROM border WHERE z <= 0.3), "
    "f(r, c) AS (SELECT r, c FROM low WHERE b UNION SELECT a.r, a.c FROM f JOIN low a ON abs(a.r - f.r) <= 1 AND abs(a.c - f.c) <= 1), "
    "g(r, c) AS (SELECT r, c FROM non WHERE b UNION SELECT a.r, a.c FROM g JOIN non a ON abs(a.r - g.r) <= 1 AND abs(a.c - g.c) <= 1), "
    "h(r, c) AS (SELECT r, c FROM lake WHERE r = 2 AND c = 20 UNION SELECT a.r, a.c FROM h JOIN lake a ON abs(a.r - h.r) <= 1 AND abs(a.c - h.c) <= 1) "
    "SELECT r, c, CAST(CASE WHEN (r, c) IN (SELECT (r, c) FROM f UNION SELECT (r, c) FROM g UNION SELECT (r, c) FROM h) THEN 0 WHEN z IS NULL THEN 255 ELSE 1 END AS INTEGER) AS code FROM cells"
)
def sea_mask_three_pass(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf)
    sea = graph.sea_mask(g, views.on_border(g), lake_seeds=[((F.col("row") == 2) & (F.col("col") == 20), 0.3)])
    return g.select("row", "col", "z").join(sea, ["row", "col"]).select(*place(), graph.sea_code(F.col("sea"), F.col("z")).alias("code"))


@query(
    f"WITH RECURSIVE {SQL_CELLS}, low AS (SELECT * FROM border WHERE z <= 0), sea(r, c) AS (SELECT r, c FROM low WHERE b UNION SELECT a.r, a.c FROM sea JOIN low a ON abs(a.r - sea.r) <= 1 AND abs(a.c - sea.c) <= 1), "
    "ok AS (SELECT r, c FROM cells WHERE channel AND z <= 2 AND (r, c) NOT IN (SELECT (r, c) FROM sea)), "
    "t(r, c) AS (SELECT DISTINCT ok.r, ok.c FROM ok JOIN sea ON abs(ok.r - sea.r) <= 1 AND abs(ok.c - sea.c) <= 1 UNION SELECT a.r, a.c FROM t JOIN ok a ON abs(a.r - t.r) <= 1 AND abs(a.c - t.c) <= 1) SELECT r, c FROM t"
)
def tidal_seeds(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf)
    sea = graph.sea_mask(g, views.on_border(g), through_nodata=False)
    return graph.tidal_seeds(g.join(sea, ["row", "col"]), "sea", "channel", 2.0).select(*place())


_LABELS = f"""WITH RECURSIVE {SQL_CELLS}, act AS (SELECT r, c, r * {views.WIDTH} + c AS id FROM cells WHERE z <= {LEVEL}),
l(r, c, root) AS (SELECT r, c, id FROM act UNION SELECT a.r, a.c, l.root FROM l JOIN act a ON abs(a.r - l.r) <= 1 AND abs(a.c - l.c) <= 1 WHERE l.root < a.id),
lab AS (SELECT r, c, min(root) AS label FROM l GROUP BY r, c)"""


@query(_LABELS + " SELECT r, c, CAST(label AS BIGINT) AS label FROM lab")
def components(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.label_components(views.cells(spark, sf), F.col("z") <= LEVEL)
    _, row, column = grid.id_parts(F.col("label"))
    return found.select(*place(), (row * views.WIDTH + column).cast("long").alias("label"))


@query(_LABELS + f" , n AS (SELECT label, count(*) AS n FROM lab GROUP BY label) SELECT g.r, g.c, round(CASE WHEN z IS NOT NULL THEN CASE WHEN n.n < 6 THEN 0 ELSE greatest({LEVEL} + 0.05 + 1e-9 - z, 0) END END, 6) AS depth FROM cells g LEFT JOIN lab USING (r, c) LEFT JOIN n USING (label)")
def denoise(spark: SparkSession, sf: str) -> DataFrame:
    wet = views.cells(spark, sf).withColumn("depth", D.bathtub("z", LEVEL + 0.05 + 1e-9))
    return graph.denoised(wet).select(*place(), r6("depth").alias("depth"))


_SMOOTH = f"""{SQL_CELLS}, smooth AS (SELECT a.r, a.c, round(avg(b.z), 6) AS z FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 WHERE a.z IS NOT NULL GROUP BY a.r, a.c),
slopes AS (SELECT a.r, a.c, (b.r - a.r + 1) * 3 + (b.c - a.c + 1) - CASE WHEN (b.r - a.r + 1) * 3 + (b.c - a.c + 1) > 4 THEN 1 ELSE 0 END AS d, (a.z - b.z) / CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END AS s, b.r AS br, b.c AS bc
  FROM smooth a JOIN smooth b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.z > b.z),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY s DESC, d) AS n FROM slopes) WHERE n = 1),
flow AS (SELECT s.r, s.c, s.z, coalesce(b.d, -1) AS d, coalesce(b.br, s.r) AS nr, coalesce(b.bc, s.c) AS nc FROM smooth s LEFT JOIN best b USING (r, c))"""


def smooth(spark: SparkSession, sf: str) -> DataFrame:
    """The grid's 3x3 means."""
    g = views.cells(spark, sf)
    return grid.focal(g, "z", 1, F.round(F.avg("v"), 6), "z", F.col("z").isNotNull())


@query(f"WITH {_SMOOTH} SELECT r, c, CAST(d AS INTEGER) AS d8 FROM flow")
def d8_raw(spark: SparkSession, sf: str) -> DataFrame:
    return graph.d8(smooth(spark, sf)).select(*place(), "d8")


_PATH = f"WITH RECURSIVE {_SMOOTH}, p(r, c, tr, tc) AS (SELECT r, c, r, c FROM flow UNION SELECT p.r, p.c, f.nr, f.nc FROM p JOIN flow f ON f.r = p.tr AND f.c = p.tc), term AS (SELECT p.r, p.c, p.tr, p.tc FROM p JOIN flow f ON f.r = p.tr AND f.c = p.tc WHERE f.d = -1)"


@query(_PATH + f" SELECT r, c, CAST(tr * {views.WIDTH} + tc AS BIGINT) AS terminal FROM term")
def d8_terminal(spark: SparkSession, sf: str) -> DataFrame:
    ends = graph.terminals(graph.flow_edges(graph.d8(smooth(spark, sf))))
    (_, r, c), (_, tr, tc) = grid.id_parts(F.col("cell")), grid.id_parts(F.col("terminal"))
    return ends.select(r.alias("r"), c.alias("c"), (tr * views.WIDTH + tc).cast("long").alias("terminal"))


@query(_PATH + " SELECT tr AS r, tc AS c, round(sum(coalesce(g.size, 0) * 0.01), 6) AS supply FROM term JOIN cells g USING (r, c) GROUP BY tr, tc")
def catchment_supply(spark: SparkSession, sf: str) -> DataFrame:
    flow = graph.d8(smooth(spark, sf))
    pits = grid.with_id(flow.where("d8 = -1"), "dep").select("row", "col", "dep")
    supply = ponding.catchment_supply(views.cells(spark, sf), flow, pits, F.col("size") * 0.01)
    _, r, c = grid.id_parts(F.col("dep"))
    return supply.select(r.alias("r"), c.alias("c"), r6("supply").alias("supply"))


@query(_PATH + " SELECT tr AS r, tc AS c, count(DISTINCT (r, c)) AS cells FROM p GROUP BY tr, tc")
def flow_accumulation(spark: SparkSession, sf: str) -> DataFrame:
    acc = graph.accumulation(graph.flow_edges(graph.d8(smooth(spark, sf))))
    _, r, c = grid.id_parts(F.col("cell"))
    return acc.select(r.alias("r"), c.alias("c"), F.col("amount").cast("long").alias("cells"))


@query(
    f"WITH RECURSIVE {_SMOOTH}, e AS (SELECT flow.*, g.channel FROM flow JOIN cells g USING (r, c)), p(r, c, tr, tc, stop) AS (SELECT r, c, r, c, channel FROM e UNION SELECT p.r, p.c, e2.r, e2.c, e2.channel FROM p JOIN e ON e.r = p.tr AND e.c = p.tc JOIN e e2 ON e2.r = e.nr AND e2.c = e.nc WHERE NOT p.stop AND e.d <> -1) "
    "SELECT s.r, s.c, round(CASE WHEN t.z IS NOT NULL THEN greatest(s.z - t.z, 0) END, 6) AS hand FROM smooth s LEFT JOIN (SELECT p.r, p.c, x.z FROM p JOIN smooth x ON x.r = p.tr AND x.c = p.tc WHERE p.stop) t USING (r, c)"
)
def hand_from_d8(spark: SparkSession, sf: str) -> DataFrame:
    s = smooth(spark, sf).join(views.cells(spark, sf).select("row", "col", "channel"), ["row", "col"])
    found = graph.hand(s, graph.d8(s), F.col("channel"))
    return found.select(*place(), r6(F.when(F.col("hand").isNotNull(), F.col("hand"))).alias("hand"))


_INV = f"""WITH RECURSIVE {SQL_CELLS}, act AS (SELECT r, c, z, z + 0.8 AS fl, r * {views.WIDTH} + c AS id FROM cells WHERE z <= {LEVEL}),
l(r, c, root) AS (SELECT r, c, id FROM act UNION SELECT a.r, a.c, l.root FROM l JOIN act a ON abs(a.r - l.r) <= 1 AND abs(a.c - l.c) <= 1 WHERE l.root < a.id),
lab AS (SELECT r, c, min(root) AS label FROM l GROUP BY r, c)"""


@query(_INV + " SELECT CAST(label AS BIGINT) AS dep, round(max(fl), 6) AS pour_elev, round(sum(fl - z) * 900, 4) AS capacity_m3, count(*) AS n_cells FROM act JOIN lab USING (r, c) GROUP BY label HAVING count(*) >= 9")
def depression_inventory(spark: SparkSession, sf: str) -> DataFrame:
    surface = views.cells(spark, sf).select("row", "col", "z", F.when(F.col("z") <= LEVEL, F.col("z") + 0.8).otherwise(F.col("z")).alias("filled"))
    _, found = ponding.inventory(surface, 900.0)
    _, r, c = grid.id_parts(F.col("dep"))
    return found.select((r * views.WIDTH + c).cast("long").alias("dep"), r6("pour_elev").alias("pour_elev"), F.round("capacity_m3", 4).alias("capacity_m3"), "n_cells")


@query(
    f"WITH RECURSIVE {SQL_CELLS}, known AS (SELECT r, c, z FROM cells WHERE z IS NOT NULL), nb AS (SELECT a.r, a.c, count(*) - 1 AS n FROM known a JOIN known b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c), "
    "thr AS (SELECT DISTINCT z AS h FROM known), w(r, c, h) AS (SELECT k.r, k.c, h FROM known k JOIN nb USING (r, c), thr WHERE n < 8 AND k.z <= h UNION SELECT k.r, k.c, w.h FROM w JOIN known k ON abs(k.r - w.r) <= 1 AND abs(k.c - w.c) <= 1 AND k.z <= w.h) "
    "SELECT r, c, round(min(h), 6) AS filled FROM w GROUP BY r, c"
)
def fill_depressions(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.filled_surface(views.cells(spark, sf)).where("filled is not null").select(*place(), r6("filled").alias("filled"))


@query(f"WITH {SQL_CELLS}, o AS (SELECT r, c FROM cells WHERE channel) SELECT g.r, g.c, round(min(sqrt((g.r - o.r) ** 2 + (g.c - o.c) ** 2)) * 30, 6) AS distance FROM cells g, o GROUP BY g.r, g.c")
def outlet_distance(spark: SparkSession, sf: str) -> DataFrame:
    return graph.outlet_distance(views.cells(spark, sf), F.col("channel"), 30.0).select(*place(), r6("distance").alias("distance"))


_D = "(({b}.r - {a}.r + 1) * 3 + ({b}.c - {a}.c + 1) - CASE WHEN ({b}.r - {a}.r + 1) * 3 + ({b}.c - {a}.c + 1) > 4 THEN 1 ELSE 0 END)"
_NEAR = "abs({a}.r - {b}.r) <= 1 AND abs({a}.c - {b}.c) <= 1"
_AB = _NEAR.format(a="a", b="b")
_FILLED = f"""WITH RECURSIVE {SQL_CELLS}, known AS (SELECT r, c, z FROM cells WHERE z IS NOT NULL), nb AS (SELECT a.r, a.c, count(*) - 1 AS n FROM known a JOIN known b ON {_AB} GROUP BY a.r, a.c),
thr AS (SELECT DISTINCT z AS h FROM known), w(r, c, h) AS (SELECT k.r, k.c, h FROM known k JOIN nb USING (r, c), thr WHERE n < 8 AND k.z <= h UNION SELECT k.r, k.c, w.h FROM w JOIN known k ON {_NEAR.format(a="k", b="w")} AND k.z <= w.h),
fl AS (SELECT r, c, min(h) AS z FROM w GROUP BY r, c)"""
#: Flats drain by rings: n steps to a cell that drains, over cells of the same height.
_CONDITIONED = f"""{_FILLED}, falls AS (SELECT a.r, a.c, {_D.format(a="a", b="b")} AS d, (a.z - b.z) / CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END AS s FROM fl a JOIN fl b ON {_AB} AND a.z > b.z),
steep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY s DESC, d) AS k FROM falls) WHERE k = 1),
base AS (SELECT fl.r, fl.c, fl.z, coalesce(steep.d, -1) AS d, steep.d IS NOT NULL OR nb.n < 8 AS drains FROM fl JOIN nb USING (r, c) LEFT JOIN steep USING (r, c)),
ring(r, c, z, n) AS (SELECT r, c, z, 0 FROM base WHERE drains UNION SELECT a.r, a.c, a.z, b.n + 1 FROM ring b JOIN base a ON {_AB} AND a.z = b.z AND NOT a.drains WHERE b.n < 80),
far AS (SELECT r, c, any_value(z) AS z, min(n) AS n FROM ring GROUP BY r, c),
way AS (SELECT a.r, a.c, min({_D.format(a="a", b="b")}) AS d FROM far a JOIN far b ON {_AB} AND a.z = b.z AND b.n = a.n - 1 GROUP BY a.r, a.c),
cond AS (SELECT base.r, base.c, base.z, CASE WHEN drains THEN base.d ELSE coalesce(way.d, -1) END AS d FROM base LEFT JOIN way USING (r, c))"""


@query(_CONDITIONED + " SELECT r, c, CAST(d AS INTEGER) AS d8 FROM cond")
def conditioned_flow(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.conditioned_directions(views.cells(spark, sf)).select(*place(), "d8")


@query(
    f"""{_FILLED}, low AS (SELECT r, c, k.z, fl.z AS f, r * {views.WIDTH} + c AS id FROM known k JOIN fl USING (r, c) WHERE fl.z - k.z > 0),
l(r, c, root) AS (SELECT r, c, id FROM low UNION SELECT a.r, a.c, b.root FROM l b JOIN low a ON {_AB} WHERE b.root < a.id),
lab AS (SELECT r, c, min(root) AS label FROM l GROUP BY r, c), pit AS (SELECT label FROM lab JOIN low USING (r, c) GROUP BY label HAVING max(f - z) < 0.5),
up AS (SELECT r, c, f FROM lab JOIN pit USING (label) JOIN low USING (r, c)) SELECT g.r, g.c, round(coalesce(f, z), 6) AS z, f IS NOT NULL AS raised FROM cells g LEFT JOIN up USING (r, c)"""
)
def depit_noise(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.depitted(views.cells(spark, sf)).select(*place(), r6("z").alias("z"), "raised")


@query(
    f"""{_CONDITIONED}, runs AS (SELECT cond.r, cond.c, coalesce(b.r, cond.r) AS nr, coalesce(b.c, cond.c) AS nc FROM cond LEFT JOIN cond b ON cond.d >= 0 AND {_NEAR.format(a="cond", b="b")} AND {_D.format(a="cond", b="b")} = cond.d AND (b.r <> cond.r OR b.c <> cond.c)),
p(r, c, tr, tc) AS (SELECT r, c, r, c FROM runs UNION SELECT p.r, p.c, f.nr, f.nc FROM p JOIN runs f ON f.r = p.tr AND f.c = p.tc), area AS (SELECT tr AS r, tc AS c, count(DISTINCT (r, c)) AS n FROM p GROUP BY tr, tc),
fall AS (SELECT a.r, a.c, greatest(max((a.z - b.z) / (CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END * 30.0)), 0) AS s FROM fl a JOIN fl b ON {_AB} AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c)
SELECT g.r, g.c, round(ln((n + 1) * 30.0::DOUBLE / greatest(coalesce(s, 0), 1e-3)), 6) AS twi FROM cells g LEFT JOIN area USING (r, c) LEFT JOIN fall USING (r, c)"""
)
def twi_index(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.twi(views.cells(spark, sf)).select(*place(), r6("twi").alias("twi"))


#: Depressions of the filled surface, where each spills to, and what their overflow brings to the next, settled one by one from above.
_SPILL = f"""{_CONDITIONED}, pool AS (SELECT r, c, k.z, fl.z AS f, r * {views.WIDTH} + c AS id FROM known k JOIN fl USING (r, c) WHERE fl.z - k.z > 0),
pl(r, c, root) AS (SELECT r, c, id FROM pool UNION SELECT a.r, a.c, b.root FROM pl b JOIN pool a ON {_AB} WHERE b.root < a.id),
plab AS (SELECT r, c, min(root) AS dep FROM pl GROUP BY r, c),
deps AS (SELECT dep, max(f) AS pour, sum(f - z) * 900 AS cap FROM plab JOIN pool USING (r, c) GROUP BY dep HAVING count(*) >= 3 AND max(f - z) BETWEEN 0.5 AND 3.0),
dcell AS (SELECT r, c, z, dep FROM plab JOIN pool USING (r, c) JOIN deps USING (dep)),
rfall AS (SELECT a.r, a.c, {_D.format(a="a", b="b")} AS d, (a.z - b.z) / CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END AS s, b.r AS nr, b.c AS nc FROM known a JOIN known b ON {_AB} AND a.z > b.z),
rstep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY s DESC, d) AS k FROM rfall) WHERE k = 1),
rp0(r, c, tr, tc) AS (SELECT r, c, r, c FROM known UNION SELECT p.r, p.c, x.nr, x.nc FROM rp0 p JOIN rstep x ON x.r = p.tr AND x.c = p.tc),
unit AS (SELECT dep, count(*) * 900.0::DOUBLE AS w FROM rp0 JOIN dcell ON dcell.r = tr AND dcell.c = tc WHERE (tr, tc) NOT IN (SELECT (r, c) FROM rstep) GROUP BY dep),
step AS (SELECT a.r, a.c, b.r AS nr, b.c AS nc FROM cond a JOIN cond b ON a.d >= 0 AND {_AB} AND (a.r <> b.r OR a.c <> b.c) AND {_D.format(a="a", b="b")} = a.d),
walk(dep, r, c, hit, fin) AS (SELECT dep, CAST(dep // {views.WIDTH} AS INTEGER), CAST(dep % {views.WIDTH} AS INTEGER), CAST(NULL AS BIGINT), (SELECT any_value(z < -0.8) FROM known WHERE known.r * {views.WIDTH} + known.c = dep) FROM deps
  UNION ALL SELECT w.dep, s.nr, s.nc, CASE WHEN o.dep <> w.dep THEN o.dep END, coalesce(o.dep <> w.dep, FALSE) OR k.z < -0.8 FROM walk w JOIN step s ON s.r = w.r AND s.c = w.c JOIN known k ON k.r = s.nr AND k.c = s.nc LEFT JOIN dcell o ON o.r = s.nr AND o.c = s.nc WHERE NOT w.fin),
spill AS (SELECT dep, max(hit) AS dest FROM walk GROUP BY dep),
upto(dep, n) AS (SELECT dep, 0 FROM deps UNION SELECT s.dest, u.n + 1 FROM upto u JOIN spill s ON s.dep = u.dep WHERE s.dest IS NOT NULL AND u.n < 500),
ranked AS (SELECT dep, row_number() OVER (ORDER BY max(n), dep) AS i FROM upto GROUP BY dep),
lined AS (SELECT list(cap ORDER BY r.i) AS caps, list(coalesce(w, 0) ORDER BY r.i) AS units, list(coalesce(t.i, 0) ORDER BY r.i) AS dests FROM ranked r JOIN deps USING (dep) LEFT JOIN unit USING (dep) JOIN spill USING (dep) LEFT JOIN ranked t ON t.dep = spill.dest),
rain AS (SELECT return_period, water_level_m AS x FROM levels WHERE hazard_type = 'pluvial'),
fill(return_period, i, water) AS (SELECT return_period, 0, list_transform(units, lambda u: u * x) FROM rain, lined
  UNION ALL SELECT return_period, i + 1, list_transform(water, lambda v, j: v + CASE WHEN j = dests[i + 1] THEN greatest(water[i + 1] - caps[i + 1], 0) ELSE 0 END) FROM fill, lined WHERE i < len(caps)),
inflow AS (SELECT return_period, dep, water[ranked.i] AS v FROM fill, ranked, lined WHERE fill.i = len(caps)),
bed AS (SELECT dep, z, count(*) OVER w AS n, sum(z) OVER w AS s FROM dcell WINDOW w AS (PARTITION BY dep ORDER BY z, r, c ROWS UNBOUNDED PRECEDING)),
level AS (SELECT return_period, dep, CASE WHEN v >= any_value(cap) THEN any_value(pour) WHEN v <= 0 THEN min(z) ELSE least(min((v / 900 + s) / n), any_value(pour)) END AS h FROM inflow JOIN bed USING (dep) JOIN deps USING (dep) GROUP BY return_period, dep, v)"""


@query(
    _SPILL.replace("known AS (", f"{SQL_LEVELS}, known AS (", 1)
    + " SELECT g.r, g.c, return_period, round(CASE WHEN g.z IS NOT NULL THEN CASE WHEN coalesce(h - g.z, 0) < 0.05 THEN 0 ELSE h - g.z END END, 6) AS depth FROM cells g CROSS JOIN rain LEFT JOIN dcell USING (r, c) LEFT JOIN level USING (return_period, dep)"
)
def fill_spill_route(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf).select("row", "col", "z")
    topo = ponding.topography(g, g.where("z < -0.8").select("row", "col"), min_cells=3)
    excess = views.levels(spark).where("hazard_type = 'pluvial'").select("return_period", F.col("water_level_m").alias("excess_m"))
    return ponding.route(topo, excess).select(*place(), "return_period", r6("depth").alias("depth"))


# series and formulas


@query(f"WITH {SQL_SERIES}, w AS (SELECT series_id, ts, sum(value) OVER w AS s, count(value) OVER w AS n FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT series_id, ts, round(CASE WHEN n >= 3 THEN s END, 4) AS rolled FROM w")
def rolling_sum_6h(spark: SparkSession, sf: str) -> DataFrame:
    return S.rolling_sum(views.series(spark, sf), 6).select("series_id", "ts", F.round("rolled", 4).alias("rolled"))


@query("SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, round(CASE WHEN count(value) >= 3 THEN sum(value) END, 4) AS value, count(value) AS n FROM events GROUP BY 1, 2")
def tumbling_hour(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    return S.hourly_sum(e, least=3).select("series_id", "hour", F.round("value", 4).alias("value"), "n")


@query("SELECT l_returnflag AS series_id, CAST(year(l_shipdate) AS INTEGER) AS year, max(l_extendedprice) AS max_value, count(l_extendedprice) AS n_valid FROM lineitem GROUP BY 1, 2 HAVING count(l_extendedprice) >= 100")
def annual_max_gated(spark: SparkSession, sf: str) -> DataFrame:
    li = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"))
    return S.annual_maxima(li, 100)


_GUMBEL = f"{SQL_ANNUAL}, a AS (SELECT series_id, median(max_value) AS lo, max(max_value) AS hi FROM annual GROUP BY 1), g AS (SELECT series_id, (hi - lo) / (-ln(-ln(1 - 1 / 100.0)) + ln(-ln(1 - 1 / 2.0))) AS sigma, lo, hi FROM a), law AS (SELECT series_id, sigma, lo + sigma * ln(-ln(1 - 1 / 2.0)) AS mu FROM g)"


def _law(spark: SparkSession, sf: str) -> DataFrame:
    a = views.annual_max(spark, sf).groupBy("series_id").agg(F.median("max_value").alias("lo"), F.max("max_value").alias("hi"))
    return a.select("series_id", H.gumbel_scale(2, "lo", 100, "hi").alias("sigma"), H.gumbel_location(2, "lo", 100, "hi").alias("mu"))


@query(f"WITH {_GUMBEL} SELECT series_id, round(mu, 4) AS mu, round(sigma, 4) AS sigma FROM law")
def gumbel_fit_two_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return _law(spark, sf).select("series_id", F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"))


_PERIODS = f"(SELECT unnest([{', '.join(map(str, H.RETURN_PERIODS))}]) AS rp)"


@query(
    f"WITH {_GUMBEL} SELECT series_id, xi, rp AS return_period, round(CASE WHEN xi = 0 THEN m - s * ln(-ln(1 - 1.0::DOUBLE / rp)) ELSE m + s / xi * (pow(-ln(1 - 1.0::DOUBLE / rp), -xi) - 1) END, 6) AS level "
    f"FROM (SELECT series_id, mu / 1000 AS m, sigma / 1000 AS s FROM law), (SELECT unnest([-0.2, 0.0, 0.1, 0.3])::DOUBLE AS xi), {_PERIODS}"
)
def gev_return_levels(spark: SparkSession, sf: str) -> DataFrame:
    law = _law(spark, sf).select("series_id", (F.col("mu") / 1000).alias("mu"), (F.col("sigma") / 1000).alias("sigma"), F.explode(F.array(*[F.lit(x) for x in (-0.2, 0.0, 0.1, 0.3)])).alias("xi"))
    return law.join(F.broadcast(forcing.return_periods(spark))).select("series_id", "xi", "return_period", r6(H.gev_quantile("xi", "mu", "sigma", "return_period")).alias("level"))


@query(f"WITH {_GUMBEL}, p AS (SELECT annual.series_id, year, least(greatest(exp(-exp(-(max_value - mu) / sigma)), 1e-9), 1 - 1e-9) AS f FROM annual JOIN law USING (series_id)) SELECT series_id, year, round(1 / (1 - f), 4) AS rp FROM p")
def implied_return_period(spark: SparkSession, sf: str) -> DataFrame:
    rp = H.gev_return_period(0.0, "mu", "sigma", "max_value")
    return views.annual_max(spark, sf).join(F.broadcast(_law(spark, sf)), "series_id").select("series_id", "year", F.round(rp, 4).alias("rp"))


@query(
    "WITH q AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * 5.0::DOUBLE AS p, 25400 / 85.0::DOUBLE - 254 AS s FROM lineitem), x AS (SELECT k, n, CASE WHEN p <= 0.2 * s THEN 0 ELSE (p - 0.2 * s) ** 2 / (p + 0.8 * s) END AS run FROM q), "
    "y AS (SELECT *, greatest(0.208 * 10 * run / (24 / 2.0 + 0.6 * 0.5), 0) AS peak FROM x) SELECT k, n, round(run, 6) AS runoff_mm, round(peak, 6) AS peak_m3s, round(CASE WHEN peak <= 0 THEN 0 ELSE pow(peak * 0.04 / (10 * sqrt(0.002)), 0.6) END, 6) AS stage_m FROM y"
)
def scs_manning_stage(spark: SparkSession, sf: str) -> DataFrame:
    li = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 5.0).alias("p")).withColumn("run", H.scs_runoff("p", 85.0)).withColumn("peak", H.scs_peak_discharge("run", 10, 24, 0.5))
    return li.select("k", "n", r6("run").alias("runoff_mm"), r6("peak").alias("peak_m3s"), r6(H.manning_stage("peak", 10, 0.04, 0.002)).alias("stage_m"))


_SCEN = ", ".join(f"('{s}', {h}, {w[0]}::DOUBLE, {w[0] / 5}::DOUBLE)" for (s, h), w in forcing.WARMING.items())


@query(
    f"WITH {SQL_TABLE_LEVELS}, s(scenario, horizon, warming, delta) AS (VALUES {_SCEN}) SELECT hazard_type, return_period, scenario, CAST(horizon AS INTEGER) AS horizon, "
    "round(CASE hazard_type WHEN 'coastal' THEN water_level_m + delta WHEN 'fluvial' THEN water_level_m * pow(1 + 0.07 * warming, 0.6) ELSE water_level_m * (1 + 0.07 * warming) END, 6) AS water_level_m FROM levels, s"
)
def climate_scaled_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf).select("hazard_type", "return_period", "scenario", "horizon", r6("water_level_m").alias("water_level_m"))


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    base = views.table_levels(spark, sf).select("hazard_type", "return_period", F.col("water_level_m").alias("baseline_water_level_m"), F.lit(1.0).alias("gev_scale_mm"))
    return forcing.scenario_levels(base, forcing.warming(spark).withColumn("coastal_delta_m", F.col("warming") / 5))


@query(
    "WITH s AS (SELECT l_linenumber AS sample, CAST(year(l_shipdate) AS INTEGER) AS year, max(l_extendedprice) AS slc FROM lineitem GROUP BY 1, 2), p AS (SELECT sample, max(slc) FILTER (year = 2000) - max(slc) FILTER (year = 1996) AS d FROM s WHERE year IN (1996, 2000) GROUP BY 1) "
    "SELECT round(quantile_cont(d, 0.5) * 0.001, 6) AS delta_m FROM p"
)
def sea_level_delta(spark: SparkSession, sf: str) -> DataFrame:
    s = views.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("sample"), F.year("l_shipdate").alias("year")).agg(F.max("l_extendedprice").alias("slc")).withColumn("units", F.lit("mm"))
    return forcing.sea_level_delta(s, 2000, 1996, 50).select(r6("delta_m").alias("delta_m"))


@query(f"WITH {SQL_TABLE_LEVELS} SELECT hazard_type, return_period, round(water_level_m + 1.2 - 0.4, 6) AS level_m, 'EGM2008; MSL+1.200 m' AS note, TRUE AS ok FROM levels")
def datum_convert(spark: SparkSession, sf: str) -> DataFrame:
    out = views.table_levels(spark, sf).select("hazard_type", "return_period", r6(H.to_egm2008("water_level_m", 1.2, -0.4)).alias("level_m"), H.datum_note(F.lit(1.2)).alias("note"))
    return out.withColumn("ok", H.datum_note_valid(F.col("note")))


@query(
    f"WITH {SQL_TABLE_LEVELS}, c AS (SELECT return_period, water_level_m AS p FROM levels WHERE hazard_type = 'coastal') SELECT return_period, t, round(CASE WHEN t < 10800 THEN p * t / 10800 WHEN t <= 14400 THEN p WHEN t < 21600 THEN p - (p - 0.25 * p) * (t - 14400) / 7200 ELSE 0.25 * p END::DOUBLE, 6) AS level FROM c, (SELECT unnest(generate_series(0, 28800, 600)) AS t)"
)
def surge_level(spark: SparkSession, sf: str) -> DataFrame:
    peaks = views.table_levels(spark, sf).where("hazard_type = 'coastal'").select("return_period", F.col("water_level_m").alias("peak"))
    hours = peaks.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(28_800).cast("long"), F.lit(600).cast("long"))))
    return hours.select("return_period", "t", r6(H.surge_level(F.col("t"), F.col("peak"), 0.25 * F.col("peak"))).alias("level"))


@query()
def gev_fit(spark: SparkSession, sf: str) -> DataFrame:
    return S.gev_fit(views.annual_max(spark, sf))


def _utm_sql() -> str:
    """Easting and northing of zone 48 south by the same published series."""
    x = " + ".join(["eta", *(f"{k!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, k in enumerate(geo._ALPHA, 1))])
    y = " + ".join(["xi", *(f"{k!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, k in enumerate(geo._ALPHA, 1))])
    scale = repr(geo.K0 * geo._RECTIFYING)
    return f"""WITH {SQL_POINTS}, g AS (SELECT label, 106.5::DOUBLE + c * 0.01::DOUBLE AS lon, -6.2::DOUBLE + r * 0.01::DOUBLE AS lat FROM points), a AS (SELECT *, radians(lat) AS phi, radians(lon - 105) AS lam FROM g),
    b AS (SELECT *, sinh(atanh(sin(phi)) - {geo._E!r} * atanh({geo._E!r} * sin(phi))) AS t FROM a), d AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b)
    SELECT label, round(500000 + {scale} * ({x}), 3) AS x, round(10000000 + {scale} * ({y}), 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM d"""


@query(_utm_sql())
def utm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    lonlat = views.points(spark, sf).select("label", (106.5 + F.col("col") * 0.01).alias("lon"), (-6.2 + F.col("row") * 0.01).alias("lat"))
    x, y = geo.to_utm("lon", "lat", 32748)
    back = lonlat.withColumn("x", x).withColumn("y", y)
    lon, lat = geo.from_utm("x", "y", 32748)
    return back.select("label", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


# scores and checks

_HITS = f"{SQL_CELLS}, {SQL_POINTS}, s AS (SELECT p.label, any_value(p.cls) AS cls, coalesce(max(CASE WHEN z IS NOT NULL THEN greatest(0.2 - z, 0) END), 0) AS score FROM points p LEFT JOIN cells g ON abs(g.r - p.r) <= 2 AND abs(g.c - p.c) <= 2 GROUP BY p.label)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    wet = views.cells(spark, sf).withColumn("depth", D.bathtub("z", 0.2))
    return scoring.point_scores(views.points(spark, sf), wet, threshold=1.0)


@query(f"WITH {_HITS} SELECT label, cls, round(score, 6) AS score, score >= 1.0 AS hit FROM s")
def hotspot_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("label", "cls", r6("score").alias("score"), "hit")


@query(
    f"WITH {_HITS}, k AS (SELECT count(*) FILTER (cls = 'flood') AS n_pos, count(*) FILTER (cls <> 'flood') AS n_neg, count(*) FILTER (cls = 'flood' AND score >= 1.0) AS hits, count(*) FILTER (cls <> 'flood' AND score < 1.0) AS rej FROM s) "
    "SELECT n_pos, n_neg, hits, round(hits / n_pos, 6) AS hr, round(rej / n_neg, 6) AS crr, round(hits / n_pos + rej / n_neg - 1, 6) AS tss FROM k"
)
def skill_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.skill(_scored(spark, sf)).select("n_pos", "n_neg", "hits", r6("hr").alias("hr"), r6("crr").alias("crr"), r6("tss").alias("tss"))


@query(f"WITH {_HITS} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM s a, s b WHERE a.cls = 'flood' AND b.cls = 'dry'")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.roc_auc(_scored(spark, sf)).select(r6("auc").alias("auc"))


@query(
    f"WITH {_HITS} SELECT round(t.score, 6) AS threshold, round(count(*) FILTER (s.cls = 'flood' AND s.score >= t.score) / any_value(np), 6) AS tpr, round(count(*) FILTER (s.cls = 'dry' AND s.score >= t.score) / any_value(nn), 6) AS fpr, "
    "round(count(*) FILTER (s.cls = 'flood' AND s.score >= t.score) / count(*) FILTER (s.score >= t.score), 6) AS precision FROM (SELECT DISTINCT score FROM s) t, s, (SELECT count(*) FILTER (cls = 'flood') AS np, count(*) FILTER (cls = 'dry') AS nn FROM s) GROUP BY t.score"
)
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.roc_curve(_scored(spark, sf)).select(*[r6(c).alias(c) for c in ("threshold", "tpr", "fpr", "precision")])


@query()
def bootstrap_tss(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.bootstrap(_scored(spark, sf).withColumn("label", F.col("label").cast("string")))


def _two(spark: SparkSession, sf: str) -> DataFrame:
    """Points scored by two fields."""
    own = _scored(spark, sf)
    other = scoring.point_scores(views.points(spark, sf), views.cells(spark, sf).withColumn("depth", D.hand_depth("hand", 0.9)), threshold=1.0)
    return own.join(other.select("label", F.col("score").alias("other_score"), F.col("hit").alias("other_hit")), "label")


@query()
def bootstrap_tss_difference(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.bootstrap(_two(spark, sf), "tss_diff")


@query()
def bootstrap_auc_difference(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.bootstrap(_two(spark, sf), "auc_diff")


@query(
    f"WITH {SQL_CELLS}, m AS (SELECT z <= 0.5 AS m, channel AS o FROM cells), k AS (SELECT count(*) FILTER (m AND o) AS tp, count(*) FILTER (coalesce(m, FALSE) AND NOT o) AS fp, count(*) FILTER (NOT coalesce(m, FALSE) AND o) AS fn FROM m) "
    "SELECT tp, fp, fn, round(tp / (tp + fp + fn), 6) AS csi, round(tp / (tp + fn), 6) AS hit_rate, round(fp / (tp + fp), 6) AS far, round((tp + fp) / (tp + fn), 6) AS bias FROM k"
)
def contingency_csi(spark: SparkSession, sf: str) -> DataFrame:
    masks = views.cells(spark, sf).select((F.col("z") <= 0.5).alias("modelled"), F.col("channel").alias("observed"))
    return scoring.contingency(masks).select("tp", "fp", "fn", *[r6(c).alias(c) for c in ("csi", "hit_rate", "far", "bias")])


@query(f"WITH {SQL_POINTS}, st AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 40 AS x, (s_suppkey * 3) % 5 AS y FROM supplier) SELECT label, id AS station_id, round(sqrt(d2), 6) AS distance FROM (SELECT p.label, st.id, (p.c - x) ** 2 + (p.r - y) ** 2 AS d2, row_number() OVER (PARTITION BY p.label ORDER BY (p.c - x) ** 2 + (p.r - y) ** 2, st.id) AS n FROM points p, st) WHERE n = 1")
def nearest_station(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    st = views.table(spark, sf, "supplier").select(k.alias("station_id"), (k * 7 % 40).alias("x"), (k * 3 % 5).alias("y"))
    p = views.points(spark, sf).select("label", F.col("col").alias("x"), F.col("row").alias("y"))
    return scoring.nearest(p, st, "x", "y").select("label", "station_id", r6("distance").alias("distance"))


@query(f"WITH {_BATH}, s AS (SELECT hazard_type, return_period % 100 AS rp, count(*) FILTER (d > 0) AS n, coalesce(max(d), 0) AS deep, return_period FROM bath GROUP BY ALL), l AS (SELECT *, lag(n) OVER w AS a, lag(deep) OVER w AS b FROM s WINDOW w AS (PARTITION BY hazard_type ORDER BY rp, return_period)) SELECT hazard_type, CAST(rp AS INTEGER) AS rp, problem FROM (SELECT hazard_type, rp, 'area falls' AS problem FROM l WHERE n < a UNION ALL SELECT hazard_type, rp, 'depth falls' FROM l WHERE deep < b - 1e-9)")
def rp_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    # return periods taken modulo 100 make the summary fall, so that there is something to find
    s = zonal.depth_summary(_bath(spark, sf), "hazard_type", "scenario", "horizon", "return_period").withColumn("return_period", F.col("return_period") % 100 + F.col("return_period") / 1e6)
    return checks.rp_monotonicity(s).select("hazard_type", F.floor("return_period").cast("int").alias("rp"), "problem")


@query(
    f"WITH {SQL_TABLE_LEVELS}, s(scenario, horizon, warming, delta) AS (VALUES {_SCEN}), x AS (SELECT return_period, scenario, horizon, water_level_m * (1 + 0.07 * warming) * CASE WHEN horizon = 2050 AND warming > 1 THEN 1.5 ELSE 1 END AS v, CASE WHEN horizon = 2050 THEN CASE WHEN warming < 1 THEN 0 ELSE 1 END ELSE CASE WHEN warming < 2 THEN 2 ELSE 3 END END AS o FROM levels, s WHERE hazard_type = 'pluvial' AND horizon > 2020), "
    "y AS (SELECT *, lag(v) OVER (PARTITION BY return_period ORDER BY o) AS b FROM x) SELECT return_period, scenario, CAST(horizon AS INTEGER) AS horizon, problem FROM (SELECT *, 'over cap' AS problem FROM y WHERE v > 0.5 UNION ALL SELECT *, 'under a milder scenario' FROM y WHERE v < b)"
)
def scenario_inversions(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when((F.col("horizon") == 2050) & (F.col("scenario") == "SSP5-8.5"), 1.5).otherwise(1.0)
    return checks.forcing_problems(_scaled(spark, sf).withColumn("water_level_m", F.col("water_level_m") * odd)).select("return_period", "scenario", "horizon", "problem")


@query(f"WITH {_GUMBEL}, f AS (SELECT series_id, mu - sigma * ln(-ln(1 - 1 / 50.0)) AS v FROM law) SELECT series_id, round(v / 60000 - 1, 6) AS deviation, CASE WHEN abs(v / 60000 - 1) <= 0.25 THEN 'PASS' WHEN abs(v / 60000 - 1) <= 0.5 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM f")
def idf_deviation(spark: SparkSession, sf: str) -> DataFrame:
    law = _law(spark, sf).withColumn("xi", F.lit(0.0))
    anchors = law.select("series_id", F.lit(50).alias("anchor_rp"), F.lit(60000.0).alias("anchor_value"))
    return checks.anchor_deviation(law, anchors, 0.25, 0.5).select("series_id", r6("deviation").alias("deviation"), "verdict")


@query(
    "SELECT 'forcing_anchors' AS table_name, 'forcing_anchors: missing columns citation' AS problem UNION ALL SELECT 'gates', 'gates: missing' "
    "UNION ALL SELECT 'hotspots', 'hotspots: empty' WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey < 0) UNION ALL SELECT 'observed_events', 'observed_events: empty' WHERE NOT EXISTS (SELECT 1 FROM events)"
)
def manifest_problems(spark: SparkSession, sf: str) -> DataFrame:
    as_columns = lambda df, *names: df.select(*[F.lit(x).alias(x) for x in names])
    anchors = as_columns(views.annual_max(spark, sf), "hazard", "duration_h", "anchor_rp", "anchor_value", "unit", "source")
    observed = as_columns(views.table(spark, sf, "events"), *tables.MANIFEST["observed_events"][0])
    hotspots = as_columns(views.points(spark, sf).where("label < 0"), *tables.MANIFEST["hotspots"][0])
    return tables.manifest_problems(spark, {"forcing_anchors": anchors, "observed_events": observed, "hotspots": hotspots, "gates": None})


@query(
    "WITH p AS (SELECT DISTINCT CAST(p_size * 20 AS DOUBLE) AS rp FROM part), l AS (SELECT unnest([2, 5, 10, 25, 50, 100, 200, 500, 1000]) AS q) SELECT rp, CAST(max(q) FILTER (q <= rp) AS INTEGER) AS lower, CAST(min(q) FILTER (q >= rp) AS INTEGER) AS upper FROM p, l GROUP BY rp"
)
def rp_bracket(spark: SparkSession, sf: str) -> DataFrame:
    values = views.table(spark, sf, "part").select((F.col("p_size") * 20).cast("double").alias("rp")).distinct()
    return checks.bracket(forcing.return_periods(spark), values)


# solvers and the whole run


def _runs(spark: SparkSession, sf: str, hazard_type: str) -> DataFrame:
    """The grid once for each return period of a hazard."""
    own = views.levels(spark).where(F.col("hazard_type") == hazard_type).select("return_period", "water_level_m")
    return views.cells(spark, sf).select("row", "col", "z", "channel").join(F.broadcast(own))


@query()
def rain_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf, "pluvial").withColumn("outlet", F.col("channel")).withColumn("n", F.lit(0.05)).withColumnRenamed("water_level_m", "net_rain")
    return solver.rain_on_grid(runs, storm_s=300.0, total_s=600.0, dt_max=10.0).select("return_period", *place(), F.round("depth", 5).alias("depth"))


@query()
def inertial(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf, "coastal").withColumns({"scenario": F.lit("present"), "boundary": F.col("row") == 0, "level": F.col("water_level_m") + 0.6, "floor": F.lit(0.0), "start": F.lit(0.0)})
    return solver.inertial(runs, total_s=600.0, dt_max=10.0).select("return_period", *place(), F.round("depth", 5).alias("depth"))


_RUN = f"""WITH RECURSIVE {SQL_CELLS}, {SQL_LEVELS}, wet AS (SELECT rp.return_period, g.r, g.c, g.b, rp.water_level_m - g.z AS d FROM border g, levels rp WHERE hazard_type = 'coastal' AND g.z < rp.water_level_m),
f(rp, r, c) AS (SELECT return_period, r, c FROM wet WHERE b UNION SELECT a.return_period, a.r, a.c FROM f JOIN wet a ON a.return_period = f.rp AND abs(a.r - f.r) <= 1 AND abs(a.c - f.c) <= 1),
bank AS (SELECT water_level_m AS w FROM levels WHERE hazard_type = 'fluvial' AND return_period = 10),
d AS (
  SELECT 'coastal' AS hazard_type, l.return_period, l.water_level_m, CASE WHEN z IS NOT NULL THEN CASE WHEN f.r IS NOT NULL THEN l.water_level_m - z ELSE 0 END END AS d FROM cells g CROSS JOIN (SELECT * FROM levels WHERE hazard_type = 'coastal') l LEFT JOIN f ON f.rp = l.return_period AND f.r = g.r AND f.c = g.c
  UNION ALL SELECT 'fluvial', return_period, water_level_m, CASE WHEN hand IS NOT NULL THEN CASE WHEN channel THEN 0 ELSE greatest(greatest(water_level_m - w, 0) - hand, 0) END END FROM cells, levels, bank WHERE hazard_type = 'fluvial'
  UNION ALL SELECT 'pluvial', return_period, water_level_m, CASE WHEN z IS NOT NULL THEN least(water_level_m, greatest(filled - z, 0)) END FROM cells, levels WHERE hazard_type = 'pluvial')
SELECT hazard_type, return_period, 'SSP5-8.5' AS scenario, 2020 AS horizon, water_level_m, count(*) FILTER (d > 0) * 900.0::DOUBLE AS flooded_area_m2, round(coalesce(avg(d) FILTER (d > 0), 0), 6) AS mean_depth_m, round(coalesce(max(d) FILTER (d > 0), 0), 6) AS max_depth_m,
  count(*) FILTER (d > 0) AS wet_pixels, round(count(*) FILTER (d > 0.5 AND d <= 1) * 900.0 / 1e6, 6) AS major_area_km2 FROM d GROUP BY ALL"""


@query(_RUN)
def multihazard_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf)
    out = hazard.summary(hazard.multihazard_depths(g, views.levels(spark), views.on_border(g), river="channel"))
    return out.select("hazard_type", "return_period", "scenario", "horizon", "water_level_m", "flooded_area_m2", r6("mean_depth_m").alias("mean_depth_m"), r6("max_depth_m").alias("max_depth_m"), "wet_pixels", r6("major_area_km2").alias("major_area_km2"))


@query()
def multihazard_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    """The run by the inertial solver and by fill and spill."""
    g = views.cells(spark, sf)
    how = {"inertial": {"total_s": 600.0, "dt_max": 10.0}, "fill_spill": {"min_cells": 3}}
    out = hazard.summary(hazard.multihazard_depths(g, views.levels(spark), views.on_border(g), river="channel", coastal="inertial", pluvial="fill_spill", options=how))
    return out.select("hazard_type", "return_period", "scenario", "horizon", "water_level_m", "flooded_area_m2", r6("mean_depth_m").alias("mean_depth_m"), r6("max_depth_m").alias("max_depth_m"), "wet_pixels")


@query()
def multihazard_rain(spark: SparkSession, sf: str) -> DataFrame:
    """The run with rain on the grid."""
    g = views.cells(spark, sf)
    how = {"rain_on_grid": {"storm_s": 300.0, "total_s": 600.0, "dt_max": 10.0}}
    out = hazard.summary(hazard.multihazard_depths(g, views.levels(spark), views.on_border(g), river="channel", pluvial="rain_on_grid", options=how))
    return out.select("hazard_type", "return_period", "scenario", "horizon", "water_level_m", "flooded_area_m2", r6("mean_depth_m").alias("mean_depth_m"), r6("max_depth_m").alias("max_depth_m"), "wet_pixels")
