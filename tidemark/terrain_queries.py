"""Registered queries of terrain products: void fill, drainage from lines and flow, conditioning, depressions, raster files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import depth as D
from tidemark.functions import geo
from tidemark.operators import controls, grid, lines, reproject, resampling, terrain
from tidemark.operators.series import gev_fit
from tidemark.plans import checks, city, diagnostics, forcing, views
from tidemark.plans.views import SQL_CELLS, SQL_POINTS, SQL_SERIES, SQL_TABLE_LEVELS
from tidemark.queries import _AB, _CONDITIONED, _D, _FILLED, _NEAR, place, query, r6
from tidemark.sources import rasters, tables
from tidemark.sources.storage import scratch

_EIGHT = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)) AS way(dr, dc)"


@query(
    f"""WITH {SQL_CELLS}, v AS (SELECT r, c, z, channel OR z IS NULL AS void FROM cells),
near AS (SELECT a.r, a.c, dr, dc, min(k) AS k FROM v a, {_EIGHT}, range(1, 6) AS t(k) JOIN v b ON b.r = a.r + dr * k AND b.c = a.c + dc * k AND NOT b.void WHERE a.void AND k <= CASE WHEN dr <> 0 AND dc <> 0 THEN 3 ELSE 5 END GROUP BY ALL),
made AS (SELECT n.r, n.c, sum(b.z / (k * sqrt(abs(dr) + abs(dc)))) / sum(1 / (k * sqrt(abs(dr) + abs(dc)))) AS z FROM near n JOIN v b ON b.r = n.r + n.dr * k AND b.c = n.c + n.dc * k GROUP BY n.r, n.c),
whole AS (SELECT v.r, v.c, v.void, CASE WHEN v.void THEN made.z ELSE v.z END AS z FROM v LEFT JOIN made USING (r, c)),
mean AS (SELECT a.r, a.c, avg(b.z) AS m FROM whole a JOIN whole b ON {_AB} WHERE a.void GROUP BY a.r, a.c)
SELECT w.r, w.c, round(CASE WHEN w.void AND w.z IS NOT NULL THEN m ELSE w.z END, 6) AS z FROM whole w LEFT JOIN mean USING (r, c)"""
)
def void_fill(spark: SparkSession, sf: str) -> DataFrame:
    out = grid.void_filled(views.cells(spark, sf).select("row", "col", "z", "channel"), "z", F.col("channel"), radius=5, smoothing=1)
    return out.select(*place(), r6("z").alias("z"))


# lines

_LINES = """lines AS (SELECT s_suppkey AS k, (s_suppkey * 13) % 40 + 0.3::DOUBLE AS x1, s_suppkey % 5 + 0.45::DOUBLE AS y1, (s_suppkey * 29) % 40 + 0.55::DOUBLE AS x2, (s_suppkey * 3) % 5 + 0.7::DOUBLE AS y2,
  s_suppkey % 6 <> 0 AND s_suppkey % 10 <> 0 AND s_suppkey % 15 <> 7 AS above FROM supplier),
box AS (SELECT l.*, g.r, g.c FROM lines l JOIN cells g ON above),
par AS (SELECT *, greatest(0, CASE WHEN x1 = x2 THEN 0 ELSE least((c - x1) / (x2 - x1), (c + 1 - x1) / (x2 - x1)) END, CASE WHEN y1 = y2 THEN 0 ELSE least((r - y1) / (y2 - y1), (r + 1 - y1) / (y2 - y1)) END) AS t1,
  least(1, CASE WHEN x1 = x2 THEN 1 ELSE greatest((c - x1) / (x2 - x1), (c + 1 - x1) / (x2 - x1)) END, CASE WHEN y1 = y2 THEN 1 ELSE greatest((r - y1) / (y2 - y1), (r + 1 - y1) / (y2 - y1)) END) AS t2 FROM box),
met AS (SELECT *, t2 - t1 > 1e-12 AND (x1 <> x2 OR floor(x1) = c) AND (y1 <> y2 OR floor(y1) = r) AS runs FROM par)"""


def _off(x: str, y: str) -> str:
    """Distance of a corner at x, y from a segment, in SQL."""
    t = f"greatest(0, least(1, (({x} - x1) * (x2 - x1) + ({y} - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))"
    return f"sqrt(({x} - (x1 + {t} * (x2 - x1))) ** 2 + ({y} - (y1 + {t} * (y2 - y1))) ** 2)"


_CLOSE = "least({}, {})".format(
    ", ".join(_off(x, y) for x in ("c", "(c + 1)") for y in ("r", "(r + 1)")), ", ".join(f"sqrt(greatest(c - x{i}, x{i} - c - 1, 0) ** 2 + greatest(r - y{i}, y{i} - r - 1, 0) ** 2)" for i in (1, 2))
)


def waterways(spark: SparkSession, sf: str) -> DataFrame:
    """A segment for each supplier, some of them under ground."""
    k = F.col("s_suppkey")
    return views.table(spark, sf, "supplier").select(
        k.alias("k"), ((k * 13) % 40 + 0.3).alias("x1"), (k % 5 + 0.45).alias("y1"), ((k * 29) % 40 + 0.55).alias("x2"), ((k * 3) % 5 + 0.7).alias("y2"),
        F.when(k % 6 == 0, "Culvert").alias("tunnel"), F.when(k % 15 == 7, "yes").alias("covered"), F.when(k % 10 == 0, "-1").when(k % 11 == 0, "1").alias("layer"),
    )


@query(f"WITH {SQL_CELLS}, {_LINES} SELECT k, r, c FROM met WHERE runs")
def line_cells(spark: SparkSession, sf: str) -> DataFrame:
    return lines.touched(lines.open_lines(waterways(spark, sf))).join(views.cells(spark, sf).select("row", "col"), ["row", "col"]).select("k", *place())


@query(f"WITH {SQL_CELLS}, {_LINES} SELECT DISTINCT r, c FROM met WHERE runs OR {_CLOSE} <= 0.5")
def line_buffer_touched(spark: SparkSession, sf: str) -> DataFrame:
    return lines.touched_within(views.cells(spark, sf), lines.open_lines(waterways(spark, sf)), 0.5).select(*place())


#: Cells upstream of each cell of the conditioned flow.
_AREA = f"""{_CONDITIONED}, runs AS (SELECT cond.r, cond.c, coalesce(b.r, cond.r) AS nr, coalesce(b.c, cond.c) AS nc FROM cond LEFT JOIN cond b ON cond.d >= 0 AND {_NEAR.format(a="cond", b="b")} AND {_D.format(a="cond", b="b")} = cond.d AND (b.r <> cond.r OR b.c <> cond.c)),
p(r, c, tr, tc) AS (SELECT r, c, r, c FROM runs UNION SELECT p.r, p.c, f.nr, f.nc FROM p JOIN runs f ON f.r = p.tr AND f.c = p.tc), area AS (SELECT tr AS r, tc AS c, count(DISTINCT (r, c)) AS n FROM p GROUP BY tr, tc)"""


@query(f"{_AREA}, {_LINES}, wet AS (SELECT DISTINCT r, c FROM met WHERE runs UNION SELECT r, c FROM area WHERE n >= 12) SELECT g.r, g.c, wet.r IS NOT NULL AS drain FROM cells g LEFT JOIN wet USING (r, c)")
def drainage_network(spark: SparkSession, sf: str) -> DataFrame:
    return lines.drainage_network(views.cells(spark, sf).select("row", "col", "z"), waterways(spark, sf), 0.0, 12).select(*place(), "drain")


@query(f"{_AREA} SELECT g.r, g.c, coalesce(n >= 12, FALSE) AS drain FROM cells g LEFT JOIN area USING (r, c)")
def drainage_fallback(spark: SparkSession, sf: str) -> DataFrame:
    covered = waterways(spark, sf).withColumn("tunnel", F.lit("yes"))
    return lines.drainage_network(views.cells(spark, sf).select("row", "col", "z"), covered, 0.0, 12, "lines").select(*place(), "drain")


@query(
    f"""{_AREA}, q(r, c, tr, tc, fin) AS (SELECT a.r, a.c, a.r, a.c, a.n >= 12 FROM area a UNION SELECT q.r, q.c, f.nr, f.nc, x.n >= 12 FROM q JOIN runs f ON f.r = q.tr AND f.c = q.tc JOIN area x ON x.r = f.nr AND x.c = f.nc WHERE NOT q.fin),
under AS (SELECT q.r, q.c, k.z FROM q JOIN known k ON k.r = q.tr AND k.c = q.tc WHERE fin)
SELECT g.r, g.c, CAST(cond.d AS INTEGER) AS d8, coalesce(area.n >= 12, FALSE) AS drain, round(CASE WHEN under.z IS NOT NULL THEN greatest(g.z - under.z, 0) END, 6) AS hand FROM cells g LEFT JOIN cond USING (r, c) LEFT JOIN area USING (r, c) LEFT JOIN under USING (r, c)"""
)
def hand_product(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.hand_product(views.cells(spark, sf).select("row", "col", "z"), threshold=12).select(*place(), "d8", "drain", r6("hand").alias("hand"))


# depressions

_MEDIAN = f"""low AS (SELECT r, c, z - CASE WHEN channel THEN 0.4 ELSE 0 END AS z FROM cells),
known AS (SELECT a.r, a.c, median(b.z) AS z FROM low a JOIN low b ON {_AB} AND b.z IS NOT NULL WHERE a.z IS NOT NULL GROUP BY a.r, a.c)"""
_POOLS = f"""pool AS (SELECT r, c, k.z, fl.z AS f, r * {views.WIDTH} + c AS id FROM known k JOIN fl USING (r, c) WHERE fl.z - k.z > 0),
pl(r, c, root) AS (SELECT r, c, id FROM pool UNION SELECT a.r, a.c, b.root FROM pl b JOIN pool a ON {_AB} WHERE b.root < a.id), plab AS (SELECT r, c, min(root) AS label FROM pl GROUP BY r, c)"""


@query(
    _FILLED.replace("known AS (SELECT r, c, z FROM cells WHERE z IS NOT NULL)", _MEDIAN)
    + f""", {_POOLS}, pit AS (SELECT label FROM plab JOIN pool USING (r, c) GROUP BY label HAVING max(f - z) < 0.5), up AS (SELECT r, c, f FROM plab JOIN pit USING (label) JOIN pool USING (r, c))
SELECT g.r, g.c, round(coalesce(f, k.z), 6) AS z, f IS NOT NULL AS raised FROM cells g LEFT JOIN known k USING (r, c) LEFT JOIN up USING (r, c)"""
)
def conditioned_terrain(spark: SparkSession, sf: str) -> DataFrame:
    cells = views.cells(spark, sf).select("row", "col", "z", "channel")
    return terrain.burned_median_depitted(cells, F.col("channel"), F.col("z").isNotNull(), burn=0.4).select(*place(), r6("z").alias("z"), "raised")


@query(
    f"""{_FILLED}, {_POOLS}, one AS (SELECT label, count(*) AS n, max(f - z) AS d FROM plab JOIN pool USING (r, c) GROUP BY label)
SELECT CASE WHEN n >= 100 THEN 100 WHEN n >= 25 THEN 25 WHEN n >= 9 THEN 9 ELSE 1 END AS at_least, count(*) AS depressions, CAST(sum(n) AS BIGINT) AS cells FROM one WHERE d BETWEEN 0.5 AND 3.0 GROUP BY 1"""
)
def depression_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.pit_sizes(views.cells(spark, sf), edges=(1, 9, 25, 100))


_RAW = f"""rfall AS (SELECT a.r, a.c, {_D.format(a="a", b="b")} AS d, (a.z - b.z) / CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END AS s, b.r AS nr, b.c AS nc FROM known a JOIN known b ON {_AB} AND a.z > b.z),
rstep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY s DESC, d) AS k FROM rfall) WHERE k = 1),
rp0(r, c, tr, tc) AS (SELECT r, c, r, c FROM known UNION SELECT p.r, p.c, x.nr, x.nc FROM rp0 p JOIN rstep x ON x.r = p.tr AND x.c = p.tc)"""


@query(
    f"""{_FILLED}, {_POOLS}, {_RAW}, one AS (SELECT label, count(*) AS n, max(f - z) AS d FROM plab JOIN pool USING (r, c) GROUP BY label),
water AS (SELECT label, sum(g.size * 0.01) AS w FROM rp0 JOIN plab ON plab.r = tr AND plab.c = tc JOIN cells g ON g.r = rp0.r AND g.c = rp0.c WHERE (tr, tc) NOT IN (SELECT (r, c) FROM rstep) GROUP BY label),
every AS (SELECT sum(size * 0.01) AS e FROM cells WHERE z IS NOT NULL)
SELECT t.threshold, count(one.label) AS depressions, round(coalesce(sum(n), 0) * 900.0::DOUBLE / 1e6, 6) AS footprint_km2, round(coalesce(sum(w), 0) / any_value(e), 6) AS caught, round(median(d), 6) AS median_depth_m
FROM every, (SELECT unnest([0.3, 0.5, 0.8, 1.2, 9.0])::DOUBLE AS threshold) t LEFT JOIN (one LEFT JOIN water USING (label)) ON d >= threshold AND d <= 3.0 AND n >= 3 GROUP BY t.threshold"""
)
def depression_depth_sweep(spark: SparkSession, sf: str) -> DataFrame:
    found = diagnostics.depression_sweep(views.cells(spark, sf), F.col("size") * 0.01, (0.3, 0.5, 0.8, 1.2, 9.0), min_cells=3)
    return found.select("threshold", "depressions", r6("footprint_km2").alias("footprint_km2"), r6("caught").alias("caught"), r6("median_depth_m").alias("median_depth_m"))


# files


@query(f"WITH {SQL_CELLS} SELECT r, c, round(z, 6) AS z FROM cells WHERE z IS NOT NULL AND c BETWEEN 5 AND 20 AND r BETWEEN 1 AND 30")
def raster_window(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "raster")
    rasters.write_raster(views.cells(spark, sf), path, "z", rasters.Geometry(48, 300_000.0, 9_400_000.0, 30.0), tile=8)
    return rasters.read_raster(spark, path, "z", rows=(1, 30), columns=(5, 20)).select(*place(), r6("z").alias("z"))


@query(f"WITH {SQL_CELLS}, n AS (SELECT max(r) + 1 AS h FROM cells) SELECT 'height' AS field, CAST(h AS DOUBLE) AS expected, CAST(h + 1 AS DOUBLE) AS found FROM n UNION ALL SELECT 'a', 30.0, 60.0")
def raster_alignment(spark: SparkSession, sf: str) -> DataFrame:
    at, cells = rasters.Geometry(48, 300_000.0, 9_400_000.0, 30.0), views.cells(spark, sf)
    more = cells.unionByName(cells.agg((F.max("row") + 1).cast("int").alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("z")), allowMissingColumns=True)
    return rasters.misaligned(rasters.geometry_table(cells, at), rasters.geometry_table(more, at._replace(size=60.0)))


@query(f"WITH {SQL_TABLE_LEVELS} SELECT hazard_type, return_period, 'SSP5-8.5' AS scenario, 2020 AS horizon, water_level_m FROM levels")
def levels_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "levels")
    views.table_levels(spark, sf).write.option("header", True).csv(path)
    return tables.read_levels(spark, path).select("hazard_type", "return_period", "scenario", "horizon", "water_level_m")


@query(f"WITH {SQL_SERIES} SELECT series_id, ts, round(value, 4) AS value FROM series")
def series_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "series")
    tables.cached_table(spark, path, lambda: views.series(spark, sf))
    # a second call reads what stands, whatever it would build
    again = tables.cached_table(spark, path, lambda: views.series(spark, sf).limit(0))
    return again.select("series_id", "ts", F.round("value", 4).alias("value"))


_STEPS = " ".join(f"WHEN d <= {edge} THEN {n}" for n, edge in enumerate(D.SEVERITY_EDGES, 1))
_SEVERITY = "SELECT r, c, return_period, greatest(water_level_m - z, 0) AS d FROM cells, levels WHERE hazard_type = 'coastal' AND z IS NOT NULL"


@query(f"WITH {SQL_CELLS}, {SQL_TABLE_LEVELS}, x AS ({_SEVERITY}) SELECT r, c, return_period, CASE WHEN d <= 0 THEN 0 {_STEPS} ELSE {len(D.SEVERITY_EDGES) + 1} END AS severity FROM x")
def severity_sink(spark: SparkSession, sf: str) -> DataFrame:
    coastal = views.table_levels(spark, sf).where("hazard_type = 'coastal'").select("return_period", "water_level_m")
    wet = views.cells(spark, sf).where("z is not null").join(F.broadcast(coastal)).withColumn("severity", D.severity(D.bathtub("z", "water_level_m")))
    path = scratch(spark, "severity")
    tables.write_cells(wet.select("row", "col", "return_period", "severity"), path, "severity", "smallint", "return_period")
    return spark.read.parquet(path).select(*place(), "return_period", F.col("severity").cast("int").alias("severity"))


@query("SELECT 'second-' || max(s_suppkey) || '.csv' AS name FROM supplier")
def first_raster(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "found")
    last = views.table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("s"))
    for name in ("second", "third"):
        last.select(F.concat(F.lit(f"{name}-"), F.col("s").cast("string")).alias("value")).coalesce(1).write.text(f"{path}/{name}")
    found = tables.first_match(spark, path, "first-*", "part-*.txt", "*")
    folder = F.regexp_extract("path", r"/(second|third)/", 1)
    held = spark.read.text(f"{path}/second")
    return found.select(folder.alias("folder")).join(held.withColumn("folder", F.lit("second")), "folder").select(F.concat("value", F.lit(".csv")).alias("name"))


# other projections

_TARGET = rasters.Geometry(32647, 833_000.0, 340_000.0, 30.0)
_ZONE_47 = rasters.Geometry(32647, 833_007.0, 340_011.0, 30.0)
_ZONE_48 = rasters.Geometry(32648, 166_300.0, 340_100.0, 40.0)


def _to_other_zone(x: str, y: str) -> tuple[str, str, str]:
    """SQL of the steps from zone 47 to zone 48, north of the equator, by the same published series: CTEs, then easting and northing."""
    n, scale = geo._N, repr(geo.K0 * geo._RECTIFYING)
    u = " - ".join(["xi", *(f"{k!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, k in enumerate(geo._BETA, 1))])
    v = " - ".join(["eta", *(f"{k!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, k in enumerate(geo._BETA, 1))])
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4)
    phi = " + ".join(["chi", *(f"{k!r} * sin({2 * j} * chi)" for j, k in enumerate(delta, 1))])
    steps = f"""i1 AS (SELECT *, ({y}) / {scale} AS xi, (({x}) - 500000) / {scale} AS eta FROM tc), i2 AS (SELECT *, {u} AS u, {v} AS v FROM i1), i3 AS (SELECT * EXCLUDE (xi, eta), asin(sin(u) / cosh(v)) AS chi, atan2(sinh(v), cos(u)) + radians(99) - radians(105) AS lam FROM i2),
i4 AS (SELECT *, {phi} AS phi FROM i3), i5 AS (SELECT *, sinh(atanh(sin(phi)) - {geo._E!r} * atanh({geo._E!r} * sin(phi))) AS t FROM i4), i6 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM i5)"""
    east = " + ".join(["eta", *(f"{k!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, k in enumerate(geo._ALPHA, 1))])
    north = " + ".join(["xi", *(f"{k!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, k in enumerate(geo._ALPHA, 1))])
    return steps, f"500000 + {scale} * ({east})", f"{scale} * ({north})"


def _mosaic_sql() -> str:
    steps, east, north = _to_other_zone("x", "y")
    place_in = lambda g, x, y: f"({g.north} - ({y})) / {g.size} - 0.5 AS sr, (({x}) - {g.west}) / {g.size} - 0.5 AS sc"
    weighed = lambda at, shift: (
        f"SELECT a.r, a.c, sum(greatest(b.z + {shift}, 0) * w) / sum(w) AS d FROM (SELECT r, c, floor(sr) + i AS br, floor(sc) + j AS bc, (1 - abs(sr - floor(sr) - i)) * (1 - abs(sc - floor(sc) - j)) AS w FROM {at}, (VALUES (0), (1)) AS p(i), (VALUES (0), (1)) AS q(j)) a JOIN cells b ON b.r = br AND b.c = bc AND b.z IS NOT NULL WHERE w > 0 GROUP BY a.r, a.c"
    )
    return f"""WITH {SQL_CELLS}, tc AS (SELECT r, c, {_TARGET.west}::DOUBLE + (c + 0.5::DOUBLE) * 30 AS x, {_TARGET.north}::DOUBLE - (r + 0.5::DOUBLE) * 30 AS y FROM cells), {steps},
near AS (SELECT r, c, {place_in(_ZONE_47, "x", "y")} FROM tc), far AS (SELECT r, c, {place_in(_ZONE_48, east, north)} FROM i6), one AS ({weighed("near", 0)}), two AS ({weighed("far", 0.4)})
SELECT g.r, g.c, round(CASE WHEN one.d IS NULL THEN two.d WHEN two.d IS NULL THEN one.d ELSE greatest(one.d, two.d) END, 6) AS depth FROM cells g LEFT JOIN one USING (r, c) LEFT JOIN two USING (r, c)"""


@query(_mosaic_sql())
def utm_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    cells = views.cells(spark, sf)
    own, other = cells.select("row", "col", F.col("z").alias("depth")), cells.select("row", "col", (F.col("z") + 0.4).alias("depth"))
    return reproject.composite([(own, _ZONE_47), (other, _ZONE_48)], cells.select("row", "col"), _TARGET).select(*place(), r6("depth").alias("depth"))


# controls and curves

_PLACED = f"{SQL_CELLS}, {SQL_POINTS}, wet AS (SELECT c * 30 + 15.0::DOUBLE AS x, r * 30 + 15.0::DOUBLE AS y FROM points WHERE cls = 'flood'), land AS (SELECT r, c, c * 30 + 15.0::DOUBLE AS x, r * 30 + 15.0::DOUBLE AS y, z, hand, channel FROM cells)"


def _metres(df: DataFrame) -> DataFrame:
    """``df`` with x and y in metres, cells of 30 m."""
    return df.withColumn("x", F.col("col") * 30 + 15.0).withColumn("y", F.col("row") * 30 + 15.0)


@query(
    f"""WITH RECURSIVE {_PLACED}, cand AS (SELECT l.r, l.c, l.x, l.y, hand, min(sqrt((l.x - w.x) ** 2 + (l.y - w.y) ** 2)) AS d FROM land l, wet w WHERE l.r % 2 = 0 AND l.c % 2 = 0 AND hand BETWEEN 1 AND 4 AND NOT channel GROUP BY ALL HAVING min(sqrt((l.x - w.x) ** 2 + (l.y - w.y) ** 2)) >= 40),
lined AS (SELECT *, row_number() OVER (ORDER BY d DESC, r, c) AS i FROM cand),
g(i, chosen) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(r INTEGER, c INTEGER, x DOUBLE, y DOUBLE, hand DOUBLE, d DOUBLE)[]) UNION ALL
  SELECT l.i, CASE WHEN len(chosen) < 12 AND len(list_filter(chosen, lambda o: (o.x - l.x) ** 2 + (o.y - l.y) ** 2 < 150 ** 2)) = 0 THEN list_append(chosen, {{'r': l.r, 'c': l.c, 'x': l.x, 'y': l.y, 'hand': l.hand, 'd': l.d}}) ELSE chosen END FROM g JOIN lined l ON l.i = g.i + 1),
last AS (SELECT arg_max(chosen, i) AS chosen FROM g)
SELECT CAST(k AS INTEGER) AS rank, chosen[k].r AS r, chosen[k].c AS c, chosen[k].hand AS hand, round(chosen[k].d, 6) AS distance FROM last, range(1, 13) AS t(k) WHERE k <= len(chosen)"""
)
def dry_controls(spark: SparkSession, sf: str) -> DataFrame:
    floods = _metres(views.points(spark, sf).where("cls = 'flood'")).select("x", "y")
    found = controls.dry_controls(_metres(views.cells(spark, sf)), floods, 1.0, 4.0, apart_m=40.0, between_m=150.0, stride=2)
    return found.select("rank", *place(), "hand", r6("distance").alias("distance"))


@query(f"WITH {_PLACED} SELECT r, c FROM land l WHERE z IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wet w WHERE sqrt((l.x - w.x) ** 2 + (l.y - w.y) ** 2) < 50) ORDER BY md5('2026:' || r || ':' || c), r, c LIMIT 60")
def random_negatives(spark: SparkSession, sf: str) -> DataFrame:
    floods = _metres(views.points(spark, sf).where("cls = 'flood'"))
    return controls.random_negatives(_metres(views.cells(spark, sf).where("z is not null")), floods, 60, 50.0).select(*place())


@query()
def curve_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Curves of the documented floods against random cells away from them, by the depth of a bathtub."""
    cells = views.cells(spark, sf)
    floods = views.points(spark, sf).where("cls = 'flood'").select("row", "col")
    dry = controls.random_negatives(_metres(cells.where("z is not null")), _metres(floods), 200, 50.0).select("row", "col")
    both = floods.withColumn("cls", F.lit("flood")).unionByName(dry.withColumn("cls", F.lit("dry")))
    scored = both.join(cells.select("row", "col", D.bathtub("z", 2.0).alias("score")), ["row", "col"], "left").fillna(0.0, "score")
    bands = resampling.curve_bands(scored.select("cls", "score"), n_boot=1000)
    return bands.select("curve", "at", r6("mean").alias("mean"), r6("low").alias("low"), r6("high").alias("high"))


# SQL, and the city's run


@query(f"WITH {SQL_CELLS}, low AS (SELECT a.r, a.c, min(b.z) AS low FROM cells a JOIN cells b ON {_AB} AND a.r // 8 = b.r // 8 AND a.c // 8 = b.c // 8 WHERE a.z IS NOT NULL GROUP BY a.r, a.c) SELECT r, c, round(low, 6) AS low FROM low")
def sql_table_function(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.sql import register

    register(spark)
    views.cells(spark, sf).withColumn("tile", F.concat_ws(":", F.floor(F.col("row") / 8), F.floor(F.col("col") / 8))).createOrReplaceTempView("tidemark_tiled")
    return spark.sql("SELECT row AS r, col AS c, round(low, 6) AS low FROM tile_lowest(TABLE(SELECT row, col, z, tile FROM tidemark_tiled) PARTITION BY tile)")


_SCENARIOS = ", ".join(f"('{s}', {h}, {w[0]}::DOUBLE)" for (s, h), w in forcing.WARMING.items())


@query(
    f"WITH {SQL_TABLE_LEVELS}, s(scenario, horizon, warming) AS (VALUES {_SCENARIOS}) SELECT hazard_type, return_period, scenario, CAST(horizon AS INTEGER) AS horizon, "
    "round(CASE hazard_type WHEN 'coastal' THEN water_level_m + warming / 5 WHEN 'fluvial' THEN water_level_m * pow(1 + 0.07 * warming, 0.6) ELSE water_level_m * (1 + 0.07 * warming) END, 6) AS water_level_m FROM levels, s"
)
def city_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The levels of a city's run, read from its store after a second run that computes nothing."""
    sources = {
        "baseline": city.Source(views.table_levels(spark, sf), f"levels of {sf}"),
        "scenarios": city.Source(forcing.warming(spark).withColumn("coastal_delta_m", F.col("warming") / 5), "table"),
    }
    store, stages = scratch(spark, "city"), tuple(s for s in city.CITY if s.name == "levels")
    city.run(spark, store, sources, {"rate": 0.07}, stages)
    tables_, computed = city.run(spark, store, sources, {"rate": 0.07}, stages)
    return tables_["levels"].where(F.lit(not computed)).select("hazard_type", "return_period", "scenario", "horizon", r6("water_level_m").alias("water_level_m"))


# registers and pooled fits


@query(
    f"""WITH {SQL_CELLS}, {SQL_POINTS}, p AS (SELECT label, cls, r, c, CASE WHEN label % 7 <> 3 THEN c * 30 + 15.0::DOUBLE END AS x, CASE WHEN label % 7 <> 3 THEN r * 30 + 15.0::DOUBLE END AS y FROM points),
d AS (SELECT a.label, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM p a JOIN p b ON a.cls = 'dry' AND b.cls = 'flood' AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY a.label),
t AS (SELECT p.*, g.z, d.d, CASE WHEN x IS NULL THEN 'no place' WHEN g.z IS NULL THEN 'off the ground' WHEN cls = 'flood' AND g.z > 2 THEN 'flood on high ground' WHEN cls = 'dry' AND d.d < 35 THEN 'dry beside a flood' ELSE 'ok' END AS flag FROM p LEFT JOIN cells g USING (r, c) LEFT JOIN d USING (label))
SELECT label, cls, round(z, 6) AS elevation, round(d, 6) AS to_flood, flag, CASE flag WHEN 'ok' THEN 'high' WHEN 'no place' THEN 'failed' ELSE 'low' END AS confidence FROM t"""
)
def register_confidence(spark: SparkSession, sf: str) -> DataFrame:
    lost = F.col("label") % 7 == 3
    points = _metres(views.points(spark, sf)).withColumns({"x": F.when(~lost, F.col("x")), "y": F.when(~lost, F.col("y"))})
    found = controls.assessed_register(points, views.cells(spark, sf), flood_highest=2.0, dry_nearest_m=35.0)
    return found.select("label", "cls", r6("elevation").alias("elevation"), r6("to_flood").alias("to_flood"), "flag", "confidence")


@query()
def pooled_station_bias(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of a law through the pooled yearly maxima of all series against that of the first series alone."""
    maxima = views.annual_max(spark, sf).withColumn("max_value", F.col("max_value") / 1000)
    law = gev_fit(maxima.where("series_id = 'A'")).select("xi", "mu", "sigma")
    found = checks.pooled_bias(maxima, law, forcing.return_periods(spark))
    return found.select("return_period", F.round("pooled", 3).alias("pooled"), F.round("ratio", 4).alias("ratio"))
