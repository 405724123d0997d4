"""Registered queries of forcing chains, checks, sources and diagnostics, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import depth as D
from tidemark.functions import geo
from tidemark.functions import hydrology as H
from tidemark.operators import graph, grid, scoring, zonal
from tidemark.operators import series as S
from tidemark.plans import checks, diagnostics, forcing, hazard, views
from tidemark.plans.views import SQL_CELLS, SQL_LEVELS, SQL_POINTS, SQL_SERIES, SQL_TABLE_LEVELS
from tidemark.queries import _BATH, _GUMBEL, _HITS, _PATH, _PERIODS, _bath, _law, _scored, place, query, r6, smooth
from tidemark.sources import tables
from tidemark.sources.storage import scratch


def _params(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, xi, mu, sigma) of the annual maxima, scaled to plausible rain."""
    return _law(spark, sf).select("series_id", F.lit(0.0).alias("xi"), (F.col("mu") / 1000).alias("mu"), (F.col("sigma") / 1000).alias("sigma"))


_QUANTILES = f"WITH {_GUMBEL}, q AS (SELECT series_id, rp AS return_period, mu / 1000 - sigma / 1000 * ln(-ln(1 - 1.0::DOUBLE / rp)) AS q FROM law, {_PERIODS})"


def _stage(q: str, width: float, n: float, slope: float) -> str:
    return f"(CASE WHEN {q} <= 0 THEN 0 ELSE pow({q} * {n} / ({width} * sqrt({slope}::DOUBLE)), 0.6) END)"


# forcing


@query(f"{_QUANTILES} SELECT series_id, return_period, round(greatest({_stage('(0.8 * q)', 50, 0.03, 0.0005)} - {_stage('20.0', 50, 0.03, 0.0005)}, 0), 6) AS stage_m FROM q")
def overbank_stages(spark: SparkSession, sf: str) -> DataFrame:
    rise = H.overbank_stage("xi", "mu", "sigma", "return_period", 0.8, 20.0, 50, 0.03, 0.0005)
    return _params(spark, sf).join(F.broadcast(forcing.return_periods(spark))).select("series_id", "return_period", r6(rise).alias("stage_m"))


@query(
    "SELECT l_orderkey AS k, l_linenumber AS n, round(greatest(greatest(l_quantity, 1) - 20, 0) / 1000::DOUBLE, 6) AS excess_m, round(least(greatest(l_quantity * 40 / 1000::DOUBLE * 0.7 / 0.8, 0.005), 3.0), 4) AS cap_m, "
    "round(l_discount * 10 + greatest(0.5 * (l_extendedprice - 20000) * 1.053e-5, 0), 6) AS backwater_m FROM lineitem"
)
def rain_and_backwater(spark: SparkSession, sf: str) -> DataFrame:
    li = views.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), r6(H.excess_rain("l_quantity", 20.0)).alias("excess_m"), H.ponding_cap(F.col("l_quantity") * 40, 0.7, 0.8).alias("cap_m"),
        r6(H.backwater_stage(F.col("l_discount") * 10, "l_extendedprice", 20000.0)).alias("backwater_m"),
    )


_WARM = ", ".join(f"('{s}', {h}, {w[0]}::DOUBLE, {w[1]}::DOUBLE)" for (s, h), w in forcing.WARMING.items())


@query(f"WITH w(scenario, horizon, air, sea) AS (VALUES {_WARM}) SELECT p.p_partkey AS k, scenario, CAST(horizon AS INTEGER) AS horizon, round(air, 6) AS air, round(sea, 6) AS sea FROM part p JOIN w ON horizon = CASE p_size % 3 WHEN 0 THEN 2020 WHEN 1 THEN 2050 ELSE 2100 END")
def warming_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = views.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.element_at(F.array(F.lit(2020), F.lit(2050), F.lit(2100)), (F.col("p_size") % 3 + 1).cast("int")).alias("horizon"))
    both = forcing.warming(spark).withColumnRenamed("warming", "air").join(forcing.warming(spark, "SEA").withColumnRenamed("warming", "sea"), ["scenario", "horizon"])
    return asked.join(F.broadcast(both), "horizon").select("k", "scenario", "horizon", r6("air").alias("air"), r6("sea").alias("sea"))


@query(
    f"WITH {SQL_TABLE_LEVELS}, b AS (SELECT *, CASE WHEN return_period > 100 THEN 'gauge; v2' ELSE 'gauge' END AS s FROM levels) SELECT hazard_type, return_period, CASE WHEN hazard_type = 'coastal' AND return_period <= 100 THEN round(water_level_m + 0.95 - 1.2, 4) ELSE round(water_level_m, 6) END AS level_m, "
    "CASE WHEN hazard_type = 'coastal' AND return_period <= 100 THEN 'gauge; v2' ELSE s END AS source_note, CASE WHEN hazard_type = 'coastal' AND return_period <= 100 THEN 'EGM2008; MSL+0.950 m' ELSE 'EGM2008; MSL+1.200 m' END AS datum_note FROM b"
)
def datum_patch(spark: SparkSession, sf: str) -> DataFrame:
    base = views.table_levels(spark, sf).select("hazard_type", "return_period", F.col("water_level_m").alias("baseline_water_level_m"), F.when(F.col("return_period") > 100, "gauge; v2").otherwise("gauge").alias("source_note"), H.datum_note(F.lit(1.2)).alias("datum_note"))
    return forcing.patched_datum(base, 0.95, "v2").select("hazard_type", "return_period", r6("baseline_water_level_m").alias("level_m"), "source_note", "datum_note")


@query(
    f"WITH {SQL_CELLS}, {SQL_POINTS}, k AS (SELECT r, c, z FROM cells WHERE z IS NOT NULL), m AS (SELECT label, p.r AS pr, p.c AS pc, k.r - p.r AS i, k.c - p.c AS j, z, 0.4::DOUBLE - (k.r - p.r) AS dy, 0.7::DOUBLE - (k.c - p.c) AS dx FROM points p JOIN k ON k.r - p.r BETWEEN -4 AND 5 AND k.c - p.c BETWEEN -4 AND 5), "
    "f AS (SELECT label, count(*) FILTER (i IN (0, 1) AND j IN (0, 1)) AS n, sum(z * (1 - abs(dy)) * (1 - abs(dx))) FILTER (i IN (0, 1) AND j IN (0, 1)) AS v, arg_min(z, round((dy * dy + dx * dx) * 0.0625, 9) * 1e6 + z / 1e6) FILTER ((dy * dy + dx * dx) * 0.0625 <= 1) AS near FROM m GROUP BY label) "
    "SELECT p.label, round(CASE WHEN n = 4 THEN v ELSE near END, 6) AS mdt FROM points p LEFT JOIN f USING (label)"
)
def mdt_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    field = views.cells(spark, sf).select((F.col("row") * 0.25).alias("lat"), (F.col("col") * 0.25).alias("lon"), F.col("z").alias("mdt"))
    at = views.points(spark, sf).select("label", ((F.col("row") + 0.4) * 0.25).alias("lat"), ((F.col("col") + 0.7) * 0.25).alias("lon"))
    return forcing.grid_value(field, at, 0.25).select("label", r6("mdt").alias("mdt"))


@query(
    "WITH l AS (SELECT l_returnflag AS series_id, CASE WHEN year(l_shipdate) < 1995 OR year(l_shipdate) = 1995 AND l_linenumber < 3 THEN 1 ELSE 2 END AS block, CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS v FROM lineitem), m AS (SELECT series_id, block, avg(v) AS m FROM l GROUP BY 1, 2), "
    "a AS (SELECT l.series_id, block, year, max(v - m) AS x, count(v) AS n FROM l JOIN m USING (series_id, block) GROUP BY 1, 2, 3 HAVING count(v) >= 50) SELECT series_id, year, round(arg_max(x, block), 4) AS max_value, arg_max(n, block) AS n_valid FROM a GROUP BY 1, 2"
)
def record_splicing(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("l_shipdate")
    block = F.when((year < 1995) | ((year == 1995) & (F.col("l_linenumber") < 3)), 1).otherwise(2)
    li = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), block.alias("block"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"))
    return S.spliced_maxima(li, 50).select("series_id", "year", F.round("max_value", 4).alias("max_value"), "n_valid")


@query(
    f"WITH {SQL_TABLE_LEVELS}, x AS (SELECT return_period, least(water_level_m + (water_level_m * 0.5 + 0.01 * (return_period % 3)) * 1.8 / 4.0, 0.5) AS v FROM levels WHERE hazard_type = 'pluvial') "
    "SELECT return_period, round(v, 6) AS water_level_m, coalesce(v >= lag(v) OVER (ORDER BY return_period), TRUE) AS rises FROM x"
)
def interpolated_pluvial(spark: SparkSession, sf: str) -> DataFrame:
    base = views.table_levels(spark, sf).where("hazard_type = 'pluvial'").withColumn("city", F.lit("a"))
    top = base.withColumn("water_level_m", F.col("water_level_m") * 1.5 + 0.01 * (F.col("return_period") % 3))
    return forcing.interpolated_levels(base, top, 1.8, 4.0, by=("city",)).select("return_period", r6("water_level_m").alias("water_level_m"), "rises")


@query(f"{_QUANTILES} SELECT series_id, return_period, round(greatest(greatest(q, 1) - 35.5, 0) / 1000, 6) AS level_m FROM q")
def baseline_migration(spark: SparkSession, sf: str) -> DataFrame:
    stored = _params(spark, sf).join(F.broadcast(forcing.return_periods(spark))).select("series_id", "return_period", F.col("xi").alias("gev_shape"), F.col("mu").alias("gev_loc_mm"), F.col("sigma").alias("gev_scale_mm"), F.lit("fit; drain_capacity=35.5").alias("source_note"))
    return checks.redone_excess(stored).select("series_id", "return_period", r6("level_m").alias("level_m"))


_REFIT = f"{_QUANTILES}, c AS (SELECT *, round(least(greatest(greatest(q - 40, 0) / 1000 * 0.7 / 0.8, 0.005), 3.0), 4) AS cap FROM q)"


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    a = views.annual_max(spark, sf).groupBy("series_id").agg((F.median("max_value") / 1000).alias("x_a"), (F.max("max_value") / 1000).alias("x_b"))
    return a.withColumn("rp_a", F.lit(2)).withColumn("rp_b", F.lit(100))


@query(f"{_REFIT} SELECT series_id, return_period, round(q, 6) AS rain_mm, cap AS cap_m FROM c")
def idf_refit_levels(spark: SparkSession, sf: str) -> DataFrame:
    return forcing.idf_refit(_anchors(spark, sf), forcing.return_periods(spark), 40.0, 0.7, 0.8).select("series_id", "return_period", r6("rain_mm").alias("rain_mm"), "cap_m")


@query(
    f"{_REFIT}, s AS (SELECT series_id, return_period, cap, cap + CASE WHEN return_period = 50 THEN 0.01 ELSE 0 END AS stored FROM c), l AS (SELECT *, lag(stored) OVER (PARTITION BY series_id ORDER BY return_period) AS b FROM s) SELECT series_id, return_period, cap AS expected_m, "
    "CASE WHEN abs(stored - cap) > 0.001 THEN 'FAIL' WHEN stored < b THEN 'FAIL' WHEN stored <= 0.005 THEN 'WARN' WHEN stored >= 3.0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM l"
)
def cap_reproducibility(spark: SparkSession, sf: str) -> DataFrame:
    made = forcing.idf_refit(_anchors(spark, sf), forcing.return_periods(spark), 40.0, 0.7, 0.8)
    stored = made.withColumn("cap_m", F.col("cap_m") + F.when(F.col("return_period") == 50, 0.01).otherwise(0.0))
    return checks.cap_reproduction(stored.select("series_id", "return_period", "cap_m", "rp_a", "x_a", "rp_b", "x_b"), 40.0, 0.7, 0.8, by=("series_id",)).select("series_id", "return_period", "expected_m", "verdict")


@query(f"{_QUANTILES} SELECT series_id, 'coastal' AS hazard_type, return_period, round(greatest(q + 0.35, 60.0), 3) AS baseline_water_level_m, 'EGM2008; MSL+0.350 m' AS datum_note FROM q")
def coastal_baseline_levels(spark: SparkSession, sf: str) -> DataFrame:
    return forcing.coastal_levels(_params(spark, sf), 0.35, forcing.return_periods(spark), 60.0).select("series_id", "hazard_type", "return_period", "baseline_water_level_m", "datum_note")


_BASIN = {"cn": 85.0, "area_km2": 10.0, "duration_h": 24.0, "concentration_h": 0.5, "width": 10.0, "n": 0.04, "slope": 0.002}
_SOIL = "(25400 / 85.0::DOUBLE - 254)"


@query(
    f"{_QUANTILES}, p AS (SELECT *, 0.208 * 10 * CASE WHEN q <= 0.2 * {_SOIL} THEN 0 ELSE (q - 0.2 * {_SOIL}) ** 2 / (q + 0.8 * {_SOIL}) END / (24 / 2.0 + 0.6 * 0.5) AS peak FROM q) "
    f"SELECT series_id, hazard_type, return_period, round(level, 4) AS level_m FROM (SELECT series_id, 'fluvial' AS hazard_type, return_period, least(greatest({_stage('peak', 10, 0.04, 0.002)}, 0.05), 8.0) AS level FROM p)"
)
def fluvial_baseline_rain(spark: SparkSession, sf: str) -> DataFrame:
    return forcing.fluvial_from_rain(_params(spark, sf), forcing.return_periods(spark), _BASIN).select("series_id", "hazard_type", "return_period", F.round("baseline_water_level_m", 4).alias("level_m"))


@query(f"{_QUANTILES} SELECT series_id, 'fluvial' AS hazard_type, q.return_period, round(least(greatest({_stage('greatest(q.q, 1)', 30, 0.035, 0.001)} - {_stage('greatest(b.q, 1)', 30, 0.035, 0.001)}, 0.05), 8.0), 6) AS level_m FROM q JOIN (SELECT series_id, q FROM q WHERE return_period = 2) b USING (series_id)")
def fluvial_baseline_discharge(spark: SparkSession, sf: str) -> DataFrame:
    channel = {"width": 30.0, "n": 0.035, "slope": 0.001}
    return forcing.fluvial_levels(_params(spark, sf), forcing.return_periods(spark), channel).select("series_id", "hazard_type", "return_period", r6("baseline_water_level_m").alias("level_m"))


@query(f"{_QUANTILES} SELECT series_id, 'pluvial' AS hazard_type, return_period, round(greatest(greatest(q, 1) - 50, 0) / 1000, 6) AS level_m FROM q")
def pluvial_baseline_levels(spark: SparkSession, sf: str) -> DataFrame:
    return forcing.pluvial_levels(_params(spark, sf), forcing.return_periods(spark), 50.0).select("series_id", "hazard_type", "return_period", r6("baseline_water_level_m").alias("level_m"))


_SLC = "s AS (SELECT l_returnflag AS scenario, l_linenumber AS sample, CAST(year(l_shipdate) AS INTEGER) AS year, max(l_extendedprice) / 1000 AS slc FROM lineitem GROUP BY ALL)"


@query(
    f"WITH {_SLC}, d AS (SELECT scenario, t.year AS horizon, quantile_cont(s.slc - b.slc, 0.5) AS delta FROM s JOIN (SELECT scenario, sample, slc FROM s WHERE year = 1996) b USING (scenario, sample) JOIN (VALUES (1998), (2000)) t(year) ON s.year = t.year WHERE s.scenario <> 'R' GROUP BY 1, 2) "
    "SELECT scenario, CAST(horizon AS INTEGER) AS horizon, round(delta, 6) AS water_level_m, 'samples' AS source_note FROM d UNION ALL SELECT 'R', 1998, 0.25, 'cached' UNION ALL SELECT 'R', 2000, 0.5, 'cached'"
)
def scenario_table(spark: SparkSession, sf: str) -> DataFrame:
    li = views.table(spark, sf, "lineitem")
    samples = li.groupBy(F.col("l_returnflag").alias("scenario"), F.col("l_linenumber").alias("sample"), F.year("l_shipdate").alias("year")).agg((F.max("l_extendedprice") / 1000).alias("slc")).withColumn("units", F.lit("m"))
    site = {"workflow": "wf", "lat": 1.3, "lon": 103.8, "percentile": 50.0, "base": 1996}
    wanted = li.select(F.col("l_returnflag").alias("scenario")).distinct().join(F.broadcast(spark.createDataFrame([(1998,), (2000,)], "horizon int")))
    text = '{"wf|R|1.3000|103.8000|50.0|1996|1998": {"water_level_m": 0.25, "source_note": "cached"}, "wf|R|1.3000|103.8000|50.0|1996|2000": {"water_level_m": 0.5, "source_note": "cached"}}'
    cache = tables.read_cache(spark.createDataFrame([(text,)], "value string"))
    return forcing.scenario_table(wanted, cache, samples, **site).select("scenario", "horizon", r6("water_level_m").alias("water_level_m"), "source_note")


# checks and scores


@query(
    f"WITH {_HITS}, k AS (SELECT CAST(label % 4 AS INTEGER) AS city, count(*) FILTER (cls = 'flood') AS np, count(*) FILTER (cls <> 'flood') AS nn, count(*) FILTER (cls = 'flood' AND score >= 1.0) AS h, count(*) FILTER (cls <> 'flood' AND score < 1.0) AS j FROM s GROUP BY 1), "
    "t AS (SELECT city, CASE WHEN np > 0 THEN h / np ELSE 0 END AS hr, CASE WHEN nn > 0 THEN j / nn ELSE 1 END AS crr FROM k) SELECT city, round(hr + crr - 1, 6) AS tss, concat_ws('; ', CASE WHEN hr < 0.6 THEN 'HR below 0.6' END, CASE WHEN crr < 0.5 THEN 'CRR below 0.5' END, CASE WHEN hr + crr - 1 - 0.1 < 0 THEN 'TSS margin not met' END) AS reasons, "
    "NOT (hr < 0.6 OR crr < 0.5 OR hr + crr - 1 - 0.1 < 0) AS passed FROM t"
)
def hotspot_validation(spark: SparkSession, sf: str) -> DataFrame:
    city = (F.col("label") % 4).cast("int").alias("city")
    scored = scoring.point_scores(views.points(spark, sf).withColumn("city", city), views.cells(spark, sf).withColumn("depth", D.bathtub("z", 0.2)), threshold=1.0)
    return scoring.validated(scored, "city", hr_floor=0.6, crr_floor=0.5, baseline_tss=0.1).select("city", r6("tss").alias("tss"), F.array_join("reasons", "; ").alias("reasons"), "passed")


@query(
    f"WITH {_BATH}, o AS (SELECT b.*, d > 0.1 AS m, channel AS o FROM bath b JOIN (SELECT r, c, channel FROM cells) USING (r, c)), k AS (SELECT hazard_type, return_period, count(*) FILTER (m AND o) AS tp, count(*) FILTER (coalesce(m, FALSE) AND NOT o) AS fp, count(*) FILTER (NOT coalesce(m, FALSE) AND o) AS fn FROM o GROUP BY 1, 2), "
    "s AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS csi FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY hazard_type ORDER BY csi DESC, return_period) AS n FROM s) "
    "SELECT hazard_type, return_period, tp, fp, fn, round(csi, 6) AS csi, CASE WHEN csi >= 0.3 THEN 'PASS' WHEN csi >= 0.15 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM b WHERE n = 1"
)
def event_validation(spark: SparkSession, sf: str) -> DataFrame:
    masks = _bath(spark, sf).select("hazard_type", "return_period", (F.col("depth") > 0.1).alias("modelled"), F.col("channel").alias("observed"))
    best = scoring.best_match(scoring.contingency(masks, "hazard_type", "return_period"), "hazard_type", limited_km2=0.0)
    return best.select("hazard_type", "return_period", "tp", "fp", "fn", r6("csi").alias("csi"), "verdict")


@query(
    f"WITH {SQL_CELLS}, {SQL_POINTS}, m AS (SELECT p.label, max(CASE WHEN z IS NOT NULL THEN greatest(0.9 - z, 0) END) AS d FROM points p LEFT JOIN cells g ON abs(g.r - p.r) <= 2 AND abs(g.c - p.c) <= 2 GROUP BY 1) "
    "SELECT label, round(d, 6) AS model, CASE WHEN d IS NULL THEN 'OUTSIDE-DOMAIN' WHEN d < label % 3 * 0.5 THEN 'UNDER' WHEN d > label % 3 * 0.5 + 0.8 THEN 'OVER' ELSE 'IN-BAND' END AS verdict FROM m"
)
def hwm_bands(spark: SparkSession, sf: str) -> DataFrame:
    marks = views.points(spark, sf).select("label", "row", "col", (F.col("label") % 3 * 0.5).alias("low"), (F.col("label") % 3 * 0.5 + 0.8).alias("high"))
    return scoring.band_check(marks, views.cells(spark, sf).withColumn("depth", D.bathtub("z", 0.9)), 2).select("label", r6("model").alias("model"), "verdict")


@query(
    f"WITH {_BATH}, p AS (SELECT hazard_type, return_period, count(*) FILTER (d > 0) * 900.0 / 1e6 AS a FROM bath GROUP BY ALL), x AS (SELECT *, a * CASE WHEN return_period = 25 THEN 1.2 WHEN return_period > 200 THEN 0.6 ELSE 0.9 END AS own FROM p), y AS (SELECT *, lag(own) OVER (PARTITION BY hazard_type ORDER BY return_period) AS b FROM x) "
    "SELECT hazard_type, return_period, 'over undefended' AS problem FROM y WHERE own > a * 1.05 UNION ALL SELECT hazard_type, return_period, 'falls' FROM y WHERE own < b * 0.95 UNION ALL SELECT hazard_type, return_period, 'two-year area too large' FROM y WHERE return_period = 2 AND own > 0.1"
)
def defence_checks(spark: SparkSession, sf: str) -> DataFrame:
    plain = zonal.depth_summary(_bath(spark, sf), "hazard_type", "return_period")
    rp = F.col("return_period")
    defended = plain.withColumn("flooded_area_km2", F.col("flooded_area_km2") * F.when(rp == 25, 1.2).when(rp > 200, 0.6).otherwise(0.9))
    return checks.defence_problems(defended, plain, rp2_cap_km2=0.1)


@query(
    "WITH m AS (SELECT CAST(l_linenumber AS INTEGER) AS city, avg(l_discount) AS d FROM lineitem GROUP BY 1), d AS (SELECT city, rp AS return_period, d * CASE WHEN rp = 50 THEN 0.3 ELSE 1 END * ln(rp) AS deep FROM m, " + _PERIODS + "), x AS (SELECT *, lag(deep) OVER (PARTITION BY city ORDER BY return_period) AS b FROM d) "
    "SELECT city, return_period, 'too shallow' AS problem FROM x WHERE return_period >= 10 AND deep < 0.035 UNION ALL SELECT city, return_period, 'thousand-year depth' FROM x WHERE return_period = 1000 AND NOT deep BETWEEN 0.38 AND 3.0 UNION ALL SELECT city, return_period, 'falls' FROM x WHERE deep < b"
)
def depth_anchor_checks(spark: SparkSession, sf: str) -> DataFrame:
    mean = views.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("city")).agg(F.avg("l_discount").alias("d"))
    deep = mean.join(F.broadcast(forcing.return_periods(spark))).select("city", "return_period", (F.col("d") * F.when(F.col("return_period") == 50, 0.3).otherwise(1.0) * F.ln("return_period")).alias("max_depth_m"))
    return checks.depth_anchors(deep, by=("city",)).select("city", "return_period", "problem")


@query(f"WITH {_GUMBEL}, r AS (SELECT series_id, rp AS return_period, (mu - sigma * ln(-ln(1 - 1.0::DOUBLE / rp))) AS q FROM law, {_PERIODS}) SELECT series_id, return_period, round(q / p, 6) AS ratio FROM r JOIN (SELECT return_period, avg(q) AS p FROM r GROUP BY 1) USING (return_period)")
def station_bias(spark: SparkSession, sf: str) -> DataFrame:
    law = _law(spark, sf).withColumn("xi", F.lit(0.0))
    levels = law.join(F.broadcast(forcing.return_periods(spark))).select("series_id", "return_period", H.gev_quantile("xi", "mu", "sigma", "return_period").alias("level"))
    pooled = levels.groupBy("return_period").agg(F.avg("level").alias("pooled"))
    return checks.bias_by_period(levels, pooled).select("series_id", "return_period", r6("ratio").alias("ratio"))


@query(
    f"WITH {_GUMBEL}, e AS (SELECT series_id, max(max_value) * 0.98 AS peak FROM annual GROUP BY 1), f AS (SELECT series_id, 1 / (1 - least(greatest(exp(-exp(-(peak - mu) / sigma)), 1e-9), 1 - 1e-9)) AS rp FROM e JOIN law USING (series_id)) "
    f"SELECT series_id, round(rp, 4) AS rp, CAST(max(p.rp1) FILTER (p.rp1 <= rp) AS INTEGER) AS lower, CAST(min(p.rp1) FILTER (p.rp1 >= rp) AS INTEGER) AS upper FROM f, (SELECT rp AS rp1 FROM {_PERIODS}) p GROUP BY series_id, rp"
)
def event_bracket(spark: SparkSession, sf: str) -> DataFrame:
    peaks = views.annual_max(spark, sf).groupBy("series_id").agg((F.max("max_value") * 0.98).alias("peak"))
    out = checks.event_bracket(peaks, _law(spark, sf).withColumn("xi", F.lit(0.0)), forcing.return_periods(spark))
    return out.select("series_id", F.round("rp", 4).alias("rp"), "lower", "upper")


# sources


@query("SELECT date_trunc('hour', ts) AS ts, CASE WHEN sum(value) - 100 >= 0 THEN round(sum(value) - 100, 4) END AS value FROM events GROUP BY 1")
def rain_payload(spark: SparkSession, sf: str) -> DataFrame:
    hours = views.table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg((F.sum("value") - 100).alias("v"))
    pairs = hours.groupBy(F.to_date("h").alias("day")).agg(F.sort_array(F.collect_list(F.struct(F.date_format("h", "yyyy-MM-dd'T'HH:mm").alias("t"), "v"))).alias("p"))
    # one payload a day; every time twice: the second of equal times has no say
    twice = F.concat("p", F.transform("p", lambda x: F.struct(x["t"].alias("t"), (x["v"] + 1000).alias("v"))))
    payload = pairs.select(F.to_json(F.struct(F.struct(F.transform(twice, lambda x: x["t"]).alias("time"), F.transform(twice, lambda x: x["v"]).alias("precipitation")).alias("hourly"))).alias("payload"))
    return tables.hourly_payload(payload).select("ts", F.round("value", 4).alias("value"))


@query("SELECT ts, CASE WHEN event_type <> 'click' THEN round(value / 1000, 9) END AS value FROM events WHERE ts IS NOT NULL")
def gauge_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select(F.col("ts").cast("string").alias("time"), F.when(F.col("event_type") == "click", "-32767").otherwise(F.col("value").cast("string")).alias("sea_level"))
    units = spark.createDataFrame([("UTC", "millimeters")], "time string, sea_level string")
    return tables.tide_gauge(units.union(e)).select("ts", F.round("value", 9).alias("value"))


@query("SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS answered, CASE WHEN s_suppkey % 3 = 0 THEN round(s_acctbal, 2) END AS water_level_m FROM supplier")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = views.table(spark, sf, "supplier")
    key = tables.cache_key(F.lit("wf"), F.lit("ssp585"), F.col("s_suppkey") / 10, F.lit(100.5), F.lit(50), F.lit(2005), F.lit(2100))
    asked, cache = s.select("s_suppkey", key.alias("key")), s.where("s_suppkey % 3 = 0").select(key.alias("key"), F.round("s_acctbal", 2).cast("double").alias("water_level_m"))
    hits, misses = tables.cached(asked, cache)
    return hits.select(F.col("s_suppkey").alias("k"), F.lit(True).alias("answered"), "water_level_m").union(misses.select("s_suppkey", F.lit(False), F.lit(None).cast("double")))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 > 0 THEN round(s_suppkey % 7 * 0.5, 4) END AS lat, s_suppkey % 5 > 0 AND s_suppkey % 7 * 0.5 BETWEEN 1 AND 2 AS inside FROM supplier")
def geocode_hits(spark: SparkSession, sf: str) -> DataFrame:
    lat = (F.col("s_suppkey") % 7 * 0.5).cast("string")
    hit = F.struct(F.col("s_name").alias("SEARCHVAL"), lat.alias("LATITUDE"), F.lit("103.8").alias("LONGITUDE"))
    other = F.struct(F.lit("later").alias("SEARCHVAL"), F.lit("9").alias("LATITUDE"), F.lit("9").alias("LONGITUDE"))
    found = F.when(F.col("s_suppkey") % 5 > 0, F.array(hit, other)).otherwise(F.array().cast("array<struct<SEARCHVAL: string, LATITUDE: string, LONGITUDE: string>>"))
    answers = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.to_json(F.struct(found.alias("results"))).alias("payload"))
    return tables.first_geocode(answers, 103.0, 104.0, 1.0, 2.0).select("k", "name", F.round("lat", 4).alias("lat"), "inside")


@query("SELECT s_suppkey AS k, CAST(4 AS INTEGER) AS corners, round(100 + s_suppkey % 9 + 0.5, 4) AS east FROM supplier WHERE s_suppkey % 10 / 10.0::DOUBLE >= 0.7 AND 100 + s_suppkey % 9 BETWEEN 102 AND 106")
def footprint_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    x = (100 + k % 9).cast("double")
    wkt = F.format_string("POLYGON ((%.1f 1.0, %.1f 1.0, %.1f 1.5, %.1f 1.5))", x, x + 0.5, x + 0.5, x)
    rows = views.table(spark, sf, "supplier").select(k.alias("k"), (k % 10 / 10.0).alias("confidence"), x.alias("longitude"), F.lit(1.2).alias("latitude"), wkt.alias("geometry"))
    ring = tables.ring_of(F.col("geometry"))
    return tables.bounded_polygons(rows, 102, 106, 1, 2).select("k", F.size(ring).alias("corners"), F.round(F.array_max(F.transform(ring, lambda p: p["x"])), 4).alias("east"))


_KIND = "CASE s_suppkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'dry' WHEN 2 THEN 'wet' END"


@query(f"SELECT s_name AS label, CASE {_KIND} WHEN 'positive' THEN 'flood' ELSE 'dry' END AS cls, s_suppkey % 7 * 1.0::DOUBLE AS lon FROM supplier WHERE s_suppkey % 7 > 0 AND {_KIND} IN ('positive', 'dry')")
def manifest_register(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "positive").when(k % 4 == 1, "dry").when(k % 4 == 2, "wet")
    points = views.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(k % 7 > 0, (k % 7).cast("double")).alias("lon"), F.lit(1.0).alias("lat"), kind.alias("kind"), F.lit("high").alias("confidence"), F.lit("report").alias("source"))
    return tables.manifest_hotspots(points).select("label", "cls", "lon")


@query(
    "WITH h AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'dry' END AS class, CASE WHEN s_suppkey % 5 > 0 THEN 'x' ELSE ' ' END AS src, s_suppkey * 10.0 AS lon FROM supplier) SELECT k, 'class must be flood or dry' AS problem FROM h WHERE class IS NULL "
    "UNION ALL SELECT k, 'source is blank' FROM h WHERE src = ' ' UNION ALL SELECT k, 'lon out of range' FROM h WHERE lon > 180"
)
def hotspot_row_problems(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    points = views.table(spark, sf, "supplier").select(k.alias("k"), F.when(k % 3 == 0, "flood").when(k % 3 == 1, "dry").alias("class"), F.when(k % 5 > 0, "x").otherwise(" ").alias("source"), (k * 10.0).alias("lon"), F.lit(1.0).alias("lat"))
    return tables.hotspot_problems(points).select("k", "problem")


@query(f"WITH {SQL_LEVELS} SELECT hazard_type, return_period, round(water_level_m, 6) AS water_level_m, CAST(NULL AS VARCHAR) AS source_note FROM levels WHERE hazard_type <> 'pluvial' UNION ALL SELECT 'pluvial', CAST(p_size AS INTEGER), round(max(p_retailprice), 6), 'new' FROM part GROUP BY p_size")
def replaced_slice(spark: SparkSession, sf: str) -> DataFrame:
    new = views.table(spark, sf, "part").groupBy(F.col("p_size").cast("int").alias("return_period")).agg(F.max("p_retailprice").cast("double").alias("water_level_m")).select(F.lit("pluvial").alias("hazard_type"), "return_period", "water_level_m", F.lit("new").alias("source_note"))
    return tables.replace_slice(views.levels(spark).select("hazard_type", "return_period", "water_level_m"), new, "pluvial").select("hazard_type", "return_period", r6("water_level_m").alias("water_level_m"), "source_note")


@query(f"WITH {_BATH} SELECT hazard_type, return_period, count(*) FILTER (d > 1) > 0 AS done FROM bath GROUP BY ALL")
def output_progress(spark: SparkSession, sf: str) -> DataFrame:
    deep = _bath(spark, sf).where("depth > 1")
    return tables.expected_outputs(spark, deep).select("hazard_type", "return_period", "done")


@query(f"WITH {_BATH} SELECT hazard_type, return_period, count(*) FILTER (d > 0) AS wet_pixels FROM bath GROUP BY ALL")
def summary_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "summary")
    tables.write_summary(zonal.depth_summary(_bath(spark, sf), "hazard_type", "return_period"), path)
    return tables.read_csv(spark, path, "hazard_type string, return_period int, wet_pixels long", "hazard_type", "return_period", "wet_pixels")


@query(f"WITH {SQL_CELLS} SELECT r, c, round(z, 5) AS z FROM cells WHERE abs(r - 3) <= 2 AND abs(c - 11) <= 2")
def cell_sink_window(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "cells")
    tables.write_cells(views.cells(spark, sf).select("row", "col", F.coalesce("z", F.lit(-9999.0)).alias("z")), path, "z", "double")
    return tables.decode_window(tables.read_window(spark, path, 3, 11, 2), "z", -9999.0).select(*place(), F.round("z", 5).alias("z"))


@query(f"WITH {SQL_CELLS} SELECT r, c, round(z, 5) AS z FROM cells WHERE z IS NOT NULL")
def raster_tiles(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "tiles")
    tables.write_tiles(views.cells(spark, sf), path, "z", 16)
    return tables.read_tiles(spark, path, "z", 16).select(*place(), F.round("z", 5).alias("z"))


@query("SELECT event_type AS series_id, CAST(value AS DOUBLE) AS value, ts FROM events WHERE event_type = 'purchase' AND value > 50")
def packed_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "packed")
    views.table(spark, sf, "events").select("event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")).write.option("header", True).option("compression", "gzip").csv(path)
    rows = tables.packed_csv(spark, path, "event_type string, value double, ts string", F.col("event_type") == "purchase", F.col("value") > 50)
    return rows.select(F.col("event_type").alias("series_id"), "value", F.col("ts").cast("timestamp").alias("ts"))


# relational steps


@query(f"WITH {SQL_CELLS} (SELECT r, c, 'both' AS side FROM cells WHERE channel INTERSECT SELECT r, c, 'both' FROM cells WHERE z <= 0.5) UNION ALL (SELECT r, c, 'channel only' FROM cells WHERE channel EXCEPT SELECT r, c, 'channel only' FROM cells WHERE z <= 0.5)")
def channel_sets(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf)
    a, b = g.where("channel").select(*place()), g.where("z <= 0.5").select(*place())
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.exceptAll(b).distinct().withColumn("side", F.lit("channel only")))


@query(f"WITH {SQL_SERIES}, d AS (SELECT *, (SELECT min(ts) FROM series) AS t0 FROM series) SELECT series_id, ts, round(value, 4) AS value FROM d WHERE ts >= t0 + INTERVAL 24 HOUR AND ts < t0 + INTERVAL 96 HOUR")
def event_window(spark: SparkSession, sf: str) -> DataFrame:
    s = views.series(spark, sf)
    first = s.agg(F.min("ts")).first()[0]
    return S.time_slice(s, F.lit(first) + F.expr("INTERVAL 24 HOUR"), F.lit(first) + F.expr("INTERVAL 96 HOUR")).select("series_id", "ts", F.round("value", 4).alias("value"))


@query(f"WITH {_BATH} SELECT hazard_type, return_period, r, c, round(d, 6) AS depth, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY hazard_type, return_period ORDER BY d DESC, r, c) AS n FROM bath WHERE d IS NOT NULL) WHERE n <= 5")
def deepest_cells(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.deepest(_bath(spark, sf), 5, "hazard_type", "return_period").select("hazard_type", "return_period", *place(), r6("depth").alias("depth"), "rank")


@query("SELECT event_type AS series_id, user_id, arg_min(value, struct_pack(t := ts, e := event_id)) AS value FROM events GROUP BY 1, 2")
def first_of_each(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "user_id", "value", "ts", "event_id")
    return S.first_of_duplicates(e, ["series_id", "user_id"], F.struct("ts", "event_id")).select("series_id", "user_id", "value")


# grids


@query(f"WITH {SQL_CELLS} SELECT CAST(floor((200.5 - r * 0.75) / 3) * -1 AS INTEGER) AS r, CAST(floor((100 + c * 0.75 - 90) / 2.5) AS INTEGER) AS c, count(*) AS n FROM cells GROUP BY ALL")
def world_to_pixel(spark: SparkSession, sf: str) -> DataFrame:
    row, column = geo.pixel(100 + F.col("col") * 0.75, 200.5 - F.col("row") * 0.75, 2.5, 90.0, 3.0, 0.0)
    return views.cells(spark, sf).select((-row).alias("r"), column.alias("c")).groupBy("r", "c").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_CELLS}, t AS (SELECT CAST(floor((r - 12) / 3.0) * 3 AS INTEGER) AS s, CAST(floor((c * 9 - 180) / 3.0) * 3 AS INTEGER) AS w FROM cells) SELECT printf('%s%02d%s%03d', CASE WHEN s < 0 THEN 'S' ELSE 'N' END, abs(s), CASE WHEN w < 0 THEN 'W' ELSE 'E' END, abs(w)) AS tile, count(*) AS n FROM t GROUP BY 1")
def tile_names(spark: SparkSession, sf: str) -> DataFrame:
    return views.cells(spark, sf).select(geo.tile_name((F.col("row") - 12).cast("double"), (F.col("col") * 9 - 180).cast("double")).alias("tile")).groupBy("tile").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_CELLS}, l AS (SELECT r, c, channel AS land FROM cells), e AS (SELECT DISTINCT a.r, a.c FROM l a JOIN l b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.land AND NOT b.land), w AS (SELECT r, c FROM e UNION SELECT l.r, l.c FROM l JOIN e ON abs(l.r - e.r) + abs(l.c - e.c) = 1) SELECT l.r, l.c, w.r IS NOT NULL AS edge FROM l LEFT JOIN w USING (r, c)")
def coastline(spark: SparkSession, sf: str) -> DataFrame:
    return grid.land_edge(views.cells(spark, sf), "channel").select(*place(), "edge")


@query(f"WITH {SQL_CELLS}, x AS (SELECT r, c, CASE WHEN z IS NOT NULL THEN greatest(1.0 - z, 0) END AS a, CASE WHEN c >= 10 AND hand IS NOT NULL THEN greatest(1.2 - hand, 0) END AS b FROM cells) SELECT r, c, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END, 6) AS depth FROM x")
def domain_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf)
    east = g.where("col >= 10").select((F.col("row") + 5).alias("row"), (F.col("col") - 10).alias("col"), D.hand_depth("hand", 1.2).alias("depth"))
    return zonal.mosaic([g.withColumn("depth", D.bathtub("z", 1.0)), grid.shifted(east, -5, 10)]).select(*place(), r6("depth").alias("depth"))


@query(f"WITH {SQL_CELLS}, p AS (SELECT r, c, o, e, size + o * 3 - CASE WHEN e THEN size % 6 * 2 ELSE 0 END AS v FROM cells, (VALUES (0), (1)) t(o), (VALUES (FALSE), (TRUE)) u(e)), m AS (SELECT r, c, o, median(v) FILTER (e) - median(v) FILTER (NOT e) AS d FROM p GROUP BY r, c, o) SELECT r, c, bool_or(d < -6) AS flood FROM m GROUP BY r, c")
def sar_change(spark: SparkSession, sf: str) -> DataFrame:
    both = views.cells(spark, sf).withColumn("orbit", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("event", F.explode(F.array(F.lit(False), F.lit(True))))
    scenes = both.withColumn("backscatter", F.col("size") + F.col("orbit") * 3 - F.when(F.col("event"), F.col("size") % 6 * 2).otherwise(0))
    return zonal.median_change(scenes, -6.0).select(*place(), "flood")


@query(f"WITH {SQL_CELLS}, p AS (SELECT r, c, CASE WHEN (size + o) % 4 = 3 THEN 255 ELSE (size + o) % 4 END AS code FROM cells, (VALUES (0), (1)) t(o)), m AS (SELECT r, c, max(code) FILTER (code <> 255) AS k FROM p GROUP BY 1, 2) SELECT r, c, CASE WHEN k IS NOT NULL THEN k IN (1, 2) END AS flood FROM m")
def pass_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    passes = views.cells(spark, sf).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("code", F.when((F.col("size") + F.col("o")) % 4 == 3, 255).otherwise((F.col("size") + F.col("o")) % 4))
    return zonal.flood_mosaic(passes).select(*place(), "flood")


@query(f"WITH {SQL_CELLS} SELECT r, c, CASE WHEN 1.0 + r * 0.01 > 1.02 THEN FALSE ELSE coalesce(z <= 0.5, FALSE) END AS sea, round(CASE WHEN z IS NOT NULL THEN CASE WHEN 1.0 + r * 0.01 <= 1.02 AND z <= 0.5 THEN 0 ELSE greatest(1.0 - z, 0) END END, 6) AS depth FROM cells")
def sea_masking(spark: SparkSession, sf: str) -> DataFrame:
    g = views.cells(spark, sf).withColumn("lat", 1.0 + F.col("row") * 0.01).withColumn("sea", F.coalesce(F.col("z") <= 0.5, F.lit(False)))
    return zonal.sea_restricted(g, 1.02).select(*place(), "sea", r6(D.zeroed(D.bathtub("z", 1.0), F.col("sea"))).alias("depth"))


@query(f"WITH {_BATH}, a AS (SELECT hazard_type, return_period, count(*) FILTER (d > 0.3) * 900.0 / 1e6 AS m, count(*) FILTER (d > 0.8) * 900.0 / 1e6 AS o FROM bath GROUP BY ALL) SELECT hazard_type, return_period, round(m, 6) AS area_km2, round(m / nullif(o, 0), 6) AS bias FROM a")
def area_bias(spark: SparkSession, sf: str) -> DataFrame:
    by = ("hazard_type", "return_period")
    over = zonal.area_over(_bath(spark, sf), 0.3, *by).join(zonal.area_over(_bath(spark, sf), 0.8, *by).withColumnRenamed("area_km2", "seen"), list(by))
    area = geo.pixel_area(30.0, -30.0, F.lit(32748)) / 900.0
    return over.select(*by, r6(F.col("area_km2") * area).alias("area_km2"), r6(zonal.bias_factor(F.col("area_km2"), F.col("seen"))).alias("bias"))


@query(f"WITH {SQL_CELLS} SELECT r, c FROM cells WHERE abs(r + 0.5 - 1.5) <= 1.5 AND c + 0.5 BETWEEN 5.5 AND 20.5 OR (c + 0.5 - greatest(least(c + 0.5, 20.5), 5.5)) ** 2 + (r + 0.5 - 1.5) ** 2 <= 2.25")
def line_buffer(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.createDataFrame([(5.5, 1.5, 12.0, 1.5), (12.0, 1.5, 20.5, 1.5)], "x1 double, y1 double, x2 double, y2 double")
    return grid.buffered(views.cells(spark, sf), lines, 1.5).select(*place())


# diagnostics


@query(f"WITH {_BATH}, t AS (SELECT unnest([0.05, 0.1, 0.3, 0.5])::DOUBLE AS threshold) SELECT hazard_type, return_period, threshold, count(*) FILTER (d > threshold) AS cells, round(count(*) FILTER (d > threshold) / nullif(count(*) FILTER (d > 0), 0), 6) AS share FROM bath, t GROUP BY ALL")
def depth_threshold_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.threshold_sensitivity(_bath(spark, sf), (0.05, 0.1, 0.3, 0.5), "hazard_type", "return_period")
    return out.select("hazard_type", "return_period", "threshold", "cells", r6("share").alias("share"))


@query(
    f"WITH {SQL_CELLS}, t AS (SELECT unnest([0.5, 1.0, 2.0, 3.0])::DOUBLE AS stage), k AS (SELECT stage, count(*) FILTER (coalesce(hand < stage, FALSE) AND channel) AS tp, count(*) FILTER (coalesce(hand < stage, FALSE) AND NOT channel) AS fp, count(*) FILTER (NOT coalesce(hand < stage, FALSE) AND channel) AS fn FROM cells, t GROUP BY 1) "
    "SELECT stage, round((tp + fp) * 900.0 / 1e6, 6) AS extent_km2, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS hit_rate, round(CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 1 END, 6) AS far FROM k"
)
def hand_extent_tradeoff(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.extent_tradeoff(views.cells(spark, sf), (0.5, 1.0, 2.0, 3.0), "channel")
    return out.select("stage", *[r6(c).alias(c) for c in ("extent_km2", "hit_rate", "far")])


@query(_PATH + f", a AS (SELECT tr AS r, tc AS c, count(DISTINCT (r, c)) AS n FROM p GROUP BY tr, tc), q AS (SELECT s_suppkey AS label, CAST(s_suppkey % 5 AS INTEGER) AS r, CAST((s_suppkey * 13) % {views.WIDTH} AS INTEGER) AS c FROM supplier) SELECT label, round(coalesce(max(n), 0) * 900.0 / 1e6, 6) AS area_km2 FROM q LEFT JOIN a ON abs(a.r - q.r) <= 1 AND abs(a.c - q.c) <= 1 GROUP BY label")
def catchment_area_at_points(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.area_at_points(views.points(spark, sf).select("label", "row", "col"), graph.d8(smooth(spark, sf)), 1)
    return out.select("label", r6("area_km2").alias("area_km2"))


@query(
    f"WITH {SQL_CELLS}, {SQL_POINTS}, w AS (SELECT p.label, g.r, g.c, z, 0.9 - z AS d, sqrt((g.r - p.r) ** 2 + (g.c - p.c) ** 2) * 30 AS dist FROM points p JOIN cells g ON abs(g.r - p.r) <= 2 AND abs(g.c - p.c) <= 2 WHERE 0.9 - z > 0.1), "
    "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, r, c) AS n FROM w WHERE dist <= 50) WHERE n = 1), m AS (SELECT p.label, median(z) AS m FROM points p JOIN cells g ON abs(g.r - p.r) <= 11 AND abs(g.c - p.c) <= 11 GROUP BY 1), "
    "x AS (SELECT b.label, d, dist, g.z - b.z AS dr, m - b.z AS pit FROM b JOIN m USING (label) JOIN points p USING (label) LEFT JOIN cells g ON g.r = p.r AND g.c = p.c) "
    "SELECT label, round(d, 6) AS depth, round(dist, 4) AS distance, round(dr, 6) AS drop_m, round(pit, 6) AS pit, CASE WHEN dist > 30 AND dr > 5 THEN 'radius' WHEN pit > d AND dist <= 30 THEN 'pit' ELSE 'depression' END AS verdict FROM x"
)
def over_ponding(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.over_ponding(views.points(spark, sf), views.cells(spark, sf).withColumn("depth", D.bathtub("z", 0.9)))
    return out.select("label", r6("depth").alias("depth"), F.round("distance", 4).alias("distance"), r6("drop").alias("drop_m"), r6("pit").alias("pit"), "verdict")


@query()
def riverine_inundation(spark: SparkSession, sf: str) -> DataFrame:
    out = hazard.riverine_run(views.cells(spark, sf), F.col("channel"), 0.4, lowest=-0.7, total_s=900.0, dt_max=10.0)
    return out.select(*place(), F.round("depth", 5).alias("depth"))


@query(f"WITH {_HITS}, k AS (SELECT label, cls, score, row_number() OVER (ORDER BY label) AS n FROM s WHERE cls = 'flood' OR score < 1.0) SELECT label, cls, round(score, 6) AS score, CASE WHEN cls = 'flood' THEN 'documented' ELSE 'control' END AS origin FROM k")
def point_register(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return scoring.register(s.where("cls = 'flood'"), s.where("cls = 'dry'"), F.col("score") < 1.0).select("label", "cls", r6("score").alias("score"), "origin")


SQL_FUNCTIONS_SQL = f"WITH {SQL_CELLS} SELECT r, c, round(CASE WHEN z IS NOT NULL THEN greatest(1.25 - z, 0) END, 6) AS depth, round(CASE WHEN hand IS NOT NULL THEN greatest(1.0 - hand, 0) END, 6) AS over_drainage FROM cells"


@query(SQL_FUNCTIONS_SQL)
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.sql import register

    register(spark)
    views.cells(spark, sf).createOrReplaceTempView("tidemark_cells")
    return spark.sql("SELECT row AS r, col AS c, round(bathtub_depth(z, 1.25), 6) AS depth, round(hand_stage(hand, 1.0), 6) AS over_drainage FROM tidemark_cells")
