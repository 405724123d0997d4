"""The city's run reuses what stands; SQL functions give what the expressions give."""

import pytest
from grids import grid_of
from pyspark.sql import functions as F

from tidemark.functions import depth as D
from tidemark.functions import hydrology as H
from tidemark.functions import sql
from tidemark.operators import graph
from tidemark.plans import city, forcing, views


def sources(spark, lift=0.0):
    z = [[5.0 - abs(c - 4) * 0.4 + (r % 3) * 0.1 + lift for c in range(9)] for r in range(8)]
    cells = grid_of(spark, z).withColumns({"channel": F.col("col") == 4, "sink_cm_a": F.lit(2.0)})
    register = spark.createDataFrame([(1, 1, 1, "flood"), (2, 5, 7, "dry"), (3, 0, 4, "flood")], "label int, row int, col int, cls string")
    scenarios = forcing.warming(spark).withColumn("coastal_delta_m", F.lit(0.2))
    return {
        "terrain": city.Source(cells, f"terrain {lift}"), "baseline": city.Source(views.levels(spark), "levels"), "scenarios": city.Source(scenarios, "scenarios"), "register": city.Source(register, "points"),
    }


def test_only_what_follows_is_computed_again(spark, tmp_path):
    scenario, horizon = next(iter(forcing.WARMING))
    options = {"scenario": scenario, "horizon": horizon, "scored_period": 100, "drain_cells": 5, "burn": 1.0, "rate": 0.07, "threshold": 0.1, "years": 10}
    store = str(tmp_path)
    tables, computed = city.run(spark, store, sources(spark), options)
    assert computed == [s.name for s in city.CITY]
    assert tables["ground"].agg(F.min("z")).first()[0] == pytest.approx(5.0 - 1.6 - 0.2)
    assert tables["summary"].count() == 27 and tables["scores"].first().n_pos == 2
    again, computed = city.run(spark, store, sources(spark), options)
    assert computed == [] and again["summary"].exceptAll(tables["summary"]).isEmpty()
    assert city.run(spark, store, sources(spark), options | {"threshold": 0.5})[1] == ["scores"]
    assert city.run(spark, store, sources(spark), options | {"rate": 0.1})[1] == ["levels", "depths", "summary", "areas", "scores"]
    assert city.run(spark, store, sources(spark, 0.1), options)[1] == ["ground", "routing", "sea", "depths", "summary", "areas", "scores"]
    assert city.run(spark, store, sources(spark), options | {"unread": 1})[1] == []
    # a stage that was lost half-way has no mark
    key = next(p for p in tmp_path.iterdir() if p.name.startswith("sea-"))
    (key / "_SUCCESS").unlink()
    assert city.run(spark, store, sources(spark), options)[1] in ([], ["sea"])
    with pytest.raises(ValueError, match="needs"):
        city.run(spark, store, {}, options)


def test_functions_have_one_source(spark):
    names = sql.register(spark)
    assert sql.register(spark) == names
    spark.createDataFrame([(1.0, 2.5, 3.0), (None, 1.0, 2.0), (3.0, 0.5, 50.0)], "a double, b double, c double").createOrReplaceTempView("abc")
    got = spark.sql("SELECT bathtub_depth(a, b) v1, hand_stage(a, b) v2, depth_severity(a) v3, gumbel_level(a, b, c) v4, curve_number_runoff(c, 85) v5, manning_depth(a, 10, 0.03, 0.001) v6, warming_factor(a, 0.6) v7, gev_level(0.1, a, b, c) v8 FROM abc").collect()
    t = spark.table("abc")
    want = t.select(D.bathtub("a", "b"), D.hand_depth("a", "b"), D.severity("a"), H.gev_quantile(0.0, "a", "b", "c"), H.scs_runoff("c", 85), H.manning_stage("a", 10, 0.03, 0.001), H.climate_factor("a", 0.6), H.gev_quantile(0.1, "a", "b", "c")).collect()
    assert [tuple(pytest.approx(x) if x is not None else None for x in r) for r in want] == [tuple(r) for r in got]


def test_aggregate_and_table_functions(spark):
    sql.register(spark)
    x = [10.0, 12.5, 11.0, 15.0, 9.5, 18.0, 13.0]
    spark.createDataFrame([("a", v) for v in x] + [("b", 1.0)], "s string, v double").createOrReplaceTempView("maxima")
    got = {r.s: r.p for r in spark.sql("SELECT s, gev_parameters(v) AS p FROM maxima GROUP BY s").collect()}
    from tidemark.operators.series import fit_values

    import numpy as np

    assert got["a"] == pytest.approx(list(fit_values(np.array(x)))) and got["b"] is None
    cells = grid_of(spark, [[1 if (r * 3 + c) % 4 else 0 for c in range(12)] for r in range(7)]).withColumn("active", F.col("z") > 0)
    cells.createOrReplaceTempView("wet")
    labels = spark.sql("SELECT * FROM tile_labels(TABLE(SELECT row, col, active, 0 AS tile FROM wet) PARTITION BY tile)")
    want = graph.label_components(cells, F.col("active"))
    assert labels.count() == want.count() and labels.select("label_row", "label_col").distinct().count() == want.select("label").distinct().count()
