import pytest
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.plans import checks, forcing
from tidemark.sources import tables
from tidemark.streaming.maxima import running_maxima


def test_hotspot_rules(spark):
    schema = "label string, lon double, lat double, class string, source string"
    good = spark.createDataFrame([("a", 103.8, 1.3, "flood", "x")], schema)
    assert tables.checked_hotspots(good).count() == 1
    bad = spark.createDataFrame([("a", 203.8, 1.3, "wet", " "), ("b", None, 95.0, "dry", "s")], schema)
    assert tables.hotspot_problems(bad).count() == 5
    with pytest.raises(ValueError):
        tables.checked_hotspots(bad)


def test_payload_keeps_the_first_of_equal_times(spark):
    text = '{"hourly": {"time": ["2020-01-01T00:00", "2020-01-01T00:00", "2020-01-01T01:00"], "precipitation": [1.5, 9.0, -1.0]}}'
    got = tables.hourly_payload(spark.createDataFrame([(text,)], "payload string")).orderBy("ts").collect()
    assert [r.value for r in got] == [1.5, None]


def test_upsert_and_progress(spark):
    old = spark.createDataFrame([("coastal", 2, 1.0), ("pluvial", 2, 0.1)], "hazard_type string, return_period int, level double")
    new = spark.createDataFrame([("pluvial", 2, "n")], "hazard_type string, return_period int, note string")
    out = {r.hazard_type: (r.level, r.note) for r in tables.replace_slice(old, new, "pluvial").collect()}
    assert out == {"coastal": (1.0, None), "pluvial": (None, "n")}
    assert tables.expected_outputs(spark, old).where("done").count() == 2


def test_datum_patch_runs_once(spark):
    base = spark.createDataFrame([("coastal", 2, 1.0, "src", "EGM2008; MSL+0.500 m"), ("fluvial", 2, 3.0, "src", None)], "hazard_type string, return_period int, baseline_water_level_m double, source_note string, datum_note string")
    once = forcing.patched_datum(base, 0.8, "[tag]")
    twice = forcing.patched_datum(once, 0.8, "[tag]")
    level = lambda df: {r.hazard_type: r.baseline_water_level_m for r in df.collect()}
    assert level(once) == level(twice) == {"coastal": 1.3, "fluvial": 3.0}


def test_auc_ties_and_empty_sides(spark):
    def auc(pos, neg):
        rows = [("flood", float(x)) for x in pos] + [("dry", float(x)) for x in neg]
        return scoring.roc_auc(spark.createDataFrame(rows, "cls string, score double")).first().auc

    assert auc([3, 2, 4], [0, 1]) == 1 and auc([1, 1], [1]) == 0.5 and auc([2, 1], [1, 0]) == 0.875 and auc([1], []) == 0.5


def test_bootstrap_is_reproducible_and_degenerate_sides_are_points(spark):
    rows = [(str(i), "flood" if i % 3 else "dry", i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "label string, cls string, hit boolean")
    a, b = (scoring.bootstrap(df.repartition(n), n_boot=200).first() for n in (1, 5))
    assert a == b and a.low <= a.estimate <= a.high
    one = scoring.bootstrap(df.where("cls = 'flood'"), n_boot=10).first()
    assert one.low == one.high == one.estimate


def test_empty_observation_gives_far_and_null_bias(spark):
    df = spark.createDataFrame([(True, False), (False, False)], "modelled boolean, observed boolean")
    row = scoring.contingency(df).first()
    assert row.far == 1 and row.bias is None and row.csi == 0


def test_bracket_outside(spark):
    periods = forcing.return_periods(spark)
    got = checks.bracket(periods, spark.createDataFrame([(1.0,), (30.0,), (5000.0,)], "rp double")).orderBy("rp").collect()
    assert [(r.lower, r.upper) for r in got] == [(None, 2), (25, 50), (1000, None)]


def test_stream_of_maxima(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = running_maxima(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("maxima").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("maxima").collect()} == {tuple(r) for r in events.groupBy("event_type").agg(F.max("value")).collect()}


def test_a_cache_is_built_once_and_again_when_lost_half_way(spark, tmp_path):
    path, built = str(tmp_path / "c"), []
    build = lambda: built.append(1) or spark.range(len(built))
    assert [tables.cached_table(spark, path, build).count() for _ in range(3)] == [1, 1, 1]
    (tmp_path / "c" / "_SUCCESS").unlink()
    assert tables.cached_table(spark, path, build).count() == 2 and len(built) == 2
