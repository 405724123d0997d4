"""What each step of routing and distances reads stays in proportion to the cells."""

import math

from pyspark.sql import functions as F

from tidemark.operators import graph, grid, terrain
from tidemark.plans import views


def test_outlet_distance_looks_ahead_by_a_window_that_is_kept(spark, capsys):
    cells = spark.range(600).select((F.col("id") % 300).cast("int").alias("row"), F.floor(F.col("id") / 300).cast("int").alias("col"))
    out = graph.outlet_distance(cells, (F.col("col") == 0) & F.col("row").isin(40, 200))
    capsys.readouterr()
    out.explain()
    # Spark sums a frame that is open ahead anew for every row
    assert "unboundedfollowing" not in capsys.readouterr().out
    want = {(r, c): min(math.hypot(r - o, c) for o in (40, 200)) for r in range(300) for c in (0, 1)}
    assert {(x.row, x.col): round(x.distance, 9) for x in out.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert all(x.distance is None for x in graph.outlet_distance(cells, F.lit(False)).collect())


def test_heights_and_directions_are_computed_once(spark, sf_dir, capsys, monkeypatch):
    def plan(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    cells = views.cells(spark, sf_dir)
    mean = grid.focal(cells, "z", 1, F.avg("v"), "z", F.col("z").isNotNull())
    assert "avg(" not in plan(graph.d8(mean))
    assert "max_by(" not in plan(graph.flow_edges(graph.d8(mean)))
    monkeypatch.setattr(terrain, "depitted", lambda cells, z, **depit: cells)
    assert "median(" not in plan(terrain.burned_median_depitted(cells, F.col("channel"), F.lit(True)))


def test_pointers_that_have_run_out_do_not_meet_in_one_task(spark, capsys, monkeypatch):
    steps = {}
    for name, call in (("to", graph.accumulation), ("terminal", graph.terminals)):
        monkeypatch.setattr(graph, "_rounds", lambda step, state, done: steps.setdefault(name, step) and state)
        call(spark.createDataFrame([(1, 2), (2, 2)], "cell long, next long"))
        monkeypatch.undo()
        state = spark.createDataFrame([(1, 2, False), (2, 2, False)], f"cell long, {name} long, moved boolean").withColumn("amount", F.lit(1.0)).hint("merge")
        capsys.readouterr()
        steps[name](state).explain()
        assert f"Join [{name}#" not in capsys.readouterr().out
    chain = spark.createDataFrame([(i, min(i + 1, 40)) for i in range(41)], "cell long, next long")
    assert {r.cell: r.amount for r in graph.accumulation(chain).collect()} == {i: i + 1.0 for i in range(41)}
    assert {r.terminal for r in graph.terminals(chain).collect()} == {40}
