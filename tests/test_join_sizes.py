"""Tables that grow with the cells are never sent whole to every executor, however small their files are."""

import pytest

from tidemark.operators import graph, grid, scoring, terrain
from tidemark.plans import diagnostics, forcing, views
from tidemark.sources import storage


@pytest.fixture
def plan(capsys):
    def of(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    return of


def test_cells_sent_to_their_neighbours_meet_by_merging(spark, sf_dir, plan):
    cells = views.cells(spark, sf_dir).select("row", "col", "z")
    sent = grid.reached(cells.withColumnRenamed("z", "v"), grid.OFFSETS, graph.F.col("v"))
    assert "Broadcast" not in plan(sent.join(cells, ["row", "col"]))
    assert "Broadcast" not in plan(terrain.slope(cells, 30.0))
    labels = graph.label_components(cells, graph.F.col("z") > 0)
    assert "Broadcast" not in plan(graph.cut_cells(labels).join(cells, ["row", "col"]))


def test_points_that_ask_for_their_windows_meet_by_merging(spark, sf_dir, plan):
    points, cells = views.points(spark, sf_dir), views.cells(spark, sf_dir).withColumn("depth", graph.F.col("z"))
    assert "Broadcast" not in plan(scoring.windows(points.select("label", "row", "col"), cells, 2))
    # what the joins give is told by their inputs' sizes, and may be sent
    assert plan(diagnostics.over_ponding(points, cells)).count("SortMergeJoin") >= 2
    field = cells.select((graph.F.col("row") * 0.25).alias("lat"), (graph.F.col("col") * 0.25).alias("lon"), graph.F.col("z").alias("mdt"))
    at = points.select("label", (graph.F.col("row") * 0.25).alias("lat"), (graph.F.col("col") * 0.25).alias("lon"))
    assert "SortMergeJoin" in plan(forcing.grid_value(field, at, 0.25))


def test_a_rounds_table_of_many_rows_meets_by_merging(spark, plan):
    many = storage.cut_round(spark.range(150_000).selectExpr("id as cell", "id div 3 as terminal"))
    ahead = many.select(many.cell.alias("terminal"), many.terminal.alias("after"))
    # packed it is far smaller than a copy for every executor
    assert "Broadcast" not in plan(many.join(ahead, "terminal"))
    few = storage.cut_round(spark.range(1_000).selectExpr("id as cell", "id div 3 as terminal"))
    assert "Broadcast" in plan(few.join(few.select(few.cell.alias("terminal"), few.terminal.alias("after")), "terminal"))


def test_filled_and_marked_cells_alone_are_not_sent(spark, sf_dir, plan):
    cells = views.cells(spark, sf_dir).select("row", "col", "z")
    assert "Broadcast" not in plan(terrain.filled_surface(cells).where("filled is not null"))
    wide = cells.where("z > 0").select("row", "col").crossJoin(spark.range(9)).crossJoin(spark.range(9)).select("row", "col")
    assert "SortMergeJoin" in plan(graph.marked(cells, wide, "found").where("found"))
