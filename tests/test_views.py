"""Cells are dealt out to tasks."""

from pyspark.sql import functions as F

from tidemark.plans import views


def test_a_task_reads_a_share_of_the_cells(spark, sf_dir, monkeypatch):
    whole = views.cells(spark, sf_dir)
    monkeypatch.setattr(views, "CELLS_A_TASK", 50)
    monkeypatch.setattr(views, "ROWS_TOGETHER", 1)
    dealt = views.cells(spark, sf_dir)
    assert dealt.rdd.getNumPartitions() == whole.count() // 50 + 1 and dealt.exceptAll(whole).isEmpty()
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1
