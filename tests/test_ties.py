"""Results that ties decide do not follow from the order of sums."""

from pyspark.sql import functions as F

from tidemark.operators import hypsometry, zonal


def test_indices_that_differ_by_the_order_of_a_sum_tie(spark):
    # 0.1 + 0.2 + 0.3 from either end: 0.6000000000000001 and 0.6
    values = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, (0.1 + 0.2) + 0.3, 0.1 + (0.2 + 0.3), 0.6, 0.9]
    cells = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "row int, col int, tpi double")
    got = zonal.quantile_flag(cells, "tpi", 0.3, 0.5)
    assert [r.col for r in got.where(F.col("depth") > 0).orderBy("col").collect()] == [6, 7, 8, 9]


def test_beds_of_one_height_are_added_cell_by_cell(spark):
    # cell by cell -3.1000000000000005, by heights -3.1
    beds = spark.createDataFrame([(7, -0.9), (7, -0.8), (7, -0.7), (7, -0.7)], "dep long, z double")
    top = hypsometry.curves(beds, 900.0).orderBy("z").collect()[-1]
    assert (top.n, top.total) == (4, -0.9 - 0.8 - 0.7 - 0.7)
    dealt = hypsometry.curves(beds, 900.0, range_rows=1).orderBy("z").collect()
    assert [(r.z, r.n) for r in dealt] == [(-0.9, 1), (-0.8, 2), (-0.7, 4)] and abs(dealt[-1].total + 3.1) < 1e-9
