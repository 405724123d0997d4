"""Grids from nested lists and back."""


def grid_of(spark, rows):
    """A cell table from nested lists; None is no data."""
    cells = [(r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "row int, col int, z double")


def array_of(df, value, default=None):
    """Nested lists from a cell table."""
    found = {(x["row"], x["col"]): x[value] for x in df.collect()}
    h, w = max(r for r, _ in found) + 1, max(c for _, c in found) + 1
    return [[found.get((r, c), default) for c in range(w)] for r in range(h)]
