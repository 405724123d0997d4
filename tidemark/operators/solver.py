"""Explicit shallow-water runs, one independent run per task.

A run (a scenario and return period on one grid) goes to one task, which steps
the local-inertial equations over dense arrays, so a table of runs keeps as many
tasks busy as it has runs.  Rows reach it sorted, batch by batch, and are put
straight into the arrays: a task holds the arrays of one run, about 70 bytes a
cell, and never its rows.  Steps are taken by bands of rows, which changes no
bit.  Runs of different return periods are independent and give the same bits in
any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gravity, least depth at an interface, Courant factor, depth of the drying floor.
G, THIN, COURANT = 9.806, 1e-3, 0.7
#: Steps after which a run that has not reached its end is an error.
RAIN_STEPS, INERTIAL_STEPS = 200_000, 100_000
#: Cells of a band of rows, over which a step's passing arrays are made.
BAND = 65_536


def _within(steps: int, most: int, t: float, total_s: float) -> None:
    if steps >= most:
        raise RuntimeError(f"{most} steps reach {t:.0f} of {total_s:.0f} seconds only")


def _sides(axis: int) -> tuple[tuple[slice, ...], tuple[slice, ...]]:
    """Index of the cells before and after each inner face of an axis."""
    a, b, full = slice(None, -1), slice(1, None), slice(None)
    return ((full, a), (full, b)) if axis == 1 else ((a, full), (b, full))


def face_depth(z: np.ndarray, d: np.ndarray, axis: int) -> np.ndarray:
    """Depth of flow at each face: the higher water level over the higher ground."""
    left, right = _sides(axis)
    eta = z + d
    return np.maximum(eta[left], eta[right]) - np.maximum(z[left], z[right])


def face_flux(q: np.ndarray, z: np.ndarray, d: np.ndarray, n: np.ndarray, dt: float, dx: float, axis: int) -> np.ndarray:
    """New unit discharges across the inner faces of one axis, from the old depths."""
    left, right = _sides(axis)
    h = face_depth(z, d, axis)
    open_ = h > THIN  # false for NaN too
    h = np.where(open_, h, 1.0)
    eta = z + d
    rough = 0.5 * (n[left] + n[right])
    new = (q - G * h * (eta[right] - eta[left]) / dx * dt) / (1 + G * rough**2 * np.abs(q) * dt / h ** (7 / 3))
    return np.where(open_, new, 0.0)


def bands(rows: int, width: int) -> Iterator[tuple[int, int]]:
    """(first, end) of bands of rows of about BAND cells."""
    size = max(1, BAND // max(1, width))
    for a in range(0, rows, size):
        yield a, min(a + size, rows)


def advance(qx: np.ndarray, qy: np.ndarray, z: np.ndarray, d: np.ndarray, n: np.ndarray, dt: float, dx: float) -> None:
    """New unit discharges in place."""
    for a, b in bands(*z.shape):
        qx[a:b] = face_flux(qx[a:b], z[a:b], d[a:b], n[a:b], dt, dx, 1)
    for a, b in bands(*qy.shape):
        qy[a:b] = face_flux(qy[a:b], z[a : b + 1], d[a : b + 1], n[a : b + 1], dt, dx, 0)


def continued_rows(d: np.ndarray, qx: np.ndarray, qy: np.ndarray, dt: float, dx: float, a: int, b: int) -> np.ndarray:
    """Depths of the rows from a to b after one step; nothing crosses the edge of the grid."""
    x, y = np.pad(qx[a:b], ((0, 0), (1, 1))), np.pad(qy[max(a - 1, 0) : b], ((int(a == 0), int(b == len(d))), (0, 0)))
    return np.maximum(0.0, d[a:b] - dt / dx * (x[:, 1:] - x[:, :-1]) - dt / dx * (y[1:] - y[:-1]))


def time_step(z: np.ndarray, d: np.ndarray, qx: np.ndarray, qy: np.ndarray, dx: float, most: float) -> float:
    """Courant-limited step from face depths and cell velocities.

    Face depths, not cell depths, count: a deep boundary cell matters only as
    far as its water passes a face, and does so from the first step on.
    """
    faces = (face_depth(z[a : b + 1 - axis], d[a : b + 1 - axis], axis) for a, b in bands(*z.shape) for axis in (0, 1))
    deep = max((float(np.nanmax(h)) for h in faces if h.size and not np.isnan(h).all()), default=0.0)
    if deep <= THIN:
        return most
    fast = 0.0
    for a, b in bands(*z.shape):
        wet = d[a:b] > THIN
        safe = np.where(wet, d[a:b], 1.0)
        y = np.pad(qy[max(a - 1, 0) : b], ((int(a == 0), int(b == len(d))), (0, 0)))
        vx = 0.5 * (np.pad(qx[a:b], ((0, 0), (1, 0))) + np.pad(qx[a:b], ((0, 0), (0, 1)))) / safe
        vy = 0.5 * (y[:-1] + y[1:]) / safe
        fast = max(fast, float(np.max(np.where(wet, np.hypot(vx, vy), 0.0), initial=0.0)))
    return min(most, COURANT * dx / (np.sqrt(G * deep) + fast + 1e-10))


def rain_run(z: np.ndarray, outlet: np.ndarray, net: np.ndarray, n: np.ndarray, *, dx: float = 30.0, storm_s: float = 3600.0, total_s: float = 5400.0, dt_max: float = 30.0, open_border: bool = False, conveyance: float | None = None, perfect: np.ndarray | None = None, cap: float | None = None, clip_storm: bool = True) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Rain on a grid: (peak, final, seconds, steps).

    Rain falls at net / storm until the storm ends (a step is cut there unless
    ``clip_storm`` is false).  Outlets, and the border ring if open, drain at
    once, or at ``conveyance`` (m/s) except for ``perfect`` sinks.  The run is
    never stopped early.
    """
    known = np.isfinite(z)
    sink = outlet.copy()
    if open_border:
        sink[0], sink[-1], sink[:, 0], sink[:, -1] = True, True, True, True
    d, peak = np.zeros_like(z), np.zeros_like(z)
    qx, qy = np.zeros((z.shape[0], z.shape[1] - 1)), np.zeros((z.shape[0] - 1, z.shape[1]))
    rate, t, steps = np.where(known, net, 0.0) / storm_s, 0.0, 0
    while t < total_s:
        _within(steps, RAIN_STEPS, t, total_s)
        dt = min(time_step(z, d, qx, qy, dx, dt_max), total_s - t)
        if clip_storm and t < storm_s:
            dt = min(dt, storm_s - t)
        advance(qx, qy, z, d, n, dt, dx)
        for a, b in bands(*z.shape):
            new = continued_rows(d, qx, qy, dt, dx, a, b)
            if t < storm_s:
                new = new + rate[a:b] * dt
            drained = np.maximum(0.0, new - conveyance * dt) if conveyance is not None else 0.0
            new = np.where(sink[a:b], drained, new)
            if perfect is not None:
                new = np.where(perfect[a:b], 0.0, new)
            d[a:b] = np.where(known[a:b], new, 0.0)
            np.maximum(peak[a:b], d[a:b], out=peak[a:b])
        t, steps = t + dt, steps + 1
    if cap is not None:
        peak = np.minimum(peak, cap)
    return np.where(known, peak, np.nan), np.where(known, d, np.nan), t, steps


def inertial_run(z: np.ndarray, boundary: np.ndarray, level: float | np.ndarray | Callable[[float], float], *, n: float | np.ndarray = 0.06, dx: float = 30.0, total_s: float = 28_800.0, dt_max: float = 30.0, start: np.ndarray | None = None, tolerance: float = 1e-3, window: int = 100) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Water from boundary cells held at a level (number, array or function of time): (peak, final, seconds, steps).

    Stops at the end or when the mean change over ``window`` steps falls under
    the tolerance; INERTIAL_STEPS without either are an error.
    """
    known = np.isfinite(z)
    rough = np.broadcast_to(np.asarray(n, float), z.shape)

    def held(t: float) -> np.ndarray:
        at = level(t) if callable(level) else level
        return np.maximum(0.0, np.where(boundary, at - z, 0.0))

    d = np.where(known, np.zeros_like(z) if start is None else start, 0.0)
    d = np.where(boundary & known, held(0.0), d)
    peak, changes = d.copy(), []
    qx, qy = np.zeros((z.shape[0], z.shape[1] - 1)), np.zeros((z.shape[0] - 1, z.shape[1]))
    t, steps = 0.0, 0
    while t < total_s:
        _within(steps, INERTIAL_STEPS, t, total_s)
        dt = min(time_step(z, d, qx, qy, dx, dt_max), total_s - t)
        advance(qx, qy, z, d, rough, dt, dx)
        new = np.concatenate([continued_rows(d, qx, qy, dt, dx, a, b) for a, b in bands(*z.shape)])
        new = np.where(boundary, held(t), new)
        new = np.where(known, new, 0.0)
        changes = [*changes[-(window - 1) :], float(np.mean(np.abs(new - d)[known]))] if known.any() else [0.0]
        d, peak = new, np.maximum(peak, new)
        t, steps = t + dt, steps + 1
        if len(changes) >= window and np.mean(changes) < tolerance:
            break
    return np.where(known, peak, np.nan), np.where(known, d, np.nan), t, steps


def surge(peak: float, floor: float = 0.0, rise: float = 10_800.0, hold: float = 3_600.0, fall: float = 7_200.0) -> Callable[[float], float]:
    """The surge hydrograph as a function of seconds."""
    low = min(max(floor, 0.0), peak)
    return lambda t: float(np.interp(t, [0.0, rise, rise + hold, rise + hold + fall], [0.0, peak, peak, low]))


class _Run:
    """The cells of one run in dense arrays, filled batch by batch."""

    def __init__(self, key: tuple, first: dict, filled: dict[str, tuple[float, type]]) -> None:
        self.key, self.first = key, first
        self.r0, self.c0 = first["r0"], first["c0"]
        shape = (first["r1"] - self.r0 + 1, first["c1"] - self.c0 + 1)
        self.present = np.zeros(shape, bool)
        self.arrays = {name: np.full(shape, fill, kind) for name, (fill, kind) in filled.items()}

    def add(self, batch: pa.RecordBatch) -> None:
        row, column = batch["row"].to_numpy() - self.r0, batch["col"].to_numpy() - self.c0
        self.present[row, column] = True
        for name, array in self.arrays.items():
            array[row, column] = batch[name].to_numpy(zero_copy_only=False)

    def result(self, names: list[str], kinds: list[pa.DataType], made: tuple[np.ndarray, np.ndarray, float, int]) -> Iterator[pa.RecordBatch]:
        peak, final, seconds, steps = made
        for a, b in bands(*self.present.shape):
            row, column = np.nonzero(self.present[a:b])
            n = len(row)
            told = [pa.array([v] * n, kind) for v, kind in zip(self.key, kinds)]
            told += [pa.array((row + a + self.r0).astype(np.int32)), pa.array((column + self.c0).astype(np.int32))]
            told += [pa.array(x[a:b][row, column], from_pandas=True) for x in (peak, final)] + [pa.array(np.full(n, seconds)), pa.array(np.full(n, steps, np.int64))]
            yield pa.RecordBatch.from_arrays(told, names=[*names, "row", "col", "depth", "final_depth", "seconds", "steps"])


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], filled: dict[str, tuple[float, type]]) -> Iterator[_Run]:
    """The runs of sorted batches, one after another."""
    run = None
    for batch in batches:
        keys = [batch[c].to_pylist() for c in by]
        first = 0
        while first < batch.num_rows:
            key = tuple(k[first] for k in keys)
            end = next((i for i in range(first + 1, batch.num_rows) if any(k[i] != v for k, v in zip(keys, key))), batch.num_rows)
            part = batch.slice(first, end - first)
            if run is None or run.key != key:
                if run is not None:
                    yield run
                run = _Run(key, {c: part[c][0].as_py() for c in part.schema.names}, filled)
            run.add(part)
            first = end
    if run is not None:
        yield run


def _sorted_runs(cells: DataFrame, apart: str, by: list[str]) -> DataFrame:
    """Runs sorted in partitions, those of one ``apart`` together, with the box of each run's cells: r0, r1, c0, c1."""
    box = [f(c).cast("int").alias(n) for f, c, n in ((F.min, "row", "r0"), (F.max, "row", "r1"), (F.min, "col", "c0"), (F.max, "col", "c1"))]
    # a row a run
    boxes = F.broadcast(cells.groupBy(*by).agg(*box))
    same = [cells[c].eqNullSafe(boxes[c]) for c in by]
    return cells.join(boxes, same[0] if len(same) == 1 else same[0] & same[1]).drop(*[boxes[c] for c in by]).repartition(apart).sortWithinPartitions(*by, "row", "col")


def _number(x: str, other: float) -> Column:
    x = F.col(x).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(other)), F.lit(other))


def _schema(by: str, kind: str) -> str:
    return f"{by} {kind}, row int, col int, depth double, final_depth double, seconds double, steps long"


def rain_on_grid(cells: DataFrame, by: str = "return_period", **options) -> DataFrame:
    """Peak depths per run and cell.

    ``cells`` has ``by``, row, col, z, outlet (boolean), net_rain (m) and n,
    once per run; rows of one run form its grid.
    """
    kind = dict(cells.dtypes)[by]
    filled = {"z": (np.nan, float), "outlet": (False, bool), "net_rain": (0.0, float), "n": (0.05, float)}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        for run in _runs(_told(batches, [by], kinds), [by], filled):
            z, outlet, net, n = (run.arrays.pop(c) for c in ("z", "outlet", "net_rain", "n"))
            yield from run.result([by], kinds, rain_run(z, outlet, net, n, **options))

    own = cells.select(by, "row", "col", F.col("z").cast("double").alias("z"), F.coalesce(F.col("outlet"), F.lit(False)).alias("outlet"), _number("net_rain", 0.0).alias("net_rain"), _number("n", 0.05).alias("n"))
    return _sorted_runs(own, by, [by]).mapInArrow(solve, _schema(by, kind))


def _told(batches: Iterator[pa.RecordBatch], by: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """``batches``, the types of the run's columns put into ``kinds``."""
    for batch in batches:
        kinds[:] = [batch.schema.field(c).type for c in by]
        yield batch


def inertial(cells: DataFrame, by: str = "scenario", chained: str = "return_period", **options) -> DataFrame:
    """Peak depths from boundary cells, the return periods of one ``by`` in ascending order.

    Each starts from the peak of the one before, so they share a task, which
    takes them one by one.  ``cells`` has ``by``, ``chained``, row, col, z,
    boundary, level, floor and start (initial depth); levels may differ from
    cell to cell.  ``hydrograph=True`` turns levels, then one for the run, into
    surges.
    """
    kinds_of = dict(cells.dtypes)
    filled = {"z": (np.nan, float), "boundary": (False, bool), "level": (np.nan, float), "start": (0.0, float)}
    rest = {k: v for k, v in options.items() if k != "hydrograph"}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        start, scenario = None, None
        for run in _runs(_told(batches, [by, chained], kinds), [by, chained], filled):
            z, boundary, levels, first = (run.arrays.pop(c) for c in ("z", "boundary", "level", "start"))
            low, high = np.nanmin(levels, initial=np.inf), np.nanmax(levels, initial=-np.inf)
            level = np.nan if low > high else float(low) if low == high else np.nan_to_num(levels)
            del levels
            held = surge(level, float(run.first["floor"])) if options.get("hydrograph") else level
            if start is not None and scenario == run.key[0]:
                np.maximum(first, start, out=first)
            start = None
            made = inertial_run(z, boundary, held, start=first, **rest)
            yield from run.result([by, chained], kinds, made)
            start, scenario = np.nan_to_num(made[0]), run.key[0]

    own = cells.select(by, chained, "row", "col", F.col("z").cast("double").alias("z"), F.coalesce(F.col("boundary"), F.lit(False)).alias("boundary"), F.col("level").cast("double").alias("level"), F.col("floor").cast("double").alias("floor"), _number("start", 0.0).alias("start"))
    return _sorted_runs(own, by, [by, chained]).mapInArrow(solve, f"{by} {kinds_of[by]}, {_schema(chained, kinds_of[chained])}")


def cropped(cells: DataFrame, level: float, boundary: str = "boundary", z: str = "z", pad: int = 32) -> DataFrame:
    """Cells in the box around those that can flood (boundary, or z <= level + 1), widened by ``pad``.

    Not cropped if these are over 75 % of the known cells or the box holds 95 % of the grid.
    """
    can = F.col(boundary) | (F.col(z) <= level + 1)
    box = cells.agg(*[f(F.when(can, F.col(c))).alias(f"{n}_{c}") for f, n in ((F.min, "lo"), (F.max, "hi")) for c in ("row", "col")], F.count_if(can).alias("n"), F.count(z).alias("known"), F.max("row").alias("rows"), F.max("col").alias("cols")).first()
    if not box.n or box.n > 0.75 * box.known:
        return cells
    r0, r1, c0, c1 = max(0, box.lo_row - pad), min(box.rows, box.hi_row + pad), max(0, box.lo_col - pad), min(box.cols, box.hi_col + pad)
    if (r1 - r0 + 1) * (c1 - c0 + 1) >= 0.95 * (box.rows + 1) * (box.cols + 1):
        return cells
    return cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
