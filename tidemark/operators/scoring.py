"""Skill scores of depth fields against points and observed masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.storage import by_merge, cut

#: Bootstrap settings.
N_BOOT, SEED, LEVEL = 10_000, 12345, 0.95
#: Stations of a square that is not halved again, times that squares are halved at most, and levels up to which all squares are broadcast.
CROWD, FINEST, COARSE = 16, 24, 6
#: Points of a register that goes to the tasks whole.
REGISTER = 100_000


def windows(points: DataFrame, cells: DataFrame, half: int, depth: str = "depth") -> DataFrame:
    """Each point joined to the cells of its square window; a point off the grid keeps a null depth.

    Each asks for the cells of its window, so points and cells meet by an
    equi-join on row and column.
    """
    steps = F.sequence(F.lit(-half), F.lit(half))
    asks = points.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps)).withColumn("_r", F.col("row") + F.col("_dr")).withColumn("_c", F.col("col") + F.col("_dc"))
    there = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(depth).alias("_d"))
    return by_merge(asks).join(there, ["_r", "_c"], "left").drop("_dr", "_dc", "_r", "_c")


def point_scores(points: DataFrame, cells: DataFrame, radius_m: float = 50.0, cell_m: float = 30.0, threshold: float = 0.10, depth: str = "depth") -> DataFrame:
    """Points with ``score`` (largest depth in the window, 0 if none) and ``hit`` (score at least the threshold)."""
    half = int(np.ceil(radius_m / cell_m))
    found = windows(points, cells, half, depth).groupBy(*points.columns).agg(F.coalesce(F.max("_d"), F.lit(0.0)).alias("score"))
    return found.withColumn("hit", F.col("score") >= threshold)


def skill(scored: DataFrame, *by: str, positive: Column | None = None) -> DataFrame:
    """Hits, HR, CRR and TSS; HR is 0 without positives, CRR 1 without negatives."""
    pos = F.col("cls") == "flood" if positive is None else positive
    n_pos, n_neg = F.count_if(pos), F.count_if(~pos)
    hits, rejects = F.count_if(pos & F.col("hit")), F.count_if(~pos & ~F.col("hit"))
    hr = F.when(n_pos > 0, hits / F.when(n_pos > 0, n_pos)).otherwise(0.0)
    crr = F.when(n_neg > 0, rejects / F.when(n_neg > 0, n_neg)).otherwise(1.0)
    return scored.groupBy(*by).agg(n_pos.alias("n_pos"), n_neg.alias("n_neg"), hits.alias("hits"), hr.alias("hr"), crr.alias("crr"), (hr + crr - 1).alias("tss"))


def roc_auc(scored: DataFrame, *by: str, score: str = "score", positive: Column | None = None) -> DataFrame:
    """Area under the curve by ranks, ties averaged; 0.5 with an empty side.

    Rows are first summed per distinct score, so the ranking window runs over
    distinct scores of a group only; without groups over ranges of scores.
    """
    pos = F.col("cls") == "flood" if positive is None else positive
    per = scored.groupBy(*by, score).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    if not by:
        ranked = cut(running_totals(per, score, "n"))
        p, n = F.sum("p"), F.sum("n")
        # of the others those above a score, and half of those at it, are not passed
        lost = F.sum(F.col("p") * (F.col("upto_n") - F.col("n") / 2))
        return ranked.agg(F.when((p > 0) & (n > 0), 1 - lost / F.when((p > 0) & (n > 0), p * n)).otherwise(0.5).alias("auc"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = per.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    p, n = F.sum("p"), F.sum("n")
    return won.groupBy(*by).agg(F.when((p > 0) & (n > 0), F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)) / F.when((p > 0) & (n > 0), p * n)).otherwise(0.5).alias("auc"))


def running_totals(rows: DataFrame, order: str, *values: str) -> DataFrame:
    """``rows`` with the sum of each value over all rows of at least this ``order`` (``upto_``...), ties not allowed.

    Rows are dealt into ranges of ``order``; sums run within a range and the
    few totals of the ranges before it are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, F.desc(order)).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    # one row per range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_range").select(*rows.columns, *[(F.col(f"_{v}") + F.sum(v).over(inside)).alias(f"upto_{v}") for v in values])


def roc_curve(scored: DataFrame, score: str = "score", positive: Column | None = None) -> DataFrame:
    """tpr, fpr and precision at each distinct score as threshold (score at least it)."""
    pos = F.col("cls") == "flood" if positive is None else positive
    per = cut(scored.groupBy(F.col(score).alias("threshold")).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")))
    every = per.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    tp, fp = F.col("upto_p"), F.col("upto_n")
    part = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return running_totals(per, "threshold", "p", "n").select("threshold", part(tp, F.lit(every.p or 0)).alias("tpr"), part(fp, F.lit(every.n or 0)).alias("fpr"), part(tp, tp + fp).alias("precision"))


def contingency(cells: DataFrame, *by: str, modelled: str = "modelled", observed: str = "observed", cell_area_m2: float = 900.0) -> DataFrame:
    """tp, fp, fn, CSI, hit rate, false-alarm ratio (1 without modelled hits to judge by), bias (null without observation)."""
    m, o = F.coalesce(F.col(modelled), F.lit(False)), F.coalesce(F.col(observed), F.lit(False))
    tp, fp, fn = F.count_if(m & o), F.count_if(m & ~o), F.count_if(~m & o)
    ratio = lambda a, b, empty: F.when(b > 0, a / F.when(b > 0, b)).otherwise(empty)
    return cells.groupBy(*by).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp + fn, 0.0).alias("csi"), ratio(tp, tp + fn, 0.0).alias("hit_rate"), ratio(fp, tp + fp, 0.0).alias("far"),
        ratio(tp + fp, tp + fn, None).alias("bias"), ((tp + fn) * F.lit(cell_area_m2) / 1e6).cast("double").alias("observed_km2"),
    )


def best_match(metrics: DataFrame, *by: str, passing: float = 0.30, warning: float = 0.15, limited_km2: float = 5.0) -> DataFrame:
    """Per event the row of the best CSI with a verdict; small observed areas are judged by hit rate and marked limited."""
    small = F.col("observed_km2") < limited_km2
    key = F.when(small, F.col("hit_rate")).otherwise(F.col("csi"))
    best = metrics.groupBy(*by).agg(F.max_by(F.struct(*[c for c in metrics.columns if c not in by]), F.struct(key, -F.col("return_period"))).alias("b")).select(*by, "b.*")
    grade = F.when(key >= passing, "PASS").when(key >= warning, "WARN").otherwise("FAIL")
    return best.withColumn("verdict", F.when(small, F.concat(F.lit("LIMITED-"), grade)).otherwise(grade))


def _auc(score: np.ndarray, pos: np.ndarray) -> float:
    a, b = score[pos], np.sort(score[~pos])
    if not len(a) or not len(b):
        return 0.5
    under, upto = np.searchsorted(b, a, side="left"), np.searchsorted(b, a, side="right")
    return float((under + upto).mean() / (2 * len(b)))


def _auc_diff(pdf: pd.DataFrame, ids: np.ndarray, seed: int) -> np.ndarray:
    """Differences of the area for the given replicates of a register."""
    pos, scores = (pdf["cls"] == "flood").to_numpy(), [pdf[c].to_numpy(float) for c in ("score", "other_score")]
    a, b = np.flatnonzero(pos), np.flatnonzero(~pos)
    out = []
    for i in ids.tolist():
        rng = np.random.default_rng([seed, i])
        at = np.concatenate([rng.choice(a, len(a)), rng.choice(b, len(b))])
        out.append(_auc(scores[0][at], pos[at]) - _auc(scores[1][at], pos[at]))
    return np.array(out)


def _large_auc_diff(scored: DataFrame, n_boot: int, seed: int, level: float) -> DataFrame:
    from tidemark.operators.resampling import area_differences

    first, second = (roc_auc(scored, score=c).first().auc for c in ("score", "other_score"))
    ends = F.percentile("v", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    drawn = area_differences(scored, n_boot, seed).agg(ends.alias("e"), F.avg((F.col("v") > 0).cast("double")).alias("p_positive"))
    return drawn.select(F.lit(first - second).alias("estimate"), F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "p_positive")


def bootstrap(scored: DataFrame, measure: str = "tss", n_boot: int = N_BOOT, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """estimate, low, high and share above zero of ``tss``, ``tss_diff`` or ``auc_diff``, resampled within classes.

    Replicates are dealt to tasks and each is drawn from its own seed.  For
    both forms of tss points of one class and outcome are alike, so a replicate
    is one draw of their numbers from a table of eight rows at most.  For
    auc_diff a register of up to ``REGISTER`` points goes to the tasks whole;
    of a larger one tasks draw weights for points alike.  With an empty class
    nothing can be drawn, and both ends are the estimate.
    """
    if measure not in ("tss", "tss_diff", "auc_diff"):
        raise ValueError("measure must be tss, tss_diff or auc_diff")
    pos = F.coalesce(F.col("cls") == "flood", F.lit(False)).alias("pos")
    if measure == "auc_diff":
        rows = scored.select("label", "cls", "score", "other_score").limit(REGISTER + 1).toPandas().sort_values("label", kind="stable")
        if len(rows) > REGISTER:
            return _large_auc_diff(scored, n_boot, seed, level)
        flood = (rows["cls"] == "flood").to_numpy()
        estimate = _auc(rows["score"].to_numpy(float), flood) - _auc(rows["other_score"].to_numpy(float), flood)
        empty = not flood.any() or flood.all()
        draw = lambda ids: _auc_diff(rows, ids, seed)
    else:
        other = F.col("other_hit") if measure == "tss_diff" else F.lit(None).cast("boolean")
        told = scored.groupBy(pos, F.col("hit"), other.alias("other")).count().collect()
        right = lambda hit, is_pos: 0 if hit is None else int(bool(hit) == is_pos)
        sides = []
        for is_pos in (True, False):
            own = sorted((right(r.hit, is_pos) - (right(r.other, is_pos) if measure == "tss_diff" else 0), r["count"]) for r in told if r.pos == is_pos)
            sides.append((np.array([v for v, _ in own], float), np.array([n for _, n in own], np.int64)))
        # an empty class of positives counts as none hit, one of negatives as all rejected
        rate = lambda v, n, none: float((v * n).sum() / n.sum()) if len(n) else none
        shift, none = (1.0, (0.0, 1.0)) if measure == "tss" else (0.0, (0.0, 0.0))
        estimate = sum(rate(*side, x) for side, x in zip(sides, none)) - shift
        empty = any(not len(n) for _, n in sides)

        def draw(ids: np.ndarray) -> np.ndarray:
            out = []
            for i in ids.tolist():
                rng = np.random.default_rng([seed, i])
                out.append(sum(rate(v, rng.multinomial(n.sum(), n / n.sum()), x) for (v, n), x in zip(sides, none)) - shift)
            return np.array(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(draw(batch["id"].to_numpy()), pa.float64())], names=["v"])

    spark = scored.sparkSession
    if empty:
        return spark.createDataFrame([(estimate, estimate, estimate, float(estimate > 0))], "estimate double, low double, high double, p_positive double")
    ends = F.percentile("v", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    drawn = spark.range(n_boot).mapInArrow(run, "v double").agg(ends.alias("e"), F.avg((F.col("v") > 0).cast("double")).alias("p_positive"))
    return drawn.select(F.lit(estimate).alias("estimate"), F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "p_positive")


def numeric_gate(scores: DataFrame, hr_floor: float = 0.70, crr_floor: float = 0.70, baseline_tss: float | None = None, margin: float = 0.0) -> DataFrame:
    """``passed`` and ``reasons`` per row of hr, crr, tss."""
    reasons = [F.when(F.col("hr") < hr_floor, F.lit(f"HR below {hr_floor}")), F.when(F.col("crr") < crr_floor, F.lit(f"CRR below {crr_floor}"))]
    if baseline_tss is not None:
        reasons.append(F.when(F.col("tss") - baseline_tss < margin, F.lit("TSS margin not met")))
    told = F.array_compact(F.array(*reasons))
    return scores.withColumn("reasons", told).withColumn("passed", F.size("reasons") == 0)


def band_check(points: DataFrame, cells: DataFrame, half: int = 12, depth: str = "depth") -> DataFrame:
    """High-water marks: largest depth around against the band [low, high]: IN-BAND, UNDER, OVER or OUTSIDE-DOMAIN."""
    found = windows(points, cells, half, depth).groupBy(*points.columns).agg(F.max("_d").alias("model"))
    verdict = F.when(F.col("model").isNull(), "OUTSIDE-DOMAIN").when(F.col("model") < F.col("low"), "UNDER").when(F.col("model") > F.col("high"), "OVER").otherwise("IN-BAND")
    return found.withColumn("verdict", verdict)


def nearest(points: DataFrame, stations: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Each point with the nearest station by plain coordinate distance, ties to the smaller station_id.

    Squares that hold stations are halved level by level until none holds more
    than ``CROWD``; at each level a point goes on with those squares alone whose
    nearest corner is no farther than the farthest one of another, so wherever
    stations crowd a point meets a few squares a level and the stations of a few
    of the smallest.  Stations at one place count once.  Points without
    coordinates, and all points where there is no station, get nulls.
    """
    at = points.columns
    own = cut(stations.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.min("station_id").alias("station_id")))
    kind = dict(own.dtypes)["station_id"]
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    none = points.where(~placed).select(*at, F.lit(None).cast(kind).alias("station_id"), F.lit(None).cast("double").alias("distance"))
    box = own.agg(F.count("*").alias("n"), F.min("_x").alias("x1"), F.max("_x").alias("x2"), F.min("_y").alias("y1"), F.max("_y").alias("y2")).first()
    if not box.n:
        return points.select(*at, F.lit(None).cast(kind).alias("station_id"), F.lit(None).cast("double").alias("distance"))
    side = max(box.x2 - box.x1, box.y2 - box.y1) * (1 + 1e-9) or 1.0
    finest = 1 << FINEST
    number = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(side) * finest), F.lit(finest - 1)).cast("long")
    dealt = cut(own.withColumn("_i", number("_x", box.x1)).withColumn("_j", number("_y", box.y1)))
    up = lambda c, levels: F.shiftright(F.col(c), levels)
    # the first level at which no square is crowded
    depth = next((d for d in range(FINEST) if (dealt.groupBy(up("_i", FINEST - d), up("_j", FINEST - d)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]) <= CROWD), FINEST)
    asked = points.where(placed).select(F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).distinct()
    left = asked.select("_px", "_py", F.lit(0).cast("long").alias("_i"), F.lit(0).cast("long").alias("_j"))
    for d in range(1, depth + 1):
        children = dealt.select(up("_i", FINEST - d).alias("_ci"), up("_j", FINEST - d).alias("_cj")).distinct().withColumn("_i", up("_ci", 1)).withColumn("_j", up("_cj", 1))
        # there are no more squares than 4**d, and no more than stations
        met = left.join(F.broadcast(children) if d <= COARSE else children, ["_i", "_j"]).select("_px", "_py", F.col("_ci").alias("_i"), F.col("_cj").alias("_j"))
        width = side / (1 << d)
        low_x, low_y = F.lit(box.x1) + F.col("_i") * width, F.lit(box.y1) + F.col("_j") * width
        off = lambda p, low, w=width: F.greatest(low - p, p - low - w, F.lit(0.0))
        far = lambda p, low, w=width: F.greatest(F.abs(p - low), F.abs(p - low - w))
        square = lambda a, b: a * a + b * b
        near, reach = square(off(F.col("_px"), low_x), off(F.col("_py"), low_y)), square(far(F.col("_px"), low_x), far(F.col("_py"), low_y))
        ranged = cut(met.withColumn("_near", near).withColumn("_far", reach))
        best = ranged.groupBy("_px", "_py").agg(F.min("_far").alias("_least"))
        # a little more is kept than rounding can blur
        left = cut(ranged.join(best, ["_px", "_py"]).where(F.col("_near") <= F.col("_least") * (1 + 1e-9)).select("_px", "_py", "_i", "_j"))
    held = dealt.select("_x", "_y", "station_id", up("_i", FINEST - depth).alias("_i"), up("_j", FINEST - depth).alias("_j"))
    d2 = (F.col("_px") - F.col("_x")) * (F.col("_px") - F.col("_x")) + (F.col("_py") - F.col("_y")) * (F.col("_py") - F.col("_y"))
    told = left.join(held, ["_i", "_j"]).groupBy("_px", "_py").agg(F.min(F.struct(d2.alias("d2"), "station_id")).alias("m"))
    told = cut(told.select("_px", "_py", "m.station_id", F.sqrt("m.d2").alias("distance")))
    whole = points.where(placed).join(told, (F.col(x).cast("double") == F.col("_px")) & (F.col(y).cast("double") == F.col("_py")))
    return whole.select(*at, told["station_id"], told["distance"]).union(none)


def validated(scored: DataFrame, *by: str, **gate) -> DataFrame:
    """Skill of scored points per group with the gate's reasons and verdict."""
    return numeric_gate(skill(scored, *by), **gate)


def register(documented: DataFrame, controls: DataFrame, fit: Column) -> DataFrame:
    """One point register of documented points and the controls that are ``fit``, with their origin."""
    return documented.withColumn("origin", F.lit("documented")).unionByName(controls.where(fit).withColumn("origin", F.lit("control")), allowMissingColumns=True)
