"""Bootstrap of scored points of any number: weights drawn in tasks, curves and areas summed per replicate.

Points alike in class and scores are counted together.  For each such row a task
draws how often it stands in every replicate, from a Poisson law of its count
(the limit of drawing with replacement), seeded by the row itself, so results do
not depend on how rows are dealt.  A replicate is then a weighted table like any
other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows whose weights a task holds at a time.
ROWS = 256


def replicates(counts: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``counts`` (columns and n) as replicate, w and the columns, for all weights over 0."""
    names = [c for c in counts.columns if c != "n"]
    keyed = counts.select(*names, "n", F.abs(F.xxhash64(*names) % F.lit(1 << 62)).alias("_seed"))
    kinds = dict(counts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                drawn = np.stack([np.random.default_rng([seed, s]).poisson(n, n_boot) for n, s in zip(batch["n"].to_pylist(), batch["_seed"].to_pylist())])
                at, replicate = np.nonzero(drawn)
                columns = [batch[c].take(pa.array(at)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(replicate.astype(np.int32)), pa.array(drawn[at, replicate].astype(np.int64))], names=[*names, "replicate", "w"])

    return keyed.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", replicate int, w long")


def per_score(drawn: DataFrame, score: str) -> DataFrame:
    """replicate, score, p and n: weights of floods and of the others at each score."""
    side = lambda wanted: F.sum(F.when(F.col("pos") == wanted, F.col("w")).otherwise(0))
    return drawn.groupBy("replicate", F.col(score).alias("score")).agg(side(True).alias("p"), side(False).alias("n"))


def areas(drawn: DataFrame, score: str) -> DataFrame:
    """replicate and auc, 0.5 where a replicate has one class only."""
    below = Window.partitionBy("replicate").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    won = per_score(drawn, score).withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    p, n = F.sum("p"), F.sum("n")
    return won.groupBy("replicate").agg(F.when((p > 0) & (n > 0), F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)) / F.when((p > 0) & (n > 0), p * n)).otherwise(0.5).alias("auc"))


def area_differences(scored: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """A column ``v``: per replicate the area under ``score`` less that under ``other_score``."""
    pos = F.coalesce(F.col("cls") == "flood", F.lit(False)).alias("pos")
    drawn = replicates(scored.groupBy(pos, "score", "other_score").agg(F.count("*").alias("n")), n_boot, seed)
    other = areas(drawn, "other_score").withColumnRenamed("auc", "other")
    return areas(drawn, "score").join(other, "replicate").select((F.col("auc") - F.col("other")).alias("v"))


def curve_bands(scored: DataFrame, n_boot: int = 1000, seed: int = 12345, steps: int = 20, level: float = 0.95, score: str = "score", positive: Column | None = None) -> DataFrame:
    """curve, at, mean, low and high: bootstrapped ROC and precision-recall curves at ``steps`` + 1 even places.

    ``roc`` is the best hit rate at a false-positive rate of at most ``at``,
    ``pr`` the best precision at a hit rate of at least ``at``; replicates
    without floods or without others take no part.
    """
    pos = F.coalesce(F.col("cls") == "flood" if positive is None else positive, F.lit(False)).alias("pos")
    drawn = replicates(scored.groupBy(pos, F.col(score).alias("score")).agg(F.count("*").alias("n")), n_boot, seed)
    down = Window.partitionBy("replicate").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("replicate")
    sums = per_score(drawn, "score").select("replicate", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(every).alias("p"), F.sum("n").over(every).alias("n")).where("p > 0 and n > 0")
    tpr, fpr, precision = F.col("tp") / F.col("p"), F.col("fp") / F.col("n"), F.col("tp") / (F.col("tp") + F.col("fp"))
    places = [i / steps for i in range(steps + 1)]
    best = [F.struct(F.lit("roc").alias("curve"), F.lit(a).alias("at"), F.coalesce(F.max(F.when(fpr <= a, tpr)), F.lit(0.0)).alias("v")) for a in places]
    best += [F.struct(F.lit("pr").alias("curve"), F.lit(a).alias("at"), F.max(F.when(tpr >= a, precision)).alias("v")) for a in places]
    each = sums.groupBy("replicate").agg(F.array(*best).alias("b")).select(F.explode("b").alias("b")).select("b.*")
    ends = F.percentile("v", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return each.groupBy("curve", "at").agg(F.avg("v").alias("mean"), ends.alias("e")).select("curve", "at", "mean", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
