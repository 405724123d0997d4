"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import cut, cut_round

#: Up to so many links one task joins all, which spares small tables the rounds; the result is the same.
SMALL = 20_000


def joined(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node of the links with the smallest node of its component."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(above)}


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = joined(pair for batch in batches for pair in zip(batch["u"].to_pylist(), batch["v"].to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Nodes that occur in ``links`` with the smallest node of their component: (node, root).

    Alternates the large-star and small-star rewritings of Kiveris et al.
    ("Connected Components in MapReduce and Beyond"): every node's neighbours
    are tied to the smallest one, until the links are stars.  Each half is a
    minimum per node, which Spark sums up before the shuffle, and a join, whose
    hot nodes adaptive execution splits; no neighbourhood is ever gathered.
    Links with a null end and loops are ignored.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and u is not null and v is not null").distinct())
    if set(dict(edges.dtypes).values()) == {"bigint"} and edges.limit(SMALL + 1).count() <= SMALL:
        return cut(_in_one_task(edges))
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are cut off, so that the join deals both sides anew and can split a hub's links
        least = cut_round(both.groupBy("u").agg(F.min("v").alias("m")))
        large = cut_round(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
        # all links now point from the larger to the smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut_round(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
