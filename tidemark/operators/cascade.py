"""The spill cascade by tree contraction: what overflows from each node reaches the next below it.

A node's inflow is its own water plus, of each node above, what that one's
inflow has beyond its capacity.  In every round nodes whose uppers are all
settled are settled, and hand their overflow on in one sum.  A node that waits
for a single upper holds a pointer to it and the overflow along the way as a
function ``max(b, x - a)`` of the inflow x there; such functions are closed under
composition, so pointers double and a chain of n nodes settles in about log2(n)
rounds.  No tree is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import cut_round


def on_cycles(links: DataFrame) -> DataFrame:
    """(node) on a cycle of ``links`` (a, b), of which each ``a`` has one.

    Where twice as many steps lead to as many nodes as before, these nodes map
    onto themselves: they are the ends of paths and the nodes of cycles.
    """
    ends = links.select(F.col("b").alias("a")).distinct().join(links, "a", "left_anti").select("a", F.col("a").alias("b"))
    steps = cut_round(links.select("a", "b").unionByName(ends))
    before = None
    while True:
        images = steps.select(F.col("b").alias("node")).distinct()
        count = images.count()
        if count == before:
            return images.join(ends.select(F.col("a").alias("node")), "node", "left_anti")
        before = count
        ahead = steps.select(F.col("a").alias("b"), F.col("b").alias("after"))
        steps = cut_round(steps.join(ahead, "b").select("a", F.col("after").alias("b")))


def acyclic(spill: DataFrame, depressions: DataFrame) -> DataFrame:
    """(dep, parent): links of ``spill`` (dep, spill_to) between ``depressions``.

    Nodes of a cycle are settled by number, each handing on only to those yet
    to come, so a cycle's links back to smaller numbers are left out.
    """
    known = depressions.select(F.col("dep").alias("b"))
    links = cut_round(spill.select(F.col("dep").alias("a"), F.col("spill_to").alias("b")).where("a <> b").join(known, "b", "left_semi").join(known.withColumnRenamed("b", "a"), "a", "left_semi"))
    round_about = on_cycles(links).select(F.col("node").alias("a"), F.lit(True).alias("cycle"))
    kept = links.join(round_about, "a", "left").where("cycle is null or b > a")
    return kept.select(F.col("a").alias("dep"), F.col("b").alias("parent"))


def settled(nodes: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """``by``, dep, inflow and capacity from ``nodes`` (``by``, dep, capacity, water) and the forest ``links`` (dep, parent)."""
    uppers = links.groupBy(F.col("parent").alias("dep")).agg(F.count("*").alias("pending"), F.bit_xor("dep").alias("ids"))
    start = nodes.join(links, "dep", "left").join(uppers, "dep", "left")
    none = lambda kind: F.lit(None).cast(kind)
    waits = F.coalesce("pending", F.lit(0))
    state = cut_round(
        start.select(
            *by, "dep", "parent", "capacity", "water", waits.alias("pending"), F.coalesce("ids", F.lit(0)).alias("ids"), F.when(waits == 0, F.col("water")).alias("inflow"),
            (waits == 0).alias("fresh"), none("long").alias("upper"), none("double").alias("a"), none("double").alias("b"),
        )
    )
    while not state.where("inflow is null").isEmpty():
        over = F.greatest(F.col("inflow") - F.col("capacity"), F.lit(0.0))
        sent = state.where("fresh and parent is not null").groupBy(*by, F.col("parent").alias("dep")).agg(F.sum(over).alias("more"), F.count("*").alias("came"), F.bit_xor("dep").alias("gone"))
        ahead = state.select(*by, F.col("dep").alias("upper"), F.col("inflow").alias("u_inflow"), F.col("water").alias("u_water"), F.col("capacity").alias("u_capacity"), F.col("upper").alias("u_upper"), F.col("a").alias("u_a"), F.col("b").alias("u_b"))
        met = state.join(sent, [*by, "dep"], "left").join(ahead, [*by, "upper"], "left")
        waiting, chained = F.col("inflow").isNull(), F.col("upper").isNotNull()
        # a pointer just set leads to the next node above, whose overflow begins at its capacity
        a, b = F.coalesce("a", "u_capacity"), F.coalesce("b", F.lit(0.0))
        # the node above points on, once its own pointer has had its function
        doubles = F.col("u_inflow").isNull() & F.col("u_upper").isNotNull() & F.col("u_a").isNotNull()
        left = F.col("pending") - F.coalesce("came", F.lit(0))
        ids = F.col("ids").bitwiseXOR(F.coalesce("gone", F.lit(0)))
        water = F.when(waiting & ~chained, F.col("water") + F.coalesce("more", F.lit(0.0))).otherwise(F.col("water"))
        now = (
            F.when(~waiting, F.col("inflow"))
            .when(chained, F.when(F.col("u_inflow").isNotNull(), F.col("water") + F.greatest(b, F.col("u_inflow") - a)))
            .otherwise(F.when(left == 0, water))
        )
        pointer = F.when(chained, F.when(doubles, F.col("u_upper")).otherwise(F.col("upper"))).when(waiting & (left == 1), ids)
        new_a = F.when(chained, F.when(doubles, a + F.col("u_a") - F.col("u_water")).otherwise(a))
        new_b = F.when(chained, F.when(doubles, F.greatest(b, F.col("u_b") + F.col("u_water") - a)).otherwise(b))
        after = met.select(*by, "dep", "parent", "capacity", water.alias("water"), left.alias("pending"), ids.alias("ids"), now.alias("inflow"), (waiting & now.isNotNull()).alias("fresh"), pointer.alias("upper"), new_a.alias("a"), new_b.alias("b"))
        state = cut_round(after)
    return state.select(*by, "dep", "inflow", "capacity")
