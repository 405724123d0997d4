"""Exact top-k inner products by the threshold algorithm of Fagin, Lotem and Naor.

Vectors of like norm are dealt into blocks of about one size.  Each
block is stored once with its lists: for every dimension its rows in the order
of that component.  A query walks the lists from the end that its sign favours,
a few steps at a time and those lists first whose next steps lower the bound
most, and scores each newly met row in full.  It stops when no row that it has
not met can reach its k-th score: the score of a fictitious row made of the
last component seen in every list.  Blocks whose bound is beaten before the
first step are refused whole.

Every block of vectors travels once, to the task of its group; blocks of queries
are sent after it, a few hundred bytes a query and group.  Groups stand in order
of norm.  All queries search the first group, of the largest norms; what they
find there bounds their search elsewhere, and queries are not sent to groups
whose norms cannot reach their k-th score (by the inequality of Cauchy and
Schwarz).  The k best of each group are merged by rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut

#: Rows of a block of vectors and of queries, about, and blocks of a group.
VECTOR_BLOCK, QUERY_BLOCK, GROUP = 4096, 1024, 8
#: Up to so many classes of norms are told by broadcast.
MAX_BROADCAST = 100_000
#: Steps into the chosen lists at first; they double.
FIRST_STEPS = 2
#: Integers up to which sums of doubles are exact.
EXACT = 1 << 53


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a null vector and one that holds a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Block:
    """Rows with their ids and, per dimension, the order of the rows by that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None) -> None:
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype("<i4") if order is None else order
        self.low, self.high = (rows.min(axis=0), rows.max(axis=0)) if len(ids) else (rows, rows)


def threshold_search(block: Block, query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """The k best (score, id) of ``best`` and a block, ties to smaller ids; rows scored and the depth of the deepest list.

    Sums are exact: doubles where all stay below 2**53, whole numbers of any
    size elsewhere.
    """
    ids, n = block.ids, len(block.ids)
    used = np.flatnonzero(query)
    if not len(used) or n == 0:
        found = [*best, *((0, int(i)) for i in np.sort(ids[ids != query_id])[:k])]
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k], 0, 0
    rows, weights = block.rows, query[used]
    reach = sum(abs(int(w)) * max(abs(int(a)), abs(int(b))) for w, a, b in zip(weights, block.low[used], block.high[used]))
    kind = np.float64 if reach < EXACT else object
    weights, full = weights.astype(kind), query.astype(kind)
    seen = np.where(weights > 0, block.high[used].astype(kind), block.low[used].astype(kind))
    depth, steps, scored = np.zeros(len(used), np.int64), FIRST_STEPS, 0
    met = ids == query_id
    best_scores, best_ids = np.array([s for s, _ in best], object if kind is object else np.float64), np.array([i for _, i in best], np.int64)
    while True:
        # a row not met may still tie with the bound and have the smaller id
        if len(best_ids) == k and best_scores[-1] > (weights * seen).sum() or met.all():
            break
        stop = np.minimum(depth + steps, n)
        at = np.where(weights > 0, n - stop, stop - 1)
        ahead = rows[block.order[at, used], used].astype(kind)
        drop = np.abs(weights * (seen - ahead))
        chosen = np.flatnonzero((depth < n) & (drop >= drop.mean()))
        if not len(chosen):
            chosen = np.flatnonzero(depth < n)
        fresh = np.zeros(n, bool)
        for j in chosen:
            a, b = (n - stop[j], n - depth[j]) if weights[j] > 0 else (depth[j], stop[j])
            fresh[block.order[a:b, used[j]]] = True
        new = np.flatnonzero(fresh & ~met)
        met |= fresh
        scored += len(new)
        scores, found = np.concatenate([best_scores, rows[new].astype(kind) @ full]), np.concatenate([best_ids, ids[new]])
        if len(scores) > 4 * k:
            # only what reaches the k-th score is sorted
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, found = scores[scores >= kth], found[scores >= kth]
        top = np.lexsort((found, -scores)) if kind is np.float64 else np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], found[i])), np.int64)
        best_scores, best_ids = scores[top[:k]], found[top[:k]]
        seen[chosen], depth[chosen] = ahead[chosen], stop[chosen]
        steps *= 2
    return [(int(s), int(i)) for s, i in zip(best_scores, best_ids)], scored, int(depth.max())


_BLOCK = "dim int, part int, ids binary, v binary, lists binary, reach double"


def _packed(rows: DataFrame, size: int, lists: bool) -> DataFrame:
    """One row per block of about ``size`` rows of one length: its number (0 has the largest norms), ids, components and lists.

    Vectors of like norm, within a factor of two of its square, share blocks
    and are dealt to them by their id.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    keyed = rows.withColumn("class", -F.floor(F.log2(norm + 1)).cast("int"))
    counts = cut(keyed.groupBy("dim", "class").agg(F.count("*").alias("n")))
    # one row for each length and class of norms: at most some two thousand classes a length
    numbered = counts.select("dim", "class", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    before = Window.partitionBy("dim").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut(numbered.withColumn("base", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int")))
    n = max(1, int(numbered.agg(F.sum("blocks")).first()[0] or 0))
    few = numbered.count() <= MAX_BROADCAST
    placed = keyed.join(F.broadcast(numbered) if few else numbered, ["dim", "class"])
    part = (F.col("base") + F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("blocks"))).cast("int").alias("part")
    ranged = placed.select("dim", "vec_id", "v", part).repartition(n, "dim", "part").sortWithinPartitions("dim", "part", "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def block() -> pa.RecordBatch:
            table = pa.concat_tables(held)
            dim, part = table["dim"][0].as_py(), table["part"][0].as_py()
            v = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            order = Block(np.zeros(len(v), np.int64), v).order.tobytes() if lists and dim else b""
            # the largest norm, rounded up
            reach = float(np.sqrt((v.astype(float) ** 2).sum(axis=1)).max()) * (1 + 1e-9) if dim else 0.0
            values = ([dim], pa.int32()), ([part], pa.int32()), ([table["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()), ([v.astype("<i8").tobytes()], pa.binary()), ([order], pa.binary()), ([reach], pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in values], names=["dim", "part", "ids", "v", "lists", "reach"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            dims, parts = table["dim"].to_numpy(), table["part"].to_numpy()
            first = 0
            for end in [*(np.flatnonzero((np.diff(dims) != 0) | (np.diff(parts) != 0)) + 1).tolist(), len(dims)]:
                if held and (held[0]["dim"][0].as_py(), held[0]["part"][0].as_py()) != (dims[first], parts[first]):
                    yield block()
                    held = []
                held.append(table.slice(first, end - first))
                first = end
        if held:
            yield block()

    return cut(ranged.mapInArrow(pack, _BLOCK))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products for each query row, exactly.

    Both tables have vec_id and embedding; other columns, whatever their names,
    play no part.  Null vectors, vectors that hold null or non-finite
    components and rows without a vec_id take no part; vectors meet queries of
    their own length only, and none of the query's own vec_id.  Of queries that
    repeat a vec_id the one of the smallest components counts; repeated vectors
    count each.  Without vectors or queries nothing is returned.  Components
    beyond the range of a long and scores beyond it count as its end.
    """
    found = searched(vectors, queries, k, scale).where("vec_id is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, vec_id, score, scored, depth): the k best of each query in each group of blocks that it is sent to.

    A row of null vec_id tells per query and group how many rows were scored
    and how many steps the deepest lists were walked.
    """
    ready = lambda t: t.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null").withColumn("dim", F.size("v"))
    asked = ready(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    q_blocks = _packed(cut(asked), QUERY_BLOCK, False).select("dim", F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    v_blocks = _packed(cut(ready(vectors)), VECTOR_BLOCK, True).withColumn("g", F.floor(F.col("part") / GROUP).cast("int"))
    none = F.lit(None).cast("binary")
    first = cut(_meet(v_blocks.where("g = 0"), q_blocks.select("*", F.lit(0).alias("g"), none.alias("b_ids"), none.alias("b_scores")), k))
    groups = cut(v_blocks.where("g > 0").groupBy("dim", "g").agg(F.max("reach").alias("reach")))
    if groups.isEmpty():
        return first
    bounded = cut(_bounded(q_blocks, first, k))
    # a row a pair of a block of queries and a group, numbers only
    pairs = bounded.select("dim", "q_part", "least").join(groups, "dim").where(F.col("reach") >= F.col("least")).select("dim", "q_part", "g")
    return first.union(_meet(v_blocks.where("g > 0"), bounded.drop("least").join(pairs, ["dim", "q_part"]), k))


def _bounded(q_blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``q_blocks`` with the k best of the first group (ids and scores, k each, packed) and ``least``: the smallest norm that can reach a k-th score."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    known = found.where("vec_id is not null").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "score", "vec_id"))).alias("best"))
    at = cut(q_blocks.select("dim", "q_part", "q_ids"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, packed in zip(*(batch[c].to_pylist() for c in ("dim", "q_part", "q_ids"))):
                own = np.frombuffer(packed, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), pa.array(np.full(len(own), part, np.int32)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["dim", "q_part", "at", "query_id"])

    rows = at.mapInArrow(ids, "dim int, q_part int, at int, query_id long").join(known, "query_id", "left")
    # a block holds QUERY_BLOCK queries or so, with k numbers each
    lists = rows.groupBy("dim", "q_part").agg(F.sort_array(F.collect_list(F.struct("at", "best"))).alias("best"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (1 << 63) - 1
        for batch in batches:
            for row in range(batch.num_rows):
                dim, part, q_ids, q_v, best = (batch[c][row].as_py() for c in ("dim", "q_part", "q_ids", "q_v", "best"))
                n = len(q_ids) // 8
                norms = np.sqrt((np.frombuffer(q_v, "<i8").reshape(n, dim).astype(float) ** 2).sum(axis=1)) if dim else np.zeros(n)
                b_ids, b_scores, least = np.full((n, k), -1, "<i8"), np.full((n, k), -limit - 1, "<i8"), float("inf")
                for i, one in enumerate(best):
                    mine = one["best"] or []
                    whole = len(mine) == k and all(-limit <= x["score"] < limit for x in mine)
                    if whole:
                        b_ids[i], b_scores[i] = [x["vec_id"] for x in mine], [x["score"] for x in mine]
                    # with fewer than k, or none above 0, any norm may do; equal scores may win by their id
                    least = min(least, mine[-1]["score"] / norms[i] * (1 - 1e-9) if whole and mine[-1]["score"] > 0 else 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((dim, pa.int32()), (part, pa.int32()), (q_ids, pa.binary()), (q_v, pa.binary()), (b_ids.tobytes(), pa.binary()), (b_scores.tobytes(), pa.binary()), (least, pa.float64()))], names=["dim", "q_part", "q_ids", "q_v", "b_ids", "b_scores", "least"])

    return q_blocks.join(lists, ["dim", "q_part"]).select("dim", "q_part", "q_ids", "q_v", "best").mapInArrow(pack, "dim int, q_part int, q_ids binary, q_v binary, b_ids binary, b_scores binary, least double")


def _meet(v_blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Searches of the query blocks ``asked`` in the groups of blocks that they name, as ``searched`` tells them.

    The blocks of a group come first to their task, which keeps them, and the
    queries after them, one block at a time.  Where there are fewer groups than
    tasks, queries of a group are shared out and its blocks sent to each share.
    """
    spark = v_blocks.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, v_blocks.select("dim", "g").distinct().count())
    shares = max(1, min(tasks // groups, asked.select("q_part").distinct().count()))
    none = F.lit(None).cast("binary")
    left = v_blocks.select("dim", "g", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.col("part").alias("n"), "ids", "v", "lists", none.alias("b_ids"), none.alias("b_scores"))
    right = asked.select("dim", "g", (F.col("q_part") % shares).cast("int").alias("share"), F.lit(1).alias("kind"), F.col("q_part").alias("n"), F.col("q_ids").alias("ids"), F.col("q_v").alias("v"), none.alias("lists"), "b_ids", "b_scores")
    dealt = left.union(right).repartition(max(1, min(groups * shares, 10 * tasks)), "dim", "g", "share").sortWithinPartitions("dim", "g", "share", "kind", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (1 << 63) - 1
        key, blocks = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                dim, g, share, kind, ids, v, lists, b_ids, b_scores = (batch[c][row].as_py() for c in ("dim", "g", "share", "kind", "ids", "v", "lists", "b_ids", "b_scores"))
                if key != (dim, g, share):
                    key, blocks = (dim, g, share), []
                ids = np.frombuffer(ids, "<i8")
                rows = np.frombuffer(v, "<i8").reshape(len(ids), dim)
                if not kind:
                    blocks.append(Block(ids, rows, np.frombuffer(lists, "<i4").reshape(len(ids), dim)))
                    continue
                if not blocks:
                    continue
                out = []
                for i, query in enumerate(rows):
                    before: list[tuple[int, int]] = []
                    if b_ids is not None:
                        own, scores = (np.frombuffer(b, "<i8").reshape(-1, k)[i].tolist() for b in (b_ids, b_scores))
                        before = [(s, j) for s, j in zip(scores, own) if s > -limit - 1]
                    best, scored, depth = before, 0, 0
                    for block in blocks:
                        best, more, deep = threshold_search(block, ids[i], query, k, best)
                        scored, depth = scored + more, max(depth, deep)
                    # what was known before is told already, once for each time
                    known = Counter(before)
                    known.subtract(best)
                    fresh = Counter({x: -n for x, n in known.items() if n < 0})
                    out += [(int(ids[i]), j, max(-limit - 1, min(limit, s)), None, None) for s, j in fresh.elements()]
                    out.append((int(ids[i]), None, None, scored, depth))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score", "scored", "depth"])

    return dealt.select("dim", "g", "share", "kind", "ids", "v", "lists", "b_ids", "b_scores").mapInArrow(run, "query_id long, vec_id long, score long, scored long, depth long")


#: The same in DuckDB for k = 5 and queries whose id 50 divides.
ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
