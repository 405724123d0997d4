"""Mixing sources to target weights by temperature, in DataFrame functions alone.

Token shares of the sources are raised to an exponent between 0 (all sources
alike) and 1 (as they are) and normalised.  The exponent is bisected: the
smallest that keeps the most repeated source within a repetition limit, or the
one at which the weights' entropy meets a target.  Weights times the token
budget say how often each source is read: some whole epochs, then a part of
one.

Each epoch of a source is a block permutation.  A document is known by a digest
of its id and text, a null one read as empty.  Documents are dealt into blocks
by that digest, blocks are ordered by a digest of epoch, source and block,
documents within a block by one of epoch and document.  A partial epoch ends
where its tokens run out; that place is one pair of digests a source, found
from tokens summed per group of blocks, then per block of the group and then in
the one block where the budget ends, so a source that holds a third of all rows
is never sorted as a whole, and applying the plan is a comparison without a
shuffle.

Rows that share a doc_id have places of their own if their texts differ; rows
that share both share a place, and are read equally often.  Texts without
tokens use up no budget.  An empty table gives an empty plan and no rows.
Columns of any other name play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut

#: Documents a block is to hold, about.
BLOCK = 256
#: Above so many sources the plan is joined by a shuffle, not broadcast.
MAX_BROADCAST = 100_000
STEPS = 50


def tokens(text: Column) -> Column:
    """Tokens for budgets: runs of characters other than space, tab and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def source_of(source: Column) -> Column:
    """A null source counts as the source of the empty name."""
    return F.coalesce(source, F.lit(""))


def exponent(sources: DataFrame, max_repetition: float | None, target_entropy: float | None, budget_share: float | None) -> tuple[float, float]:
    """The bisected exponent and the sum of the shares raised to it, from (source, n_tokens); 1 for an empty corpus.

    Only distinct sizes of sources meet here, in one row, never documents.
    """
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either max_repetition or target_entropy")
    # sources of equal size count together, so the row holds at most about the root of twice the corpus' tokens
    sizes = sources.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("c"))
    total = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"] * x["c"]).cast("double")
    shares = sizes.agg(F.sort_array(F.collect_list(F.struct("n_tokens", "c"))).alias("t")).select(F.transform("t", lambda x: F.struct((x["n_tokens"].cast("double") / total).alias("p"), x["c"].alias("c"))).alias("s"))
    zero = F.lit(0.0)
    norm = lambda a: F.aggregate("s", zero, lambda z, x: z + x["c"] * F.pow(x["p"], a))
    least, most = F.col("s")[0]["p"], F.element_at("s", -1)["p"]
    middle = lambda s: (s["lo"] + s["hi"]) / 2
    if max_repetition is not None:
        # the smallest source repeats most; more exponent, less repetition
        if budget_share is None:
            # the largest source is read once, so the smallest is read as often as their rates differ
            low = lambda a: F.pow(least / most, a - 1) > F.lit(float(max_repetition))
        else:
            low = lambda a: F.pow(least, a - 1) / norm(a) * F.lit(float(budget_share)) > F.lit(float(max_repetition))
    else:
        # entropy falls as the exponent grows: of weights p^a / z it is ln z - a * sum(p^a ln p) / z
        entropy = lambda a: F.ln(norm(a)) - a * F.aggregate("s", zero, lambda z, x: z + x["c"] * F.pow(x["p"], a) * F.ln(x["p"])) / norm(a)
        low = lambda a: entropy(a) > F.lit(float(target_entropy))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    step = lambda s, _: F.struct(F.when(low(middle(s)), middle(s)).otherwise(s["lo"]).alias("lo"), F.when(low(middle(s)), s["hi"]).otherwise(middle(s)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: F.round(s["hi"], 6))
    row = shares.select(F.when(F.size("s") > 0, found).otherwise(1.0).alias("a"), "s").select("a", F.when(F.size("s") > 0, norm(F.col("a"))).otherwise(1.0).alias("z")).first()
    return row.a, row.z


def place_of(doc_id: Column, text: Column) -> Column:
    """Digest by which a document is known."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def _block(digits: Column) -> Column:
    return F.substring("place", F.lit(1), digits)


def _block_key(epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", epoch.cast("string"), "source", "block"))


def _doc_key(epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", epoch.cast("string"), "place"))


def mixing_plan(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None, budget_share: float | None = 1.0, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per source: source, weight, epochs, whole (epochs read in full), digits, last_block, last_doc.

    ``budget_share`` is the token budget as a share of the corpus; None takes
    the smallest budget at which no source falls below one whole epoch, so
    nothing is dropped and no source is read more often than the limit.  A source without tokens is read once.
    """
    thin = cut(docs.select(place_of(F.col("doc_id"), F.col("text")).alias("place"), source_of(F.col("source")).alias("source"), tokens(F.col("text")).alias("n_tokens")))
    sources = cut(thin.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")))
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    alpha, norm = exponent(sources, max_repetition, target_entropy, budget_share)
    share = F.col("n_tokens") / F.lit(float(total or 1))
    weight = F.round(F.pow(share, F.lit(alpha)) / F.lit(norm), 9)
    weighted = sources.select("source", "n_tokens", "n_docs", F.when(F.col("n_tokens") > 0, weight).otherwise(0.0).alias("weight"))
    if budget_share is None:
        budget = weighted.where("weight > 0").agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0] or 0.0
    else:
        budget = budget_share * total
    epochs = F.when(F.col("weight") > 0, F.round(F.col("weight") * F.lit(float(budget)) / F.col("n_tokens"), 6)).otherwise(1.0)
    read = weighted.withColumn("epochs", epochs).withColumn("whole", F.floor("epochs").cast("int")).withColumn("rest", F.round((F.col("epochs") - F.col("whole")) * F.col("n_tokens")).cast("long"))
    blocks = F.floor((F.col("n_docs") - 1) / BLOCK)
    read = cut(read.withColumn("digits", F.when(blocks > 0, F.length(F.hex(blocks))).otherwise(0).cast("int")))
    few = read.count() <= max_broadcast
    cutting = read.where("rest > 0").select("source", "digits", "rest", (F.col("whole") + 1).alias("epoch"))
    mine = thin.join(F.broadcast(cutting) if few else cutting, "source").withColumn("block", _block(F.col("digits")))
    sums = mine.groupBy("source", "epoch", "rest", "block").agg(F.sum("n_tokens").alias("n"))
    # first the group of blocks in which the budget ends, then the block in it: the last that starts within the budget
    keyed = sums.withColumn("block_key", _block_key(F.col("epoch"))).withColumn("top", F.substring("block_key", 1, 2))
    keyed = cut(keyed.select("source", "rest", "block", "block_key", "top", "n"))
    tops = keyed.groupBy("source", "rest", "top").agg(F.sum("n").alias("n"))
    earlier = lambda key: Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    started = tops.withColumn("before", F.coalesce(F.sum("n").over(earlier("top")), F.lit(0))).where("before < rest")
    last_top = started.groupBy("source").agg(F.max(F.struct("top", "before")).alias("m")).select("source", "m.top", F.col("m.before").alias("top_before"))
    placed = keyed.join(F.broadcast(last_top) if few else last_top, ["source", "top"]).withColumn("before", F.col("top_before") + F.coalesce(F.sum("n").over(earlier("block_key")), F.lit(0)))
    ends = placed.where("before < rest").groupBy("source").agg(F.max(F.struct("block_key", "before", "block")).alias("m")).select("source", "m.block_key", "m.before", "m.block")
    ends = cut(ends)
    inner = mine.join(F.broadcast(ends) if few else ends, ["source", "block"]).withColumn("doc_key", _doc_key(F.col("epoch")))
    inner = inner.groupBy("source", "rest", "block_key", "before", "doc_key").agg(F.sum("n_tokens").alias("n_tokens"))
    within = Window.partitionBy("source").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, -1)
    last = inner.withColumn("used", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("used < rest").groupBy("source", "block_key").agg(F.max("doc_key").alias("last_doc"))
    return cut(read.join(last, "source", "left").select("source", "weight", "epochs", "whole", "digits", F.col("block_key").alias("last_block"), "last_doc"))


def mixed(docs: DataFrame, plan: DataFrame, row: list[Column], max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(row, weight, place, source, block, epoch): the columns ``row`` of each document once for every epoch that reads it.

    A document of a partial epoch is read if its place in the permutation is
    not after the plan's last one.
    """
    few = plan.count() <= max_broadcast
    held = docs.select(F.struct(*row).alias("row"), place_of(F.col("doc_id"), F.col("text")).alias("place"), source_of(F.col("source")).alias("source"))
    told = held.join(F.broadcast(plan) if few else plan, "source").withColumn("block", _block(F.col("digits")))
    part = F.col("whole") + 1
    block_key, doc_key = _block_key(part), _doc_key(part)
    reads = (block_key < F.col("last_block")) | ((block_key == F.col("last_block")) & (doc_key <= F.col("last_doc")))
    times = F.col("whole") + F.when(F.col("last_doc").isNotNull() & reads, 1).otherwise(0)
    return told.withColumn("times", times).where("times > 0").select("row", "weight", "place", "source", "block", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"))


def mix(docs: DataFrame, max_broadcast: int = MAX_BROADCAST, **how) -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block and the keys that order the epoch: by block_key, then doc_key."""
    chosen = mixed(docs, mixing_plan(docs, max_broadcast=max_broadcast, **how), [F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("n_tokens")], max_broadcast)
    return chosen.select("row.doc_id", "source", "row.n_tokens", "weight", "epoch", _block_key(F.col("epoch")).alias("block_key"), _doc_key(F.col("epoch")).alias("doc_key"))


def resampled(docs: DataFrame, max_broadcast: int = MAX_BROADCAST, **how) -> DataFrame:
    """The rows of ``docs``, columns as they were, as often as the mixture reads them."""
    plan = mixing_plan(docs, max_broadcast=max_broadcast, **how)
    return mixed(docs, plan, [F.col(f"`{c}`") for c in docs.columns], max_broadcast).select("row.*")


#: The same for max_repetition 2 and the corpus' own size as budget.
ORACLE = r"""
WITH RECURSIVE thin AS (
  SELECT doc_id, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS place, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS BIGINT) AS n_tokens FROM documents),
src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t, count(*) AS n_docs FROM thin GROUP BY source),
tot AS (SELECT CAST(sum(t) AS DOUBLE) AS total FROM src),
ps AS (SELECT list(CAST(t AS DOUBLE) / total ORDER BY t) AS p FROM src, tot WHERE t > 0),
bis(i, lo, hi, p) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), p FROM ps
  UNION ALL
  SELECT i + 1, CASE WHEN high THEN mid ELSE lo END, CASE WHEN high THEN hi ELSE mid END, p FROM (
    SELECT i, lo, hi, p, mid, pow(list_min(p), mid - 1) / list_sum(list_transform(p, lambda x: pow(x, mid))) > 2.0 AS high
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE i < 50))),
alpha AS (SELECT round(hi, 6) AS a, list_sum(list_transform(p, lambda x: pow(x, round(hi, 6)))) AS z FROM bis WHERE i = 50),
w AS (SELECT source, t, n_docs, CASE WHEN t > 0 THEN round(pow(t / total, a) / z, 9) ELSE 0.0 END AS weight, total FROM src, tot, alpha),
e AS (SELECT *, CASE WHEN weight > 0 THEN round(weight * total / t, 6) ELSE 1.0 END AS epochs FROM w),
r AS (
  SELECT source, weight, CAST(floor(epochs) AS INTEGER) AS whole, CAST(round((epochs - floor(epochs)) * t) AS BIGINT) AS rest,
    CASE WHEN (n_docs - 1) // 256 > 0 THEN length(printf('%x', (n_docs - 1) // 256)) ELSE 0 END AS digits FROM e),
d AS (SELECT thin.*, weight, whole, rest, substr(place, 1, CAST(digits AS INTEGER)) AS block FROM thin JOIN r USING (source)),
x AS (
  SELECT *, md5(concat(epoch, ':', source, ':', block)) AS block_key, md5(concat(epoch, ':', place)) AS doc_key
  FROM (SELECT *, unnest(generate_series(1, whole + 1)) AS epoch FROM d)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block_key, doc_key GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM x)
SELECT doc_id, source, n_tokens, CAST(weight AS DOUBLE) AS weight, CAST(epoch AS INTEGER) AS epoch, block_key, doc_key FROM o WHERE epoch <= whole OR used < rest
"""
