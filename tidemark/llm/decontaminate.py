"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

Benchmark items are cut into windows of consecutive words; a document is
contaminated where it holds a whole window.  For exact containment the prefix
of a window, its words in order of rarity, is one word long: a document that
holds the window holds its rarest word.  So documents join windows on that
word, each meeting fixes where in the document the window would start, and the
pair survives if

* the window lies within the document (positional bounds, from the offset of
  the rare word in the window and the length of both), and
* the document's words there are the window's, in order (verification).

The documents' words are never shuffled: windows are broadcast after their
number has been checked, and only verified occurrences travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, cut, documents

#: What separates words once A-Z are lower-cased: ASCII other than digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Above so many windows, each counted once per item, the join is an ordinary shuffle join instead of a broadcast.
MAX_BROADCAST = 200_000


def words_of(text: Column) -> Column:
    """Words: runs of characters other than the separators, A-Z lower-cased; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window): each run of ``size`` words of an item, or the whole of a shorter item with words."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1))))
    return items.select("item_id", "w", starts.alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("window")).distinct()


def _prefixed(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(rare, offset, window): each distinct window under its rarest word in ``docs``, ties to the smaller word."""
    one = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    vocabulary = one.select("word").distinct()
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    counted = one.join(cut(seen), "word", "left")
    return counted.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("m")).select(F.col("m.word").alias("rare"), F.col("m.offset").alias("offset"), "window")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted item ids as strings).

    n_hit counts the words inside any occurrence of any window.  Null and empty
    texts have no words and no hits; an empty benchmark hits nothing; items
    without words play no part.  Rows are told apart by doc_id and text, so
    repeated rows get equal results and one row each.
    """
    per_text = contaminated_texts(docs, benchmark, size, id_col, text_col, item_col, max_broadcast)
    return per_text.select("doc_id", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """As ``contaminated``, one row for each doc_id and ``version`` (a hash of the text), with its ``copies``."""
    own = documents(docs, id_col, text_col)
    windows = cut(item_windows(benchmark, size, item_col))
    # links of windows to items, so both what is broadcast of windows and of items is bounded
    small = windows.count() <= max_broadcast
    found = cut(_prefixed(own, windows) if small else _prefixed_large(own, windows))
    # an empty word after the last marks the end of each document, so that one pass gives lengths too
    end = found.sparkSession.createDataFrame([("", 0, [])], "rare string, offset int, window array<string>")
    probe = found.union(end)
    words = own.select("doc_id", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("words"))
    spread = words.select("doc_id", "version", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("at", "word")).withColumn("n", F.size("words"))
    if small:
        # rows are verified where they arise, so every word can refer to its whole document
        spread = spread.withColumn("first", F.lit(0))
    else:
        # rows travel: each takes along only the words that a window around it can reach
        first = F.greatest(F.col("at") - F.lit(size - 1), F.lit(0))
        spread = spread.withColumn("first", first).withColumn("words", F.slice("words", F.col("first") + 1, F.lit(2 * size - 1)))
    met = spread.join(F.broadcast(probe) if small else probe, F.col("word") == F.col("rare"))
    start = F.col("at") - F.col("offset")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.col("n"))
    holds = F.when(inside, F.slice("words", F.greatest(start - F.col("first"), F.lit(0)) + 1, length) == F.col("window"))
    hits = met.where(holds).select("doc_id", "version", start.alias("start"), F.when(length > 0, start + length).alias("stop"), F.when(length > 0, F.col("window")).alias("window"))
    met_items = windows.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    named = hits.join(F.broadcast(met_items) if small else met_items, "window", "left")
    # furthest stop for each start; the end mark has none and counts the rows that share id and text
    ends = named.groupBy("doc_id", "version", "start").agg(F.max("stop").alias("stop"), F.count_if(F.col("stop").isNull()).alias("copies"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    before = Window.partitionBy("doc_id", "version").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))), F.lit(0))
    counted = ends.select("doc_id", "version", "start", "copies", "items", F.when(F.col("stop").isNotNull(), fresh).otherwise(0).alias("fresh"))
    return counted.groupBy("doc_id", "version").agg(
        F.max("start").cast("long").alias("n_words"), F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("copies").alias("copies")
    )

def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs``, columns as they were, that hold no window of the benchmark.

    Rows are judged by doc_id and text, so one of several texts of a doc_id, or
    of none, goes alone.  Null and empty texts stay, as do empty tables, and an
    empty benchmark drops nothing; columns of any other name play no part.
    """
    dirty = cut(contaminated_texts(docs, benchmark, size).where("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_version"))
    return held.join(dirty, held["_id"].eqNullSafe(dirty["_d"]) & (held["_version"] == dirty["_v"]), "left_anti").select("row.*")


def _prefixed_large(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """As ``_prefixed``, for a vocabulary that must not be broadcast."""
    one = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    seen = cut(docs.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    counted = one.join(seen, "word", "left")
    return counted.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("m")).select(F.col("m.word").alias("rare"), F.col("m.offset").alias("offset"), "window")


def digests(result: DataFrame) -> DataFrame:
    """The contract columns from the operator's result."""
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same in DuckDB, by a plain scan of all windows per document word position.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
cand AS (
  SELECT rid, n, s, w[s:s + n - 1] AS win FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT c.rid, c.s, c.n, win.item_id FROM cand c JOIN win ON win.win = c.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY rid),
ite AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(ite.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ite.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.rid = d.rid LEFT JOIN ite ON ite.rid = d.rid
"""
