"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a row in a pivot table: its Hamming distances
to REFERENCE fingerprints, namely zero and one mask per group of adjacent
bits.  Two facts about two fingerprints that differ in at most ``d`` bits make
the table a filter without false dismissals:

* no coordinate differs by more than ``d`` (triangle inequality), and
* flipping a bit of a mask's group changes, of all masks' distances relative to
  the distance from zero, that one alone.  With the masks dealt into
  ``d + PARTS`` parts, at least PARTS parts therefore agree wholly.

Fingerprints that agree in PARTS parts of their relative coordinates meet in a
bucket (an equi-join).  Pairs in a bucket are discarded by their largest
coordinate difference and the survivors verified by exact Hamming distance.  A
bucket of more than ``max_bucket`` members emits no pairs; its members are
linked exactly, in linear work, through ball centres: two fingerprints are
within two bits of each other just if some value is within one bit of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import claim, cut, documents, portions, stored
from tidemark.operators.components import connected_components

#: Bits per pivot mask, and parts that must agree.
MASK_BITS, PARTS = 2, 3
#: Seed of the shingle hash.
SEED = 42
#: Bits for each shingle in the bitmap of a set, at least.
MARKS = 2
#: Up to so many texts to read again are told by broadcast (8 bytes each), more by a shuffle.
MAX_BROADCAST = 200_000
#: Least Jaccard similarity of the shingle sets of near copies, as a fraction.
SIMILAR = (4, 5)
#: Ratio of sizes within a class of them.
SIZE_CLASS = 1.1

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivots() -> list[int]:
    """Reference fingerprints: zero, and a mask for each group of adjacent bits."""
    return [0, *(((1 << MASK_BITS) - 1) << i for i in range(0, 64, MASK_BITS))]


def _shingles(text: str, words: int) -> np.ndarray:
    """The hashes of all word shingles of a text in their order, repeats included."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    k = min(words, len(parts))
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(parts) - k + 1].tolist()
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, len(starts))


def _simhash(h: np.ndarray) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash over all word shingles, repeats included.

    Words are runs of bytes other than space and U+0009 to U+000D after A-Z
    are lower-cased.  A text of fewer than ``words`` words is one shingle; one
    without words has fingerprint 0.  Null texts count as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for row, text in enumerate(t for (part,) in portions(batch["text"]) for t in part):
                fps[row] = _simhash(_shingles(text, words))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """One row per fingerprint: its distances to all pivots, in their order."""
    return np.bitwise_count(fps[:, None] ^ np.array(pivots(), np.uint64)[None, :]).astype(np.int8)


def pivot_table(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, fp, members) with ``d``, the distances of the fingerprint to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            d = pivot_distances(batch["fp"].to_numpy().view(np.uint64))
            ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("bucket", "fp", "members")), pa.ListArray.from_arrays(ends, pa.array(d.reshape(-1)))], names=["bucket", "fp", "members", "d"])

    return rows.select("bucket", "fp", "members").mapInArrow(run, "bucket long, fp long, members long, d array<tinyint>")


def _buckets(fps: DataFrame, bits: int) -> DataFrame:
    """(bucket, fp): for every choice of PARTS of the parts of the pivots, the agreeing coordinates packed in one number."""
    n = len(pivots()) - 1
    parts = [list(range(i, n, bits + PARTS)) for i in range(bits + PARTS)]
    choices = [sorted(i for part in chosen for i in part) for chosen in combinations(parts, PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            fp = batch["fp"].to_numpy()
            d = pivot_distances(fp.view(np.uint64)).astype(np.int64)
            under = (MASK_BITS + d[:, :1] - d[:, 1:]) // 2  # the set bits under each mask
            keys = [(under[:, used] << (2 * np.arange(len(used)))).sum(axis=1) + (number << 50) for number, used in enumerate(choices)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fp, len(choices)))], names=["bucket", "fp"])

    return fps.select("fp").mapInArrow(run, "bucket long, fp long")


def links(fps: DataFrame, bits: int = 2, max_bucket: int = 64) -> DataFrame:
    """Links (a, b) whose closure joins just the distinct fingerprints of ``fps`` within ``bits`` (at most 2) bits.

    Pairs of small buckets are listed as they are; in a large bucket the
    members within one bit of a common value are tied to their smallest.
    """
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    buckets = _buckets(fps, bits)
    counts = cut(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    met = cut(buckets.join(counts, "bucket"))
    few = cut(pivot_table(met.where(F.col("members") <= max_bucket)))
    left, right = few.select("bucket", F.col("fp").alias("a"), F.col("d").alias("da")), few.select("bucket", F.col("fp").alias("b"), F.col("d").alias("db"))
    apart = F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x - y)))
    pairs = left.join(right, "bucket").where("a < b").where(apart <= bits).where(distance(F.col("a"), F.col("b")) <= bits).select("a", "b")
    many = met.where(F.col("members") > max_bucket).select("fp").distinct()
    if bits == 2:
        ball = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
        near = many.select("fp", F.explode(ball).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("centre"))
        first = cut(near.groupBy("centre").agg(F.min("fp").alias("least"), F.count("*").alias("members")).where("members > 1").select("centre", "least"))
        tied = near.join(first, "centre").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    else:
        flips = F.array(*[F.lit(_signed(1 << i)) for i in range(64)])
        other = many.select(F.col("fp").alias("b"))
        tied = many.select(F.col("fp").alias("a"), F.explode(flips).alias("bit")).select("a", F.col("a").bitwiseXOR(F.col("bit")).alias("b")).join(other, "b").select("a", "b")
    return pairs.union(tied).distinct()


def simhash_components(docs: DataFrame, words: int = 3, bits: int = 2, max_bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own
    included.  Equal fingerprints count as one node, so copies add no links.
    Rows without a doc_id keep their fingerprint and take the component of
    their equals (null if these have no doc_id either).
    """
    fps = cut(fingerprints(docs, words))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(nodes.select("fp"), bits, max_bucket))
    rooted = cut(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    names = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut(rooted.join(names, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _set_table(rows: DataFrame, words: int, common: np.ndarray, whole: bool) -> DataFrame:
    """(doc_id, version, node, fp, size, marks, shingles) of (doc_id, text, version) rows.

    node is a hash of the shingle set, marks a bitmap with a bit set for every
    shingle, of the power of two of bits that is MARKS times the set or more.  Shingles stand in one order for all
    documents, ``common`` ones last; unless ``whole`` only the prefix is given
    of which a set similar enough must hold a member.
    """
    import xxhash

    p, q = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            for ids, versions, texts in portions(batch["doc_id"], batch["version"], batch["text"]):
                nodes, fps, sizes, marks, held = [], [], [], [], []
                for text in texts:
                    h = _shingles(text, words)
                    u = np.unique(h)
                    nodes.append(_signed(xxhash.xxh3_64_intdigest(u.tobytes())))
                    fps.append(_signed(int(_simhash(h))))
                    sizes.append(len(u))
                    marked = np.zeros(max(64, 1 << (MARKS * len(u)).bit_length()), bool)
                    marked[(u >> np.uint64(32)) % np.uint64(len(marked))] = True
                    marks.append(np.packbits(marked).view(np.int64))
                    if len(common):
                        last = common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u
                        u = np.concatenate([u[~last], u[last]])
                    held.append((u if whole else u[: len(u) + (-p * len(u)) // q + 1]).view(np.int64))
                ends = pa.array(np.cumsum([0, *map(len, held)], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held)))
                columns = [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64())), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "node", "fp", "size", "marks", "shingles"])

    return rows.mapInArrow(run, "doc_id long, version long, node long, fp long, size long, marks array<long>, shingles array<long>")


def _common(rows: DataFrame, words: int, one_in: int = 32, least: int = 3, limit: int = 50_000) -> np.ndarray:
    """Shingles of many documents, found in a part of them.  Any choice gives the same near copies; a good one gives small buckets."""
    part = rows.where(F.pmod("version", F.lit(one_in)) == 0)
    held = _set_table(part, words, np.zeros(0, np.uint64), whole=True).select(F.explode("shingles").alias("s"))
    top = held.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "s").limit(limit)
    return np.sort(np.array([r.s for r in top.collect()], np.int64).view(np.uint64))


def _verified(rows: DataFrame, words: int, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar enough.

    A mark of one set that the other lacks stands for a shingle at least that
    they do not share; pairs that the marks rule out go before sets are fetched.
    """
    p, q = SIMILAR
    marks = lambda end: nodes.select(F.col("node").alias(end), F.col("size").alias(f"n{end}"), F.col("marks").alias(f"m{end}"))
    lacking = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: F.bit_count(s.bitwiseAND(F.bitwise_not(t)))), F.lit(0), lambda n, k: n + k)
    most = F.least(F.col("na") - lacking("ma", "mb"), F.col("nb") - lacking("mb", "ma"))
    marked = pairs.distinct().join(marks("a"), "a").join(marks("b"), "b").where(F.least("na", "nb") * q >= F.greatest("na", "nb") * p)
    # sets of like sizes have bitmaps of one length, or one of the double, whose halves then lie over each other
    for one, other in (("ma", "mb"), ("mb", "ma")):
        half = F.shiftright(F.size(one), 1)
        folded = F.zip_with(F.slice(one, F.lit(1), F.greatest(half, F.lit(1))), F.slice(one, F.greatest(half, F.lit(1)) + 1, F.greatest(half, F.lit(1))), lambda s, t: s.bitwiseOR(t))
        marked = marked.withColumn(one, F.when(F.size(one) > F.size(other), folded).otherwise(F.col(one)))
    pairs = cut(marked.where(most * (p + q) >= (F.col("na") + F.col("nb")) * p).select("a", "b"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # one text of each node is read again, so that sets are kept for those alone that meet another
    versions = cut(ends.join(nodes, "node").select("version").distinct())
    few = versions.count() <= MAX_BROADCAST
    texts = rows.join(F.broadcast(versions) if few else versions, "version", "left_semi").select("doc_id", "text", "version")
    sets = cut(_set_table(texts, words, np.zeros(0, np.uint64), whole=True).select("node", "shingles").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return cut(both.where(shared * (p + q) >= (F.size("sa") + F.size("sb")) * p).select("a", "b"))


def _may_match(a: str, b: str) -> Column:
    """Whether sets that meet at their places ``at`` can be similar enough: by size, and by what follows the first shared shingle."""
    p, q = SIMILAR
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    left = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (F.least(n, m) * q >= F.greatest(n, m) * p) & (left * (p + q) >= (n + m) * p)


def _met_by_size(entries: DataFrame) -> DataFrame:
    """Pairs l, r of entries (node, size, at, root) of a shingle that sizes and the smaller set's place allow, each once.

    The smaller set of a pair asks: its place tells how large a partner can be,
    and sets of no more than that are met by classes of size.  Sets whose
    shared shingle comes late, as that of a form many documents have in common,
    can have no partner of their size or more, and ask for none.
    """
    p, q = SIMILAR
    size, left = F.col("size"), F.col("size") - F.col("at")
    largest = F.least(size * q / p, left * (p + q) / p - size)
    class_of = lambda x: F.floor(F.log(x.cast("double")) / math.log(SIZE_CLASS) + 1e-9)
    held = F.struct("node", "size", "at", "root")
    asks = entries.where(largest >= size).select("shingle", held.alias("l"), F.explode(F.sequence(class_of(size), class_of(largest + 0.5))).alias("class"))
    met = asks.join(entries.select("shingle", held.alias("r"), class_of(size).alias("class")), ["shingle", "class"])
    return met.where((F.col("l.size") < F.col("r.size")) | ((F.col("l.size") == F.col("r.size")) & (F.col("l.node") < F.col("r.node"))))


def near_groups(docs: DataFrame, words: int = 5, bits: int = 2, max_bucket: int = 64) -> DataFrame:
    """(doc_id, version, root) for every row: groups linked by a Jaccard similarity of SIMILAR or more of the shingle sets.

    version is a hash of the text, root one of the group's set hashes.  No
    radius of 64-bit fingerprints is both narrow enough to be a filter and
    wide enough for such pairs (those at 0.8 differ in some ten bits), so
    SimHash links only go first.  All other pairs come from an exact
    prefix-filtered set join: of two similar sets each holds a shingle of the
    other's prefix, a fifth of the set in an order that puts rare ones first.
    Every link is verified on the whole sets.

    In each bucket all are first held against one member, the one with the
    fewest rarer shingles: an original rather than one of its edited copies.
    Pairs are listed only where several groups are left, and only if what
    follows their first shared shingle can still make them similar enough; for
    a large group of edited copies that leaves next to none, since an edit
    moves the shared shingles back in the order.
    """
    rows = documents(docs).withColumn("version", F.xxhash64("text"))
    common = _common(rows, words)
    found = cut(_set_table(rows, words, common, whole=False))
    nodes = cut(found.groupBy("node").agg(F.min("fp").alias("fp"), F.min("version").alias("version"), F.min("size").alias("size"), F.any_value("marks").alias("marks")))
    # place and size travel as one number
    entries = found.select("node", "size", F.posexplode("shingles").alias("at", "shingle")).select("shingle", "node", (F.shiftleft("size", 32) + F.col("at")).alias("place"))
    # most shingles stand in the prefixes of one set only; what goes on is the entries of the others
    shared = cut(entries.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("shingle"))
    met = entries.join(shared, "shingle").groupBy("shingle", "node").agg(F.min("place").alias("place"))
    met = stored(met.select("shingle", "node", F.shiftright("place", 32).alias("size"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("at")), "met")
    centres = cut(met.groupBy("shingle").agg(F.min(F.struct("at", "node", "size")).alias("c")))
    star = met.select("shingle", F.struct("node", "size", "at").alias("l")).join(centres, "shingle").where("l.node <> c.node").where(_may_match("l", "c"))
    # of the centres that a set meets it is held against the one it meets most often
    star = star.groupBy(F.col("l.node").alias("x"), F.col("c.node").alias("y")).agg(F.count("*").alias("n")).groupBy("x").agg(F.max(F.struct("n", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
    by_fp = cut(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    close = links(by_fp.select("fp"), bits, max_bucket)
    close = close.join(by_fp.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    same = nodes.join(by_fp, "fp").where("node <> least").select(F.col("least").alias("x"), F.col("node").alias("y"))
    proposed = star.union(close).union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    tied = _verified(rows, words, nodes, proposed)
    roots = cut(connected_components(tied))
    placed = stored(met.join(roots, "node", "left").select("shingle", "node", "size", "at", F.coalesce("root", "node").alias("root")), "placed")
    parted = cut(placed.groupBy("shingle").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("shingle"))
    open_ = cut(placed.join(parted, "shingle"))
    both = _met_by_size(open_).where("l.root <> r.root").where(_may_match("l", "r"))
    # all that the prefixes share up to the last place that passed, and no more than what follows it
    most = F.count("*") + F.least(F.max(F.col("l.size") - 1) - F.max("l.at"), F.max(F.col("r.size") - 1) - F.max("r.at"))
    bounds = both.groupBy(F.col("l.node").alias("a"), F.col("r.node").alias("b")).agg(most.alias("most"), F.max(F.col("l.size") + F.col("r.size")).alias("sizes"))
    rest = bounds.where(F.col("most") * sum(SIMILAR) >= F.col("sizes") * SIMILAR[0]).select("a", "b")
    tied = tied.union(_verified(rows, words, nodes, rest))
    roots = cut(connected_components(tied))
    rooted = cut(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    return found.select("doc_id", "version", "node").join(rooted, "node").select("doc_id", "version", "root")


def near_copies(docs: DataFrame, words: int = 5, bits: int = 2, max_bucket: int = 64) -> DataFrame:
    """(doc_id, component_id) for every row: the groups of ``near_groups`` named by their smallest doc_id, null if they have none."""
    found = cut(near_groups(docs, words, bits, max_bucket))
    names = cut(found.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return found.join(names, "root").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, words: int = 5, bits: int = 2, max_bucket: int = 64) -> DataFrame:
    """The rows of ``docs``, columns as they were, one of each near-copy group: that of the smallest doc_id.

    Rows without a doc_id yield to those with one; among rows that share a
    doc_id the text of the smallest hash stays, and of rows that share both,
    one (any of them).  Null and empty texts are one group.  An empty table
    stays empty, and columns of any other name play no part.  Texts are not
    shuffled unless the rows to drop are many.
    """
    found = cut(near_groups(docs, words, bits, max_bucket).groupBy("root", "doc_id", "version").agg(F.count("*").alias("copies")))
    kept = cut(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("k")).select("root", "k.doc_id", "k.version"))
    drop = cut(found.join(kept.select("root", F.col("doc_id").alias("d"), F.col("version").alias("v")), "root").where("not (doc_id <=> d and version = v)").select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")))
    several = cut(found.where("copies > 1").join(kept.select("root", F.col("doc_id").alias("d"), F.col("version").alias("v")), "root").where("doc_id <=> d and version = v").select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_version"))
    is_one = lambda t: held["_id"].eqNullSafe(t["_d"]) & (held["_version"] == t["_v"])
    repeated = held.join(several, is_one(several), "left_semi").groupBy("_id", "_version").agg(F.any_value("row").alias("row")).select("row.*")
    others = drop.union(several)
    return held.join(others, held["_id"].eqNullSafe(others["_d"]) & (held["_version"] == others["_v"]), "left_anti").select("row.*").union(repeated)
