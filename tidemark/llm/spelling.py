r"""Grouping of spelling variants by forward and backward minimal acyclic automata.

Words of the corpus are counted; two are near if one inserted, deleted or
replaced code point makes one of the other.  Of two near words ``w`` and ``x``
the error lies either in the second half of ``w``, and ``x`` begins with its
first half, or in the first half, and ``x`` ends with its second half.  So ``w``
is looked up twice: in an automaton of words, walked along its first half
exactly and completed with one error, and in an automaton of reversed words,
walked along its reversed second half.  Automata are minimal (Daciuk et al.,
"Incremental Construction of Minimal Acyclic Finite-State Automata") and number
their words by perfect hashing, so the count of a word found is one array
access.  Pairs that both ways find are kept from the forward one.

Words that can meet share the half that is matched, so rows are dealt by it: a
word stands once under each half that a near word may ask for (two in either
direction, as near words differ by at most one in length).  Halves are dealt
into buckets of about ``target`` rows, each with an automaton of its own; a half
that fills a bucket by itself is split: its words are dealt out over shards and
its queries go to every shard, so no link is lost and no automaton outgrows its
bound.

A word's form is its most frequent near word (ties: the smallest in code-point
order) if that one is ``ratio`` times as frequent; its root is the end of the
chain of forms.  Chains grow in frequency by ``ratio`` at every step, so doubling
of pointers ends after a few rounds.

Cases: null and empty texts have no words; a null doc_id counts as the empty
string in the planted errors.  Very long texts and words are read whole.
Repeated rows count each.  An empty table gives no rows, and columns of any other
name play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, claim, cut, documents, scratch

#: Letters of words once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Shortest words, least occurrences, and how much more frequent a form is.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many has a code point deleted.
ERRORS = 31
#: Rows of a bucket, about: an automaton holds no more than twice as many words.
TARGET = 20_000

PAIRS = "word string, n long, near string, near_n long"


def runs(text: Column, shortest: int = MIN_LENGTH) -> Column:
    """Maximal runs of letters of ``shortest`` or more, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"[{LETTERS}]{{{shortest},}}+"), F.lit(0))


def word_counts(docs: DataFrame, shortest: int = MIN_LENGTH, least: int = MIN_COUNT, errors: int = ERRORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of ``shortest`` or more code points that occur ``least`` times or more.

    One run in ``errors``, chosen by a checksum of doc_id and run, loses a code
    point; 0 plants no errors.
    """
    one = documents(docs, id_col, text_col).select("doc_id", F.explode(runs(F.col("text"), shortest)).alias("run"))
    word = F.col("run")
    if errors:
        drawn = one.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        one = drawn.select("run", F.when(F.col("h") % errors == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run")).alias("word"))
        word = F.col("word")
    return one.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words; words are numbered from 0 in that order."""

    def __init__(self, words: Iterable[str]):
        #: per state, character to (next state, words passed over by taking it)
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self._below: list[int] = []
        known: dict[tuple, int] = {}
        # states of the last word's characters, which may still grow
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""

        def settled(state: tuple[dict[str, int], bool]) -> int:
            """The number of the one state with these transitions."""
            out, end = state
            key = (end, *out.items())
            number = known.get(key)
            if number is None:
                number = known[key] = len(self.edges)
                passed, numbered = int(end), {}
                for c, target in out.items():
                    numbered[c] = (target, passed)
                    passed += self._below[target]
                self.edges.append(numbered)
                self.ends.append(end)
                self._below.append(passed)
            return number

        def settle_to(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                path[-1][0][last[len(path) - 1]] = settled(state)

        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            settle_to(shared)
            for _ in word[shared:-1]:
                path.append(({}, False))
            path.append(({}, True))
            last = word
        settle_to(0)
        self.root = settled(path[0])

    def walked(self, text: str, state: int, number: int) -> tuple[int, int] | None:
        """The state after ``text`` and the number of words before it, or None if no word goes on so."""
        edges = self.edges
        for c in text:
            step = edges[state].get(c)
            if step is None:
                return None
            state = step[0]
            number += step[1]
        return state, number

    def one_error(self, exact: str, rest: str) -> Iterator[tuple[str, int]]:
        """Words that begin with ``exact`` and go on as ``rest`` with one error, each once, with their numbers."""
        at = self.walked(exact, self.root, 0)
        if at is None:
            return
        state, number = at
        edges, ends, walked = self.edges, self.ends, self.walked
        n = len(rest)
        for i in range(n + 1):
            here = edges[state]
            c = rest[i] if i < n else None
            # of equal letters in a row the last one is taken as deleted
            if c is not None and (i + 1 == n or rest[i + 1] != c):
                end = walked(rest[i + 1 :], state, number)
                if end and ends[end[0]]:
                    yield exact + rest[:i] + rest[i + 1 :], end[1]
            for other, (target, passed) in here.items():
                if other == c:
                    # inserted before its like it is inserted after it, and comes later
                    continue
                if c is not None:
                    end = walked(rest[i + 1 :], target, number + passed)
                    if end and ends[end[0]]:
                        yield exact + rest[:i] + other + rest[i + 1 :], end[1]
                end = walked(rest[i:], target, number + passed)
                if end and ends[end[0]]:
                    yield exact + rest[:i] + other + rest[i:], end[1]
            step = here.get(c) if c is not None else None
            if step is None:
                return
            state = step[0]
            number += step[1]


def _links_of_bucket(table: pa.Table) -> pa.Table:
    """Near pairs within one bucket of rows (backward, seq, n, known, asks): each asking row against the known ones."""
    claim("spelling")
    columns = [table[c].to_pylist() for c in ("seq", "n", "known", "asks")]
    counts = {seq: n for seq, n, known, _ in zip(*columns) if known}
    words = sorted(counts)
    numbers = [counts[w] for w in words]
    automaton = Automaton(words)
    backward = table["backward"][0].as_py()
    found: list[tuple[str, int, str, int]] = []
    for seq, n, _, asks in zip(*columns):
        if not asks:
            continue
        # the first half of a word is the shorter one
        half = (len(seq) + 1) // 2 if backward else len(seq) // 2
        first = seq[half:]
        for near, number in automaton.one_error(seq[:half], seq[half:]):
            if not backward:
                found.append((seq, n, near, numbers[number]))
            elif not near.endswith(first):
                # else the words share the first half, and the forward automaton gives the pair
                found.append((seq[::-1], n, near[::-1], numbers[number]))
    w, n, x, m = zip(*found) if found else ((), (), (), ())
    return pa.table({"word": pa.array(w, pa.string()), "n": pa.array(n, pa.int64()), "near": pa.array(x, pa.string()), "near_n": pa.array(m, pa.int64())})


def _entries(words: DataFrame) -> DataFrame:
    """Rows (backward, seq, n, half, asks): each word under the halves by which words of its length and of one more or less are matched."""
    length = F.char_length("word")
    # halves that words one shorter, as long and one longer ask for are of two lengths; the word's own asks
    odd = length % 2 == 1
    first, second = F.floor(length / 2), F.floor((length + 1) / 2)
    ways = F.array(
        *[
            F.struct(F.lit(backward).alias("backward"), seq.alias("seq"), size.cast("int").alias("size"), F.lit(asks).alias("asks"))
            for backward, seq, size, asks in (
                (False, F.col("word"), first, True),
                (False, F.col("word"), F.when(odd, first + 1).otherwise(first - 1), False),
                (True, F.reverse("word"), second, True),
                (True, F.reverse("word"), F.when(odd, second - 1).otherwise(second + 1), False),
            )
        ]
    )
    return words.select("n", F.explode(ways).alias("x")).select("x.backward", "x.seq", "n", F.substring(F.col("x.seq"), F.lit(1), F.col("x.size")).alias("half"), "x.asks")


def near_pairs(words: DataFrame, target: int = TARGET) -> DataFrame:
    """All ordered pairs of near words of ``words`` (word, n), each once: (word, n, near, near_n).

    Words are distinct and of two code points or more.
    """
    entries = _entries(words)
    sizes = cut(entries.groupBy("backward", "half").agg(F.count("*").alias("rows")))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    buckets = max(1, -(-total // target))
    # at most one half in ``target`` / 2 rows is split; such halves are few, but their number grows with the vocabulary
    hot = sizes.where(F.col("rows") > target // 2).select(F.col("backward").alias("_b"), F.col("half").alias("_h"), F.ceil(F.col("rows") / target).cast("int").alias("shards"))
    known = entries.join(hot, (F.col("backward") == F.col("_b")) & (F.col("half") == F.col("_h")), "left").drop("_b", "_h")
    own = F.when(F.col("shards").isNotNull(), F.pmod(F.xxhash64("seq"), F.col("shards")).cast("int"))
    # an asking row goes to every shard of its half and is known in its own
    spread = known.withColumn("own", own).withColumn("shard", F.explode(F.when(F.col("shards").isNotNull() & F.col("asks"), F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array("own"))))
    bucket = F.when(F.col("shards").isNull(), F.concat_ws(":", F.lit("bucket"), "backward", F.pmod(F.xxhash64("half"), F.lit(buckets)))).otherwise(F.concat_ws(":", F.lit("half"), "backward", "half", "shard"))
    rows = spread.select(bucket.alias("bucket"), "backward", "seq", "n", F.coalesce(F.col("shard") == F.col("own"), F.lit(True)).alias("known"), "asks")
    return rows.groupBy("bucket").applyInArrow(_links_of_bucket, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), an acyclic table: the end of each word's chain, by doubling of pointers."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = cut(now.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO, target: int = TARGET) -> DataFrame:
    """Per row of ``words`` (word, n): word, n, n_near, form, form_n and root."""
    path = scratch(words.sparkSession, "words")
    words.select("word", "n").write.parquet(path)
    held = words.sparkSession.read.parquet(path)
    best = near_pairs(held, target).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    near = cut(held.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best")))
    out = near.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))
    ends = roots(out.where(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: One bit of the checksum.
_STEP = "xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END)"


#: The same in DuckDB: CRC-32 from a table made of its polynomial, near words by what is left when a code point is deleted.
ORACLE = rf"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda c, z: {_STEP}) AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
once AS (SELECT id, w, count(*) AS copies, hex(encode(id || ':' || w)) AS x FROM run WHERE length(w) >= 7 GROUP BY id, w),
hashed AS (
  SELECT w, copies, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(x) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM once, tab),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, copies FROM hashed),
word AS (SELECT word, CAST(sum(copies) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(copies) >= 2),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM del a JOIN word b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM del a JOIN word b ON a.d = b.word),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pair),
best AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n FROM word w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chain AS (
  SELECT word, word AS at, form AS ahead FROM best
  UNION ALL SELECT c.word, b.word, b.form FROM chain c JOIN best b ON b.word = c.ahead)
SELECT best.word, best.n, best.n_near, best.form, best.form_n, chain.at AS root FROM best JOIN chain ON chain.word = best.word WHERE chain.ahead IS NULL
"""
