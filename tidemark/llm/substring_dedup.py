"""Substring deduplication by hashing lines and the pieces of them.

Every line with words is a unit, and so is every sentence of at least
``min_words`` words of a line that holds several.  A sentence of more than
``LONG`` words is cut once more, after words whose own hash says so, and its
pieces are units as sentences are: a passage is found though it begins within
a sentence or the sentence differs elsewhere.  A shorter sentence or piece is a
unit only together with the one before it or the one after it.

Units are normalised and hashed to 96 bits (of 10**13 units two differ and meet
with a chance of one in a thousand), digests are grouped over the whole
corpus, and all but the earliest occurrence (by doc_id, then place in the text)
are removed.  Spans that lie within or across each other become disjoint.
Offsets refer to the original text throughout.

Digests shared by many documents are counted before the shuffle, and the join
that finds the units to remove meets a table of one row per repeated digest,
so a line that stands in every third document burdens no single task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, documents, portions, stored

#: Words a sentence or piece has at least to be a unit by itself.
MIN_WORDS = 8
#: Sentences of more words are cut after one word in PIECE, by its hash.
LONG, PIECE = 24, 12
#: Where a line is cut into sentences.
SENTENCE_END = re.compile(r"(?<=[.!?])(?=\s)")
_WORD = re.compile(r"\S+")

_UNIT = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("again", pa.bool_())])


def normal(words: list[str]) -> str:
    """The form in which units are compared: lower case, single spaces."""
    return " ".join(words).lower()


def _pieces(start: int, sentence: str) -> list[tuple[int, int, list[str]]]:
    """(start, stop, words) of the pieces of a long sentence that begins at ``start``."""
    out, first, words = [], None, []
    for m in _WORD.finditer(sentence):
        first = m.start() if first is None else first
        words.append(m[0])
        if zlib.crc32(m[0].lower().encode()) % PIECE == 0:
            out.append((start + first, start + m.end(), words))
            first, words = None, []
    if words:
        out.append((start + first, start + len(sentence.rstrip()), words))
    return out


def _units(parts: list[tuple[int, int, list[str]]], min_words: int) -> Iterator[tuple[int, int, str]]:
    """The units that adjacent parts of a line or sentence make."""
    if len(parts) > 1:
        for start, stop, own in parts:
            if len(own) >= min_words:
                yield start, stop, normal(own)
    if len(parts) > 2:
        for (start, _, own), (_, stop, after) in zip(parts, parts[1:]):
            if min(len(own), len(after)) < min_words:
                yield start, stop, normal(own + after)


def spans(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, stop, normal form) of each unit; a line comes before its sentences, these before their pieces."""
    at = 0
    for line in text.split("\n"):
        words = line.split()
        if words:
            first = at + len(line) - len(line.lstrip())
            yield first, at + len(line.rstrip()), normal(words)
            if len(words) > min_words:
                sentences, long, place = [], [], at
                for s in SENTENCE_END.split(line):
                    own = s.split()
                    if own:
                        sentences.append((place + len(s) - len(s.lstrip()), place + len(s.rstrip()), own))
                        if len(own) > LONG:
                            long.append((place, s))
                    place += len(s)
                yield from _units(sentences, min_words)
                for place, s in long:
                    yield from _units(_pieces(place, s), min_words)
        at += len(line) + 1


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, start, stop, h1, h2, again): ``again`` if the same unit stands earlier in the text, of which version is a hash."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_128_digest
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, version, text in (row for lists in portions(batch["doc_id"], batch["version"], batch["text"]) for row in zip(*lists)):
                seen: set[bytes] = set()
                for start, stop, form in spans(text, min_words):
                    h = hashed(form.encode())
                    rows.append((doc_id, version, start, stop, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:12], "big", signed=True), h in seen))
                    seen.add(h)
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _UNIT)], schema=_UNIT)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _UNIT)], schema=_UNIT)

    return documents(docs).withColumn("version", F.xxhash64("text")).select("doc_id", "version", "text").mapInArrow(run, "doc_id long, version long, start long, stop long, h1 long, h2 int, again boolean")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, stop, first_doc_id, version): the disjoint spans to remove, by original offsets in code points.

    A unit goes if a document of smaller id, or the same text earlier, holds
    it.  Rows that share a doc_id count as one document and keep each other's
    first units; ``version``, a hash of the text, tells which of them a span is
    of, and rows alike in both get their spans once.  In rows without a doc_id
    only repeats within the text go.  Null and empty texts have no units, long
    ones no other treatment; an empty table gives none, and other columns,
    whatever their names, play no part.
    """
    found = stored(units(docs, min_words), "units")
    firsts = cut(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first_doc_id"))
    gone = found.join(firsts, ["h1", "h2"]).where("again or doc_id > first_doc_id")
    once = gone.groupBy("doc_id", "version", "start", "stop").agg(F.min("first_doc_id").alias("first_doc_id"))
    before = Window.partitionBy("doc_id", "version").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = once.withColumn("reached", reached).where("stop > reached")
    return fresh.select("doc_id", F.greatest("start", "reached").alias("start"), "stop", "first_doc_id", "version")


def cleaned(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, text without the removed spans, and kept: the original (start, stop) of every piece that stayed.

    ``removed`` is what ``repeated_spans`` has found in ``docs``.  Every row
    stays, with an empty text if nothing of it is left.
    """
    grouped = removed.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    own = documents(docs).withColumn("version", F.xxhash64("text"))
    own = own.join(grouped, own["doc_id"].eqNullSafe(grouped["d"]) & (own["version"] == grouped["v"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lists, whole in portions(batch["doc_id"], batch["gone"], batch["text"]):
                texts, kept = [], []
                for text, gone in zip(whole, lists):
                    pieces, at = [], 0
                    for span in gone or []:
                        if span["start"] > at:
                            pieces.append((at, span["start"]))
                        at = span["stop"]
                    if at < len(text):
                        pieces.append((at, len(text)))
                    texts.append("".join(text[a:b] for a, b in pieces))
                    kept.append([{"start": a, "stop": b} for a, b in pieces])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(texts, pa.string()), pa.array(kept, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["doc_id", "text", "kept"])

    return own.select("doc_id", "gone", "text").mapInArrow(run, "doc_id long, text string, kept array<struct<start: long, stop: long>>")
