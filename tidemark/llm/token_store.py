"""Token-id output as a content-addressed store.

Documents become id streams, a rolling hash over the ids cuts each stream into
chunks, every distinct chunk is stored once under its digest, a recipe per
document lists its chunks, and Merkle roots over the recipes make what is read
back verifiable.

File format (all tables are written by Spark in one folder)

``objects/kind=chunk``  digest (16 bytes, BLAKE2b of the ids as little-endian
                        unsigned 32-bit integers), n_ids, payload (the ids,
                        little-endian; 2 bytes each where the vocabulary fits,
                        else 4, named in ``width``)
``objects/kind=recipe`` doc_id, digests in order with the CRC-32 and number of
                        ids of each chunk, n_tokens, root
``recipes``             the same recipes in ascending doc_id order, each with
                        ``start``, the number of ids before it
``manifest``            one row per recipe file with the Merkle root over its
                        documents' roots

Chunks never cross documents.  One encoding pass feeds one shuffle: chunk rows
travel by digest (each task sends a digest once, so a passage shared by a third
of all documents adds a row per task, not per document), recipe rows by
document.  On reading, every chunk is held against its digest, and every distinct
statement of a recipe about a chunk (digest, CRC-32, ids) against what the chunk
holds; then the CRC-32 of a document follows from its own recipe, without a
shuffle of documents.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import claim, cut, documents, scratch

#: Chunk lengths in ids.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 64, 256, 1024
#: Ids under the rolling window, and its odd multiplier modulo 2**64.
WINDOW, BASE = 16, 0x9E3779B97F4A7C15
#: Digests a task remembers having sent.
SENT = 500_000
#: Words that a process remembers, the bytes these may take, and the longest word kept.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 800_000, 96 << 20, 64
#: Bytes of text that are split at a time, about; a longer text goes alone.
PORTION = 8 << 20
#: A sign after a word, which the tokenizer takes as a pre-token of its own.
SIGNS = ".,;:!?"
#: Letters and numbers below U+02B0, where lower-casing keeps lengths and nothing composes; U+0130 is left out.
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ʯ", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Words with other characters, odd white space or special strings go to the library as they are.
NOT_PLAIN = re.compile(r"[^\t\n\r -~\xa1-įı-ʯ]|<\|")
#: The same as Arrow reads it, to find the texts that hold such words.
NOT_PLAIN_ARROW = r"[^\t\n\r -~\x{a1}-\x{12f}\x{131}-\x{2af}]|<\|"
#: White space that no normalisation carries a character across.
BETWEEN = re.compile(r"[\t\n\r ]+")
#: The pre-tokens of the tokenizer in a plain word: contractions, letters, single digits, other signs.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


class Memory:
    """A dictionary of two generations, bounded in entries and bytes: what is used again outlives the rest, long words are not kept."""

    def __init__(self, most: int, most_bytes: int | None = None) -> None:
        self.most, self.most_bytes = most, REMEMBERED_BYTES if most_bytes is None else most_bytes
        self.recent, self.older, self.held = {}, {}, 0

    def _turn(self) -> None:
        if len(self.recent) > self.most or self.held > self.most_bytes:
            self.older, self.recent, self.held = self.recent, {}, 0

    def found(self, wanted: list[str]) -> tuple[list, list[int]]:
        """What is known of each of ``wanted``, and the places of those of which nothing is."""
        self._turn()
        known, older, missed, again = list(map(self.recent.get, wanted)), self.older, [], {}
        for i in [i for i, x in enumerate(known) if x is None]:
            known[i] = older.get(wanted[i])
            if known[i] is None:
                missed.append(i)
            else:
                again[wanted[i]] = known[i]
        self.keep(again)
        return known, missed

    def keep(self, new: dict) -> None:
        """Remember ``new``, but for words longer than LONGEST."""
        # a string and a packed value take some 50 bytes more than they hold, an entry of the table about 100
        fit = {w: x for w, x in new.items() if len(w) <= LONGEST}
        self.held += sum(200 + 2 * len(w) for w in fit)
        self.recent.update(fit)


class Lexicon:
    """Words as an Arrow array with their ids one after another; bounded in entries and bytes, what was used longest ago goes first."""

    def __init__(self, most: int, most_bytes: int | None = None) -> None:
        self.most, self.most_bytes = most, REMEMBERED_BYTES if most_bytes is None else most_bytes
        self.words, self.ids = pa.array([], pa.string()), np.empty(0, "<u4")
        self.firsts, self.sizes, self.used = (np.empty(0, np.int64) for _ in range(3))
        self.clock = 0

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of ``words`` stands, -1 if it is not known."""
        self.clock += 1
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        self.used[at[at >= 0]] = self.clock
        return at

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember new, distinct words, but for those longer than LONGEST; ``ids`` holds ``sizes`` of each, in turn."""
        short = pc.less_equal(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
        if not short.all():
            ids = ids[_runs((np.cumsum(sizes) - sizes)[short], sizes[short])]
            words, sizes = words.filter(pa.array(short)), sizes[short]
        self.words = pa.concat_arrays([self.words, words])
        self.firsts = np.concatenate([self.firsts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(sizes), self.clock)])
        entries, size = len(self.words), self.words.nbytes + self.ids.nbytes + 24 * len(self.words)
        if entries > self.most or size > self.most_bytes:
            # half of what the bounds allow is left
            left = min(self.most, int(entries * self.most_bytes / size)) // 2
            kept = np.sort(np.argsort(-self.used, kind="stable")[:left])
            self.words, self.ids = self.words.take(pa.array(kept)), self.ids[_runs(self.firsts[kept], self.sizes[kept])]
            self.sizes, self.used = self.sizes[kept], self.used[kept]
            self.firsts = np.cumsum(self.sizes) - self.sizes


def arrow_portions(texts: pa.Array, size: int = PORTION) -> Iterator[tuple[int, int]]:
    """(first, stop) of runs of rows of a batch that hold about ``size`` bytes of text each."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(lengths):
        done = lengths[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(lengths, done + size, side="right")))
        yield first, stop
        first = stop


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases, drops white space and merges within pre-tokens only.

    Texts are split and their distinct words found by Arrow; each word is
    encoded by the library once and remembered as packed ids, and the ids of a
    text are gathered from those of its words.  Words outside the plain range
    above are handed to the library as they are, whole and by themselves.
    """

    def __init__(self, path: str, remembered: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Lexicon(REMEMBERED if remembered is None else remembered)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], plain: bool) -> list[bytes]:
        """The packed ids of new words, through their pre-tokens."""
        odd = {} if plain else {w: self._whole(w) for w in words if NOT_PLAIN.search(w)}
        parts = {w: PRE_TOKEN.findall(w) for w in words if not w.isalpha() and w not in odd}
        out: dict[str, bytes] = {}
        # a pre-token is a word too, and may be known
        pieces = list(set(chain.from_iterable(parts.values())))
        known = self.words.places(pa.array(pieces, pa.string())).tolist()
        for piece, at in zip(pieces, known):
            if at >= 0:
                first = self.words.firsts[at]
                out[piece] = self.words.ids[first : first + self.words.sizes[at]].tobytes()
        unknown = [w for w in words if w not in parts and w not in odd and w not in out]
        asked = set(unknown)
        unknown += [p for p in pieces if p not in out and p not in asked]
        if unknown:
            # every pre-token ends with an id of a token that ends a word, so one call serves them all
            ids = np.array(self.library.encode_batch_fast([" ".join(unknown)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) == len(unknown):
                data, ends = ids.tobytes(), ends.tolist()
                out.update(zip(unknown, map(data.__getitem__, map(slice, [0, *ends], ends))))
            else:
                out.update((w, self._whole(w)) for w in unknown)
        out.update((w, b"".join(map(out.__getitem__, own))) for w, own in parts.items())
        out.update(odd)
        return list(map(out.__getitem__, words))

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of plain texts in lower case, and how many each text has."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    def _split_odd(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """As ``_split`` for texts that hold odd words, which keep their letters' case."""
        lists = [[w if NOT_PLAIN.search(w) else w.lower() for w in BETWEEN.split(t)] for t in texts.to_pylist()]
        return pa.array([w for own in lists for w in own], pa.string()), np.array([len(own) for own in lists], np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where those of each end; null texts have none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, NOT_PLAIN_ARROW).to_numpy(zero_copy_only=False)
        if odd.any():
            # plain texts and those with odd words are split apart, and put together in their order again
            order = np.argsort(odd, kind="stable")
            halves = [self._split(texts.filter(pa.array(~odd))), self._split_odd(texts.filter(pa.array(odd)))]
            words, counts = pa.concat_arrays([h[0] for h in halves]), np.concatenate([h[1] for h in halves]).astype(np.int64)
            firsts = np.empty(len(odd), np.int64)
            sizes = np.empty(len(odd), np.int64)
            firsts[order], sizes[order] = np.cumsum(counts) - counts, counts
            words, counts = words.take(pa.array(_runs(firsts, sizes))), sizes
        else:
            words, counts = self._split(texts)
        coded = words.dictionary_encode()
        data, sizes = self._coded(coded.dictionary, odd.any())
        at = coded.indices.to_numpy()
        own = sizes[at]
        out = data[_runs((np.cumsum(sizes) - sizes)[at], own)]
        return out, np.concatenate([[0], np.cumsum(own)])[np.cumsum(counts)]

    def _coded(self, words: pa.Array, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, and how many each has.

        A word of letters with a sign behind it is looked up without the sign,
        so words are remembered once, wherever they stand in a sentence.
        """
        bare = pc.utf8_rtrim(words, SIGNS)
        signed = pc.and_(pc.utf8_is_alpha(bare), pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(bare)), 1))
        if odd:
            signed = pc.and_not(signed, pc.match_substring_regex(words, NOT_PLAIN_ARROW))
        signed = pc.fill_null(signed, False)
        after = pc.if_else(signed, pc.utf8_slice_codeunits(words, -1), "")
        both = pa.concat_arrays([pc.if_else(signed, bare, words), after]).dictionary_encode()
        known = self.words.places(both.dictionary)
        missing = known < 0
        data, firsts, sizes = self.words.ids, self.words.firsts, self.words.sizes
        if missing.any():
            new = both.dictionary.filter(pa.array(missing))
            packed = self._learn(new.to_pylist(), not odd)
            more = np.frombuffer(b"".join(packed), "<u4")
            lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            # new words stand behind the known ones
            known = np.where(missing, len(sizes) + np.cumsum(missing) - 1, known)
            firsts, sizes = np.concatenate([firsts, len(data) + np.cumsum(lengths) - lengths]), np.concatenate([sizes, lengths])
            data = np.concatenate([data, more])
            self.words.add(new, more, lengths)
        # the word itself and its sign, in turn
        at = known[both.indices.to_numpy().reshape(2, len(words)).T.ravel()]
        return data[_runs(firsts[at], sizes[at])], sizes[at].reshape(len(words), 2).sum(axis=1)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.ids(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _runs(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, ``sizes`` numbers long, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def word_encoder(path: str, remembered: int | None = None) -> WordEncoder:
    """One encoder a process: what one task has remembered serves the next."""
    return WordEncoder(path, remembered)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    both = []
    with np.errstate(over="ignore"):
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            powers = np.full(n, base, np.uint64)
            powers[:1] = 1
            both.append(np.multiply.accumulate(powers))
    return both[0], both[1]


def places(ids: np.ndarray, ends: np.ndarray, least: int = 21) -> np.ndarray:
    """Where chunks may end in id streams that lie one after another, each up to one of ``ends``.

    A polynomial hash of the last WINDOW ids of the own stream decides; the
    newest id has weight 1, wherever the window lies.  The table of powers holds
    2**least numbers at least.
    """
    n = len(ids)
    # one table serves all portions; only a longer text needs another
    size = 1 << max(least, n.bit_length())
    with np.errstate(over="ignore"):
        base, inverse = (p[:n] for p in _powers(size))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * inverse, out=sums[1:])
        starts = np.repeat(np.concatenate([[0], ends[:-1]]).astype(np.int64), np.diff(np.concatenate([[0], ends])))
        rolled = (sums[1:] - sums[np.maximum(starts, np.arange(n) - (WINDOW - 1))]) * base
    return np.flatnonzero((rolled >> np.uint64(37)) % np.uint64(MEAN_CHUNK) == 0) + 1


def chunk_ends(found: list[int], first: int, stop: int) -> list[int]:
    """Ends of the chunks of the stream from ``first`` to ``stop``, of MIN_CHUNK to MAX_CHUNK ids but for the last one."""
    ends, last = [], first
    if stop - first > MIN_CHUNK:
        for end in found:
            while end - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if end - last >= MIN_CHUNK:
                ends.append(end)
                last = end
        while stop - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
    if last < stop:
        ends.append(stop)
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream, by content."""
    return chunk_ends(places(ids, np.array([len(ids)])).tolist(), 0, len(ids))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests: pairs are hashed together level by level; an odd last one moves up."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"\0")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def joined_crc(crc: int, next_crc: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings after one another, from theirs and the second's length."""
    zeros = bytes(n_bytes)
    return zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ next_crc


_OBJECT = "key long, kind string, doc_id long, n_tokens long, digests array<binary>, crcs array<long>, sizes array<int>, root binary, digest binary, n_ids int, width int, payload binary"


def forget() -> None:
    """Let go of all that this process remembers."""
    word_encoder.cache_clear()
    _powers.cache_clear()


def _encoder(path: str, end_id: int | None, remembered: int | None = None, portion: int = PORTION):
    # an id takes two bytes of text or more but in odd texts
    least = min(21, (portion // 2 - 1).bit_length())

    def rows(kind: str, n: int, **columns: list) -> pa.RecordBatch:
        """Rows of one kind; columns of the other kind are null."""
        return pa.RecordBatch.from_arrays([pa.array([kind] * n) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token store", forget)
        encoder = word_encoder(path, remembered)
        width = 2 if max(encoder.library.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        sent: set[bytes] = set()  # sending a chunk again is allowed, so forgetting is too
        gc.disable()  # millions of words are made here, and no cycles
        try:
            for batch in batches:
                for first, stop in arrow_portions(batch["text"], portion):
                    doc_ids = batch["doc_id"].slice(first, stop - first).to_pylist()
                    ids, ends = encoder.ids(batch["text"].slice(first, stop - first))
                    if end_id is not None:
                        ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                    ids = ids.astype("<u4")
                    names, lengths, payloads = [], [], []
                    counts, lists, crcs, sizes, roots = [], [], [], [], []
                    data, small = ids.tobytes(), ids.astype(f"<u{width}").tobytes()
                    found = places(ids, ends, least)
                    marks, found = np.searchsorted(found, ends, side="right").tolist(), found.tolist()
                    last = mark = 0
                    for end, next_mark in zip(ends.tolist(), marks):
                        counts.append(end - last)
                        own, own_crcs, own_sizes = [], [], []
                        for cut_at in chunk_ends(found[mark:next_mark], last, end):
                            part = data[4 * last : 4 * cut_at]
                            name = digest(part)
                            own.append(name)
                            own_crcs.append(zlib.crc32(part))
                            own_sizes.append(cut_at - last)
                            if name not in sent:
                                sent.add(name)
                                names.append(name)
                                lengths.append(cut_at - last)
                                payloads.append(small[width * last : width * cut_at])
                            last = cut_at
                        mark = next_mark
                        lists.append(own)
                        crcs.append(own_crcs)
                        sizes.append(own_sizes)
                        roots.append(merkle(own))
                    if len(sent) > SENT:
                        sent.clear()
                    yield rows("recipe", len(doc_ids), key=[_number(digest(repr(d).encode() + root)) for d, root in zip(doc_ids, roots)], doc_id=doc_ids, n_tokens=counts, digests=lists, crcs=crcs, sizes=sizes, root=roots)
                    if names:
                        yield rows("chunk", len(names), key=list(map(_number, names)), digest=names, n_ids=lengths, width=[width] * len(names), payload=payloads)
        finally:
            gc.enable()

    return run


def _number(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


_ARROW = pa.schema(
    [
        ("key", pa.int64()), ("kind", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("crcs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
        ("root", pa.binary()), ("digest", pa.binary()), ("n_ids", pa.int32()), ("width", pa.int32()), ("payload", pa.binary()),
    ]
)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None, portion: int = PORTION) -> str:
    """Encode ``docs`` and write the store described above to ``path``.

    Null texts count as empty and yield the end id alone.  Rows that repeat a
    doc_id keep their own recipes, ordered by root; rows without a doc_id come
    first.  An empty table gives empty tables.  ``remembered`` bounds the words
    that a Python process holds, REMEMBERED by default, and ``portion`` the bytes
    of text that it takes up at a time.
    """
    spark = docs.sparkSession
    made = documents(docs, id_col, text_col).mapInArrow(_encoder(tokenizer, end_id, remembered, portion), _OBJECT)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # of the chunks that tasks have sent, the first of each digest; the window takes the partitioning as it is
    before = F.lag("digest").over(Window.partitionBy("key").orderBy("digest"))
    once = made.repartition(n, "key").withColumn("_before", before).where("kind = 'recipe' or _before is null or _before <> digest")
    once.drop("key", "_before").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    objects = spark.read.schema(_OBJECT.removeprefix("key long, ")).parquet(f"{path}/objects")
    recipes = objects.where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "crcs", "sizes", "root")
    ranged = recipes.repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("file_no", F.spark_partition_id())
    ranged.mapInArrow(_placed, _PLACED).write.option("compression", "zstd").parquet(f"{path}/ordered")
    ordered = spark.read.schema(_PLACED).parquet(f"{path}/ordered")
    # one row per file, from its last recipe: its ids, the ids before it, and its Merkle root
    files = ordered.where("file_docs is not null").select("file_no", "file_docs", (F.col("inside") + F.col("n_tokens")).alias("file_tokens"), "file_root")
    before = cut(files.withColumn("before", F.coalesce(F.sum("file_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # at most one row per shuffle partition
    placed = ordered.join(F.broadcast(before.select("file_no", "before")), "file_no")
    placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "digests", "crcs", "sizes", "root", "file_no").write.option("compression", "zstd").parquet(f"{path}/recipes")
    before.select("file_no", F.col("file_docs").alias("n_docs"), F.col("file_root").alias("root")).write.parquet(f"{path}/manifest")
    return path


_PLACED = "doc_id long, n_tokens long, digests array<binary>, crcs array<long>, sizes array<int>, root binary, file_no int, inside long, file_docs long, file_root binary"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The recipes of one file in their order, with the ids before each; the last one carries the file's Merkle root."""
    inside, roots, held = 0, [], None

    def told(batch: pa.RecordBatch, before: int, last: bool) -> pa.RecordBatch:
        sizes = batch["n_tokens"].to_numpy(zero_copy_only=False)
        none = [None] * (batch.num_rows - last)
        columns = [pa.array(before + np.cumsum(sizes) - sizes, pa.int64()), pa.array(none + [len(roots)] * last, pa.int64()), pa.array(none + [merkle(roots)] * last, pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "inside", "file_docs", "file_root"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield told(*held, False)
        held = (batch, inside)
        inside += int(np.sum(batch["n_tokens"].to_numpy(zero_copy_only=False)))
        roots += batch["root"].to_pylist()
    if held is not None:
        yield told(*held, True)


_RECIPE = "doc_id long, start long, n_tokens long, digests array<binary>, crcs array<long>, sizes array<int>, root binary, file_no int"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPE).parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_OBJECT.removeprefix("key long, ")).parquet(f"{path}/objects").where("kind = 'chunk'").select("digest", "n_ids", "width", "payload")


def wide(payload: bytes, width: int) -> bytes:
    """A stored payload as little-endian unsigned 32-bit integers."""
    return payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4").tobytes()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for name, n_ids, width, payload in zip(*(batch[c].to_pylist() for c in ("digest", "n_ids", "width", "payload"))):
            data = wide(payload, width)
            if digest(data) != name or len(data) != 4 * n_ids:
                raise ValueError(f"chunk {name.hex()} does not hold what its digest says")
            crcs.append(zlib.crc32(data))
        yield pa.RecordBatch.from_arrays([batch["digest"], batch["n_ids"], pa.array(crcs, pa.int64())], names=["digest", "n_ids", "crc"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = []
        for root, n_tokens, digests, crcs, sizes in zip(*(batch[c].to_pylist() for c in ("root", "n_tokens", "digests", "crcs", "sizes"))):
            if merkle(digests) != root or sum(sizes) != n_tokens:
                raise ValueError("a recipe does not match its Merkle root")
            crc = 0
            for part, n_ids in zip(crcs, sizes):
                crc = joined_crc(crc, part, 4 * n_ids)
            whole.append(crc)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(whole, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def verify(spark: SparkSession, path: str) -> None:
    """Raises if a chunk does not hold what its digest says, or a recipe states anything else about a chunk than what is stored."""
    facts = read_chunks(spark, path).mapInArrow(_checked, "digest binary, n_ids int, crc long")
    stated = read_recipes(spark, path).select(F.explode(F.arrays_zip("digests", "sizes", "crcs")).alias("x")).select(F.col("x.digests").alias("digest"), F.col("x.sizes").alias("n_ids"), F.col("x.crcs").alias("crc")).distinct()
    wrong = stated.join(facts, ["digest", "n_ids", "crc"], "left_anti").first()
    if wrong:
        raise ValueError(f"chunk {wrong.digest.hex()} is missing from the store or not what a recipe says")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    Every chunk is hashed again, every recipe's Merkle root recomputed, and
    every statement of a recipe held against the chunks; a missing or altered
    chunk or recipe raises.  Rows are those of the recipes, repeated ones too.
    """
    verify(spark, path)
    return read_recipes(spark, path).select("doc_id", "start", "n_tokens", "digests", "crcs", "sizes", "root").mapInArrow(_folded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The whole id lists of the documents in ``wanted`` (column doc_id): doc_id, start, ids."""
    uses = read_recipes(spark, path).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "start", F.posexplode("digests").alias("seq", "digest"))

    def glued(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        ids = [i for p, w in zip(group["payload"].to_pylist(), group["width"].to_pylist()) for i in np.frombuffer(wide(p, w), "<u4").tolist()]
        return pa.table({"doc_id": group["doc_id"].slice(0, 1), "start": group["start"].slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int64()))})

    return uses.join(read_chunks(spark, path), "digest").groupBy("doc_id", "start").applyInArrow(glued, "doc_id long, start long, ids array<long>")


def token_store(docs: DataFrame, tokenizer: str, end_id: int | None = 1, path: str | None = None, remembered: int | None = None, portion: int = PORTION) -> DataFrame:
    """Write the store (in the shared folder unless ``path`` is given) and return what is read back from it."""
    path = path or scratch(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, end_id, remembered=remembered, portion=portion)
    return read_back(docs.sparkSession, path)
