"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are themselves one token.  Which vocabulary strings
encode alone as that one token is proved beforehand, by encoding each with the
library; at count time a pre-token found among them counts one and only the
rest is merged by the library.  Characters beyond the plain range are told by
class (letter, number, white space, other sign), which the library's own
splitting proves for each of them once, so texts in any script take the same
way.  What a process remembers is bounded in entries and bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import claim, documents, portions
from tidemark.llm.token_store import LETTERS, NOT_PLAIN, NUMBERS, SIGNS, Memory

#: Characters of text whose distinct stretches are looked up at a time, about.
PORTION = 4 << 20
#: Stretches and pieces in each of the two generations that a process remembers, and the bytes these may take.
REMEMBERED, REMEMBERED_BYTES = 800_000, 128 << 20

#: White space to Python, but not to the library.
NOT_SPACE = re.compile(r"[\x1c-\x1f]")

#: The pre-tokens of byte-level BPE: contractions; letters, numbers or other signs after at most one space; spaces.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Stretches that no pre-token crosses: a word with the white space before it, or trailing white space.
STRETCH = re.compile(r"\s*\S+|\s+")


def whole_tokens(library) -> frozenset[str]:
    """Vocabulary strings that the library encodes, each alone, as one token: the token of that string."""
    vocabulary = library.get_vocab(with_added_tokens=False)
    strings = {}
    for token, number in vocabulary.items():
        text = library.decode([number], skip_special_tokens=False)
        if text and "�" not in text:
            strings[text] = number
    texts = list(strings)
    proved = set()
    for i in range(0, len(texts), 4096):
        part = texts[i : i + 4096]
        for text, made in zip(part, library.encode_batch_fast(part, add_special_tokens=False)):
            if made.ids == [strings[text]]:
                proved.add(text)
    return frozenset(proved)


class Shapes(dict):
    """Code points to a character of the same class in the pattern of pre-tokens; plain ones to themselves.

    The library's splitting tells the class: what goes on a letter is a letter,
    what goes on a number a number, and likewise for other signs.
    """

    def __init__(self, library) -> None:
        super().__init__()
        self.split = library.pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if not NOT_PLAIN.search(c):
            shape = c
        else:
            shape = next((x for x in ("x", "0", "!") if len(self.split(x + c)) == 1), "\t")
        self[code] = shape
        return shape


class Counter:
    """Counts tokens of whole texts.

    Only stretches that may hold special strings go to the library as they are,
    and texts with separators which the library takes for signs go whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, remembered_bytes: int = REMEMBERED_BYTES) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.alone = whole_tokens(self.library)
        self.shapes = Shapes(self.library)
        # stretches and their pieces are strings with a count alike, and share one memory
        self.stretches = Memory(remembered, remembered_bytes)

    def pieces(self, stretch: str) -> list[str]:
        """The pre-tokens of a stretch; one that may hold a special string is left whole."""
        # most are a word of plain letters, after at most one space, with at most one sign behind it
        body = stretch[1:] if stretch[0] == " " else stretch
        if body.isascii():
            if body.isalpha():
                return [stretch]
            if body[:-1].isalpha() and body[-1] in SIGNS:
                return [stretch[:-1], stretch[-1]]
        if "<|" in stretch:
            return [stretch]
        if not NOT_PLAIN.search(stretch):
            return PRE_TOKEN.findall(stretch)
        return [stretch[m.start() : m.end()] for m in PRE_TOKEN.finditer(stretch.translate(self.shapes))]

    def _merged(self, pieces: list[str]) -> dict[str, int]:
        """How many tokens the library makes of each of the distinct pieces."""
        made: dict[str, int] = {}
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            made.update(zip(part, (len(x.ids) for x in self.library.encode_batch_fast(part, add_special_tokens=False))))
        return made

    def counts(self, texts: list[str]) -> list[int]:
        split = [None if NOT_SPACE.search(t) else STRETCH.findall(t) for t in texts]
        wanted = list(set().union(*(s for s in split if s)))
        known, missed = self.stretches.found(wanted)
        alone = self.alone
        parts = [self.pieces(wanted[i]) for i in missed]
        # a stretch that is a piece itself is not known; pieces of others may be
        whole = {ps[0] for ps in parts if len(ps) == 1}.difference(alone)
        others = list({p for ps in parts if len(ps) > 1 for p in ps}.difference(alone, whole))
        counted, unknown = self.stretches.found(others)
        made = self._merged([*whole, *(others[j] for j in unknown)])
        merged = {p: n for p, n in zip(others, counted) if n is not None} | made
        for i, ps in zip(missed, parts):
            known[i] = merged.get(ps[0], 1) if len(ps) == 1 else sum(merged.get(p, 1) for p in ps)
        self.stretches.keep({wanted[i]: known[i] for i in missed} | made)
        own = dict(zip(wanted, known))
        return [len(self.library.encode(t, add_special_tokens=False).ids) if s is None else sum(map(own.__getitem__, s)) for t, s in zip(texts, split)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a process: the proof and what was merged serve all its tasks."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, in one pass.

    Null and empty texts have no bytes and no tokens; long ones are counted
    whole.  Rows that repeat, or have no doc_id, are counted each; an empty
    table gives an empty one, and other columns, whatever their names, play no
    part.
    """

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("token counts", counter.cache_clear)
        for batch in batches:
            yield pa.array([n for (texts,) in portions(batch, rows=4096, size=PORTION) for n in counter(tokenizer).counts(texts)], pa.int64())

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    own = documents(docs, id_col, text_col)
    return own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.arrow_udf(count, "long")("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
