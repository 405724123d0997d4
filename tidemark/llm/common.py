"""Helpers that the operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import cut, scratch, shared_dir, stored

__all__ = ["ascii_lower", "claim", "cut", "documents", "portions", "scratch", "shared_dir", "stored", "table"]

#: The only characters that the text contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Only the needed columns, a null text read as empty; other columns, whatever their names, play no part."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c) for c in extra],
    )


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def portions(*columns: pa.Array, rows: int = 256, size: int = 1 << 20) -> Iterator[tuple[list, ...]]:
    """Runs of rows of an Arrow batch as Python lists, the last column a text of about ``size`` characters in all.

    A batch is never unpacked as a whole, so long texts are held a few at a time.
    """
    for at in range(0, len(columns[0]), rows):
        lists = [c.slice(at, rows).to_pylist() for c in columns]
        first = total = 0
        for i, text in enumerate(lists[-1]):
            total += len(text or "")
            if total >= size:
                yield tuple(x[first : i + 1] for x in lists)
                first, total = i + 1, 0
        if first < len(lists[-1]):
            yield tuple(x[first:] for x in lists)


#: What the operators that have run in this process hold between tasks, and how to let go of it.
_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called where a task begins: what other operators have remembered in this Python process is let go."""
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if release is not None:
        _HELD[owner] = release
