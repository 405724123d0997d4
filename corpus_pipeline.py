"""A training corpus from raw documents in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back for the next.
All but the last return the columns of ``documents``.

In every stage null texts count as empty ones, long texts are read whole, an
empty table stays empty, and columns of any other name are kept as they are.
Rows without a doc_id are documents like others; of rows alike in doc_id and
text the near-duplicate stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, quality, simhash, token_store
from tidemark.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group linked by a Jaccard similarity of 0.8 or more (five-word shingles)."""
    return simhash.deduplicated(docs, words=5, bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), size=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of rare sources, at most twice over; no document is dropped."""
    return mixing.resampled(docs, max_repetition=2.0, budget_share=None)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns one row per document read back from it."""
    # the stages before have left the executors' heaps grown, so texts are taken up in smaller portions than by op1
    return token_store.token_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, remembered=300_000, portion=2 << 20)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("temperature mixing", mixing_stage),
    ("token store", token_stage),
]

#: Trained scores and library token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
