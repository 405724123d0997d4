"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, fill_middle, host_rules, html_text, mixing, quality, simhash, spelling, substring_dedup, token_counts, token_store, top_k
from tidemark.llm.common import table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, bits=2)
    return found.select("doc_id", simhash.hex_digits(found.fp).alias("fingerprint"), "component_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.chat_digests(chat.format_conversations(rows))


def op4_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op5_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), max_repetition=2.0, budget_share=1.0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.digests(host_rules.judged(table(spark, sf_dir, "documents"), limit=0.5))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")), ratio=10)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restored(fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_simhash_pivots": op2_simhash_pivots,
    "op3_chat_format": op3_chat_format,
    "op4_threshold_top_k": op4_threshold_top_k,
    "op5_html_tag_paths": op5_html_tag_paths,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_temperature_mixing": op8_temperature_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_host_rules": op11_host_rules,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": chat.ORACLE,
    "op4_threshold_top_k": top_k.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_temperature_mixing": mixing.ORACLE,
    "op11_host_rules": host_rules.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
