"""The pipeline on the awkward table, against plain Python for each stage's decisions."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from helpers import LONG, SCHEMA, empty, rows, text_of
from pyspark.sql import functions as F

from tidemark.llm import quality as Q

ITEM = "one two three four five six seven eight nine ten eleven"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    data = [*rows(), (20, text_of(21) + " " + ITEM, "en", "a"), (21, text_of(22, 80), "en", "b"), (22, None, None, None)]
    base = text_of(30, 200).split()
    data += [(30 + i, " ".join(base[: 9 * i] + [f"edit{i}"] + base[9 * i + 1 :]), "en", "c") for i in range(5)]
    data += [(100 + i, "| buy### | " * 40 + str(i), "en", "b") for i in range(20)] + [(200 + i, text_of(200 + i, 50), "en", "a") for i in range(40)]
    spark.createDataFrame(data, SCHEMA).withColumn("n_chars", F.length("text")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("i1", ITEM), ("i2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(d, int("buy###" not in (t or "")), 0) for d, t, *_ in data if d is not None and d != 21], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), data


def stage(spark, tables, number, kept):
    df = spark.createDataFrame([(d, t, a, b, None if t is None else len(t)) for d, t, a, b in kept], SCHEMA + ", n_chars int")
    return corpus_pipeline.STAGES[number][1](spark, df, tables[0]), df


def same(rows):
    return sorted(rows, key=repr)


def test_stages_on_awkward_rows(spark, tables):
    path, data = tables
    out, df = stage(spark, tables, 0, data)
    model = Q.fit(df, spark.read.parquet(f"{path}/labels.parquet"))
    scores = model.scores(np.array([Q.statistics(t or "") for _, t, *_ in data]))
    want = [r for r, s in zip(data, scores) if s >= 0.3]
    assert out.columns == df.columns and same(tuple(r)[:4] for r in out.collect()) == same(want)
    assert not any("buy###" in (r[1] or "") for r in want) and any(r[1] == LONG for r in want)

    out, df = stage(spark, tables, 1, data)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    sets = [frozenset(tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))) if words(t) else frozenset() for _, t, *_ in data]
    group = list(range(len(data)))
    for _ in data:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                    group[i] = group[j] = min(group[i], group[j])
    assert out.columns == df.columns and out.count() == len(set(group))
    ids = [r.doc_id for r in out.collect()]
    for g in set(group):
        own = [r[0] for r, x in zip(data, group) if x == g and r[0] is not None]
        assert not own or min(own) in ids
    assert ids.count(30) == 1 and not {31, 32, 33, 34} & set(ids)

    out, df = stage(spark, tables, 2, data)
    assert out.columns == df.columns and same(tuple(r)[:4] for r in out.collect()) == same(r for r in data if r[0] != 20)

    out, df = stage(spark, tables, 3, data)
    assert out.columns == df.columns and {tuple(r)[:4] for r in out.collect()} == set(data)


def test_run_reads_back_what_the_library_encodes(spark, tables):
    from tokenizers import Tokenizer

    path, data = tables
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {}
    for d, t, *_ in data:
        texts.setdefault(d, set()).add(t or "")
    got = corpus_pipeline.run(spark, path).collect()
    assert got and {r.doc_id for r in got} <= set(texts) and not {1, 20, 31, 100} & {r.doc_id for r in got}
    crcs = {d: {zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in own} for d, own in texts.items()}
    assert all(r.ids_crc32 in crcs[r.doc_id] for r in got)


def test_empty_tables(spark, tables, tmp_path):
    for name, kind in (("documents", SCHEMA), ("benchmark", "item_id string, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert empty(spark).count() == 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == 0
