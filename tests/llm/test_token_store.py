import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import docs, empty, rows

from tidemark.llm import token_counts as C
from tidemark.llm import token_store as S

PATH = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b\n\n c", "  x", " ", "", "<|endoftext|> hi", "don't  'sfoo ''s", "x²½ ٣", "é \x1c!", "  \n\n\tfoo\r\n", "İ ŉ", "ΑΣ Σ", "é ́x", "a b", "…?!..", "l'été c'est", "curly ’quote’ and — dash, plain words", "中文 text　wide", "a\x85b\u2028c", "x <|endoftext|> y<|endoftext|>", "tail ’ ", "’\n\n ’"]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_encoder_equals_library():
    texts = ODD + [r[1] or "" for r in rows()]
    want = [np.array(e.ids, "<u4").tobytes() for e in library(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    assert S.WordEncoder(PATH).packed(texts) == want


def test_memory_forgets_and_still_encodes(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 5)
    texts = [r[1] or "" for r in rows()]
    want = [np.array(e.ids, "<u4").tobytes() for e in library(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    e = S.WordEncoder(PATH)
    assert e.packed(texts) == want and [e.packed([t])[0] for t in texts] == want


def test_store_round_trip(spark, tmp_path):
    path = S.write_store(docs(spark), str(tmp_path / "s"), PATH)
    lib = library(PATH)
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted(map(tuple, S.read_back(spark, path).collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    whole = {(r.doc_id, r.start): list(r.ids) for r in S.reconstruct(spark, path, spark.createDataFrame([(6,), (1,)], "doc_id long")).collect()}
    assert whole == {(w[0], w[1]): w[4] for w in want if w[0] in (6, 1)}
    chunks = S.read_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_altered_store_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    path = S.write_store(docs(spark), str(tmp_path / "s"), PATH)
    chunks = spark.read.parquet(f"{path}/objects/kind=chunk")
    first = chunks.agg(F.min("digest")).first()[0]
    chunks.where(F.col("digest") != F.lit(first)).write.parquet(str(tmp_path / "t/objects/kind=chunk"))
    spark.read.parquet(f"{path}/recipes").write.parquet(str(tmp_path / "t/recipes"))
    with pytest.raises(Exception, match="missing"):
        S.read_back(spark, str(tmp_path / "t")).collect()


def test_chunks_follow_content_and_limits():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49_000, 20_000).astype("<u4")
    ends = S.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= S.MAX_CHUNK and sizes[:-1].min() >= S.MIN_CHUNK
    moved = S.cuts(np.concatenate([rng.integers(0, 49_000, 37).astype("<u4"), ids]))
    parts = lambda x, e: {x[a:b].tobytes() for a, b in zip([0, *e], e)}
    shared = parts(ids, ends) & parts(np.concatenate([np.zeros(37, "<u4"), ids]), moved)
    assert len(shared) > 0.8 * len(ends)
    assert S.cuts(ids[:0]) == [] and S.cuts(ids[:5]) == [5]


def test_empty_table(spark, tmp_path):
    assert S.read_back(spark, S.write_store(empty(spark), str(tmp_path / "e"), PATH)).count() == 0


def test_counts_equal_library(spark):
    texts = ODD + [r[1] or "" for r in rows()]
    want = [len(e.ids) for e in library(BYTES).encode_batch_fast(texts, add_special_tokens=False)]
    assert C.Counter(BYTES).counts(texts) == want
    got = C.token_counts(docs(spark), BYTES).collect()
    lib = library(BYTES)
    key = lambda r: (str(r[0]), r[1], r[2])
    expected = [(r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows()]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert C.token_counts(empty(spark), BYTES).count() == 0


def test_whole_tokens_are_proved():
    c = C.Counter(BYTES)
    assert len(c.alone) > 45_000 and all(len(c.library.encode(t, add_special_tokens=False).ids) == 1 for t in list(c.alone)[:300])


SCRIPTS = [(0x370, 0x3FF), (0x400, 0x4FF), (0x590, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x2000, 0x206F), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF), (0x20, 0x7E)]


def scripts(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b = SCRIPTS[rng.integers(len(SCRIPTS))]
        out.append("".join(chr(rng.integers(a, b)) if rng.random() < 0.85 else rng.choice(list(" ,.'0\n")) for _ in range(rng.integers(1, 40))))
    return "".join(out)


def test_other_scripts_take_the_whole_token_way():
    texts = [scripts(i, 12) for i in range(200)] + ["".join(map(chr, range(a, b))) for a, b in SCRIPTS]
    c = C.Counter(BYTES)
    assert c.counts(texts) == [len(e.ids) for e in library(BYTES).encode_batch_fast(texts, add_special_tokens=False)]
    assert c.pieces("слово, ещё") == ["слово", ",", " ещё"] and c.pieces("x<|y") == ["x<|y"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    assert S.WordEncoder(PATH).packed(texts) == want


def test_texts_without_spaces_are_not_remembered():
    import tracemalloc

    rng = np.random.default_rng(1)
    encoder, counted = S.WordEncoder(PATH), C.Counter(BYTES)
    for i in range(41):
        if i == 1:
            # what a first batch loads and learns of single characters stays
            tracemalloc.start()
        texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 300))) for _ in range(500)]
        encoder.packed(texts)
        counted.counts(texts)
    del texts
    assert tracemalloc.get_traced_memory()[0] < 20e6
    tracemalloc.stop()
    # the empty sign behind words without one is all that is kept
    assert len(encoder.words.words) <= 1 and not counted.stretches.recent


def test_memory_is_bounded_in_bytes():
    memory = S.Memory(10**9, 100_000)
    for i in range(0, 20_000, 100):
        known, missed = memory.found([f"word{j}" for j in range(i, i + 100)])
        assert known == [None] * 100 and len(missed) == 100
        memory.keep({f"word{j}": j for j in range(i, i + 100)} | {"w" * 65: 1})
    assert len(memory.recent) + len(memory.older) < 1200 and memory.held < 130_000
    assert memory.found(["word19999", "w" * 65])[1] == [1]


def test_lexicon_is_bounded_and_keeps_what_is_used():
    import pyarrow as pa

    for lexicon in (S.Lexicon(1000), S.Lexicon(10**9, 40_000)):
        lexicon.add(pa.array(["often", "w" * 65]), np.array([7, 8, 9], "<u4"), np.array([2, 1]))
        for i in range(0, 20_000, 100):
            assert lexicon.places(pa.array(["often", "w" * 65])).tolist()[1] == -1
            words = pa.array([f"word{j}" for j in range(i, i + 100)])
            assert (lexicon.places(words) == -1).all()
            lexicon.add(words, np.arange(i, i + 100, dtype="<u4"), np.ones(100, np.int64))
            assert len(lexicon.words) <= 1100
        often, last = lexicon.places(pa.array(["often", "word19999"])).tolist()
        assert lexicon.ids[lexicon.firsts[often] : lexicon.firsts[often] + 2].tolist() == [7, 8]
        assert lexicon.ids[lexicon.firsts[last]] == 19_999


def test_altered_recipes_are_found(spark, tmp_path):
    from pyspark.sql import functions as F

    path = S.write_store(docs(spark), str(tmp_path / "s"), PATH)
    for name, change in (("crc", {"crcs": F.transform("crcs", lambda x: x + 1)}), ("size", {"sizes": F.transform("sizes", lambda x: x + 1)}), ("root", {"digests": F.slice("digests", 1, 1), "crcs": F.slice("crcs", 1, 1), "sizes": F.slice("sizes", 1, 1)})):
        to = str(tmp_path / name)
        spark.read.parquet(f"{path}/objects").write.partitionBy("kind").parquet(f"{to}/objects")
        spark.read.parquet(f"{path}/recipes").withColumns(change).write.parquet(f"{to}/recipes")
        with pytest.raises(Exception, match="recipe"):
            S.read_back(spark, to).collect()


def test_repeated_empty_rows_without_an_end_id_stay(spark, tmp_path):
    table = spark.createDataFrame([(1, ""), (1, None), (1, ""), (2, "word")], "doc_id long, text string")
    got = sorted(map(tuple, S.read_back(spark, S.write_store(table, str(tmp_path / "s"), PATH, end_id=None)).collect()))
    assert [r[:3] for r in got] == [(1, 0, 0)] * 3 + [(2, 0, 1)]


def test_forgetting_what_was_sent_changes_nothing(spark, tmp_path, monkeypatch):
    want = sorted(map(tuple, S.read_back(spark, S.write_store(docs(spark), str(tmp_path / "a"), PATH)).collect()), key=repr)
    monkeypatch.setattr(S, "SENT", 0)
    monkeypatch.setattr(S, "PORTION", 100)
    path = S.write_store(docs(spark), str(tmp_path / "b"), PATH)
    assert sorted(map(tuple, S.read_back(spark, path).collect()), key=repr) == want
    chunks = S.read_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_smaller_portions_give_the_same_rows_and_smaller_arrays(monkeypatch):
    texts = [f"word{i} and {i * 7} more, " * 40 for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(200), pa.int64()), "text": texts})
    seen, real = [], S.places

    def places(ids, ends, least=21):
        seen.append((len(ids), least))
        return real(ids, ends, least)

    monkeypatch.setattr(S, "places", places)
    path, got = public_tokenizers.path("word_bpe_49k.json"), []
    for portion in (1 << 14, S.PORTION):
        rows = [r for b in S._encoder(path, 1, portion=portion)(iter([batch])) for r in b.to_pylist()]
        got.append(sorted(map(repr, rows)))
    assert got[0] == got[1]
    assert max(seen[:-1])[0] < 1 << 14 < seen[-1][0] and seen[0][1] < seen[-1][1] == 21
