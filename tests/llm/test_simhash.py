import re

import numpy as np
import pytest
import xxhash
from helpers import docs, empty, rows

from tidemark.llm import simhash as S
from tidemark.operators.components import connected_components


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_documents(spark):
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.simhash_components(docs(spark)).collect()}
    fps = [(r[0], fingerprint(r[1] or "")) for r in rows()]
    distinct = sorted({f for _, f in fps})
    roots = closure(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for d, f in fps:
        if d is not None:
            least[roots[f]] = min(least.get(roots[f], d), d)
    assert got == {(d, f, least.get(roots[f])) for d, f in fps}
    assert S.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("max_bucket", [1, 3, 64])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_equal_brute_force(spark, bits, max_bucket):
    rng = np.random.default_rng(7)
    fps = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(25):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    got = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in S.links(table, bits, max_bucket).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    want = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits]
    assert closure(fps, got) == closure(fps, want)


def test_pivot_distances_bound_the_distance():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 50, dtype=np.uint64)
    d = S.pivot_distances(x).astype(int)
    gap = np.abs(d[:, None] - d[None]).max(axis=2)
    assert (gap <= np.bitwise_count(x[:, None] ^ x[None])).all()


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    df = docs(spark)
    out = S.deduplicated(df, words=5)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    assert 0 in kept and 1 not in kept and None in kept and kept.count(8) == 1


def test_one_row_stays_of_groups_with_null_and_shared_ids(spark):
    from helpers import SCHEMA, text_of

    a, b = text_of(1), text_of(2)
    data = [(7, a), (7, b), (3, b), (None, a), (None, a), (None, text_of(3)), (None, text_of(3)), (9, text_of(4)), (9, text_of(4)), (5, None), (6, ""), (None, "")]
    out = S.deduplicated(spark.createDataFrame([(d, t, "en", "a") for d, t in data], SCHEMA))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(7, a), (3, b), (None, text_of(3)), (9, text_of(4)), (5, None)], key=repr)
    assert S.deduplicated(empty(spark)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df.repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_edited_copies_go_and_clean_documents_stay(spark):
    from helpers import SCHEMA, text_of

    data = []
    for i in range(12):
        base = text_of(100 + i, 150).split()
        data.append((10 * i, " ".join(base)))
        for j in range(1, 4):  # some copies are similar enough, some are not
            edited = list(base)
            for at in range(j, 150, (150, 60, 25)[j - 1]):
                edited[at] = f"edit{i}x{j}x{at}"
            data.append((10 * i + j, " ".join(edited)))
    line = "this very common line stands at the head of most documents of the table and links none"
    data += [(1000 + i, line + " " + text_of(500 + i, 40)) for i in range(100)]
    # a large group of near copies
    base = text_of(99, 200).split()
    data += [(2000 + i, " ".join(base[: 2 * i] + [f"one{i}"] + base[2 * i + 1 :])) for i in range(90)]
    sets = {d: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in data}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = closure(sorted(sets), pairs)
    far = [(a, b) for a, b in pairs if (fingerprint(dict(data)[a], 5) ^ fingerprint(dict(data)[b], 5)).bit_count() > 2]
    assert len(far) > 20 and any(len({roots[10 * i + j] for j in range(4)}) > 1 for i in range(12))
    df = spark.createDataFrame([(d, t, "en", "a") for d, t in data], SCHEMA)
    assert {r.doc_id: r.component_id for r in S.near_copies(df).collect()} == roots
    assert sorted(r.doc_id for r in S.deduplicated(df).collect()) == sorted(set(roots.values()))
    assert S.near_copies(empty(spark)).count() == 0


def test_many_edited_copies_of_one_text_cost_few_pairs(spark, monkeypatch):
    """Copies with none to six edited words: an exact join, though hardly any pair is listed once the original has been met."""
    import random

    from helpers import SCHEMA, text_of

    rng = random.Random(5)
    base, data = text_of(77, 150).split(), []
    for i in range(240):
        edited = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6]) if i else 0):
            edited[at] = f"new{rng.randrange(12)}"
        data.append((i, " ".join(edited)))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(146)} for d, t in data}
    roots = closure(sorted(sets), [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert 2 < len(set(roots.values())) < 200
    listed, verified = [], S._verified

    def counted(rows, words, nodes, pairs):
        listed.append(pairs.distinct().count())
        return verified(rows, words, nodes, pairs)

    monkeypatch.setattr(S, "_verified", counted)
    got = S.near_copies(spark.createDataFrame([(d, t, "en", "a") for d, t in data], SCHEMA))
    assert {r.doc_id: r.component_id for r in got.collect()} == roots
    assert sum(listed) < 2 * sum(len(s) // 5 + 1 for s in sets.values())


def test_many_texts_to_read_again_are_joined_by_a_shuffle(spark, monkeypatch):
    want = sorted(map(tuple, S.near_copies(docs(spark), words=5).collect()), key=repr)
    monkeypatch.setattr(S, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, S.near_copies(docs(spark), words=5).collect()), key=repr) == want


def test_pairs_by_size_are_all_that_may_match(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), node, size := int(rng.integers(5, 300)), int(rng.integers(0, size // 5 + 1)), node) for node in range(240)]
    entries = spark.createDataFrame(rows, "shingle long, node long, size int, at long, root long")
    got = S._met_by_size(entries).where(S._may_match("l", "r")).select(F.col("l.node"), F.col("r.node")).collect()
    pairs = {frozenset(map(int, r)) for r in got}
    want = set()
    for s, a, n, i, _ in rows:
        for t, b, m, j, _ in rows:
            if a < b and s == t and min(n, m) * 5 >= max(n, m) * 4 and min(n - i, m - j) * 9 >= (n + m) * 4:
                want.add(frozenset((a, b)))
    assert pairs == want and len(got) == len(pairs) > 100
