import hashlib
import re

import duckdb
import pytest
from helpers import docs, empty, rows, text_of

from tidemark.llm import decontaminate as D
from tidemark.llm import mixing as M

ITEMS = [(1, text_of(2, 60)), (2, "one two"), (3, None), (4, "!!"), (10, " ".join(text_of(3).split()[5:25])), (11, "one")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs_, items, size=10):
    out = []
    for row in docs_:
        w, hit, found = words(row[1]), set(), set()
        for item, text in items:
            v = words(text)
            for win in {tuple(v[i : i + size]) for i in range(max(1, len(v) - size + 1))} if v else ():
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(item))
        out.append((row[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_broadcast", [D.MAX_BROADCAST, 0])
def test_windows_equal_brute_force(spark, max_broadcast):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.digests(D.contaminated(docs(spark), items, max_broadcast=max_broadcast)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows(), ITEMS)


def test_empty_tables_and_clean(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert D.digests(D.contaminated(empty(spark), items)).count() == 0
    assert sorted(map(tuple, D.digests(D.contaminated(docs(spark), none)).collect()), key=repr) == brute(rows(), [])
    out = D.clean(docs(spark), items)
    dirty = {r[0] for r in brute(rows(), ITEMS) if r[5]}
    assert out.columns == docs(spark).columns and sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == sorted(r[0] for r in rows() if r[0] is not None and r[0] not in dirty)


def corpus(spark):
    data = [(i, " ".join(["w"] * (1 + i % 9)), f"s{0 if i % 3 else i % 7}") for i in range(1200)] + [(5000, None, None), (5001, "", "s1"), (5002, "x y", None)]
    return spark.createDataFrame(data, "doc_id long, text string, source string")


def null_ids(spark):
    """Twelve sources of forty rows, most without an id, some rows the same, and ids that texts share."""
    data = [(None if i % 4 else i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(5 + i % 30 + s)), f"s{s}") for s in range(12) for i in range(40)]
    data += [(1, "same row here", "s0")] * 9 + [(2, f"other text {i}", "s1") for i in range(9)] + [(None, None, "s2")] * 5
    return spark.createDataFrame(data, "doc_id long, text string, source string")


@pytest.mark.parametrize("max_broadcast", [M.MAX_BROADCAST, 0])
@pytest.mark.parametrize("share", [1.0, 0.5])
@pytest.mark.parametrize("made", ["corpus", "null_ids"])
def test_mix_equals_sql(spark, tmp_path, made, share, max_broadcast):
    df = globals()[made](spark)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = sorted(map(tuple, M.mix(df, budget_share=share, max_broadcast=max_broadcast).collect()), key=repr)
    sql = M.ORACLE.replace("> 2.0 AS high", f"* {share} > 2.0 AS high").replace("weight * total / t", f"weight * ({share} * total) / t")
    assert got == sorted(con.sql(sql).fetchall(), key=repr)
    if made == "null_ids":
        assert {r[1] for r in got} == {f"s{i}" for i in range(12)}


def test_limits_and_targets(spark):
    df = corpus(spark)
    total = df.selectExpr("sum(size(filter(split(coalesce(text, ''), ' '), x -> x <> '')))").first()[0]
    plan = M.mixing_plan(df, max_repetition=1.5).collect()
    assert max(r.epochs for r in plan) <= 1.5 + 1e-4
    for r in plan:
        n = M.mix(df, max_repetition=1.5).where(f"source = '{r.source}'").groupBy().sum("n_tokens").first()[0] or 0
        assert abs(n - r.weight * total) <= 10
    even = M.mixing_plan(df, max_repetition=None, target_entropy=1.5).collect()
    import math

    assert -sum(r.weight * math.log(r.weight) for r in even if r.weight > 0) == pytest.approx(1.5, abs=1e-3)
    with pytest.raises(ValueError):
        M.mixing_plan(df, max_repetition=None)


def test_nothing_is_dropped_without_a_budget(spark):
    df = docs(spark)
    out = M.resampled(df, max_repetition=2.0, budget_share=None)
    assert out.columns == df.columns and out.distinct().count() == df.distinct().count()
    plan = M.mixing_plan(corpus(spark), max_repetition=2.0, budget_share=None).where("weight > 0").collect()
    assert min(r.epochs for r in plan) >= 1 and 1.9 < max(r.epochs for r in plan) <= 2.001
    assert M.mix(empty(spark)).count() == 0 and M.resampled(empty(spark), budget_share=None).count() == 0
