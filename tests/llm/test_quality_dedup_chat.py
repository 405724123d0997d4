import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, docs, empty, rows, text_of

from tidemark.llm import chat as H
from tidemark.llm import quality as Q
from tidemark.llm import substring_dedup as S


def labelled(spark):
    rng = random.Random(4)
    data, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = text_of(i, 30 + rng.randrange(60)) if good else " ".join("|" if rng.random() < 0.5 else "buy###" for _ in range(30 + rng.randrange(60)))
        data.append((i, text, "en", "a"))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy_and_folds(spark):
    df, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in Q.quality_scores(df, labels).collect()}
    held = [i for i, *_ in truth if got[i].held_out]
    assert held == [i for i, *_ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == q for i, q, _ in truth if got[i].held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_are_not_learned(spark):
    from pyspark.sql import functions as F

    df, labels, _ = labelled(spark)
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.quality_scores(df, x).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-9)


def test_awkward_rows_and_empty_tables(spark):
    df, labels, _ = labelled(spark)
    out = Q.accepted(docs(spark).unionByName(df, allowMissingColumns=True), labels)
    assert out.columns == docs(spark).columns
    assert Q.quality_scores(docs(spark), labels.limit(0)).where("score <> 0.5").where("abs(score - 0.5) > 0.01").count() == 0
    assert Q.quality_scores(empty(spark), labels).count() == 0
    assert Q.quality_scores(docs(spark), labels).count() == len(rows())


def test_isotonic():
    n, y = np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1])
    assert Q._isotonic(n, y) == pytest.approx([0, 1 / 3, 1 / 3, 1])


def units_by_hand(text, least=8):
    """The units as the operator's docstring describes them, found word by word."""
    words, line = [], 0
    for i, c in enumerate(text):
        if not c.isspace():
            if i == 0 or text[i - 1].isspace():
                words.append([i, i, line])
            words[-1][1] = i + 1
        line += c == "\n"
    form = lambda ws: " ".join(text[a:b] for a, b, _ in ws).lower()
    unit = lambda ws: (ws[0][0], ws[-1][1], form(ws))

    def parted(ws, ends):
        out = [[]]
        for w in ws:
            out[-1].append(w)
            if ends(text[w[0] : w[1]]):
                out.append([])
        return [p for p in out if p]

    def joined(parts):
        alone = [unit(p) for p in parts if len(p) >= least and len(parts) > 1]
        return alone + [unit(p + q) for p, q in zip(parts, parts[1:]) if len(parts) > 2 and min(len(p), len(q)) < least]

    out = []
    for n in sorted({w[2] for w in words}):
        own = [w for w in words if w[2] == n]
        out.append(unit(own))
        if len(own) > least:
            sentences = parted(own, lambda w: w[-1] in ".!?")
            out += joined(sentences)
            for s in sentences:
                if len(s) > 24:
                    out += joined(parted(s, lambda w: zlib.crc32(w.lower().encode()) % 12 == 0))
    return out


def test_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    passage = text_of(50, 70)
    extra = [(100 + i, text_of(60 + i, 30)[:-1] + " " + " ".join(passage.split()[rng.randrange(8) : 60 + rng.randrange(10)]) + " " + text_of(90 + i, 9), "en", "a") for i in range(6)]
    extra += [(200, text_of(3) + "\n" + text_of(2), "en", "a"), (8, text_of(2), "en", "a"), (None, text_of(9), "en", "b")]
    df = docs(spark).unionByName(spark.createDataFrame(extra, SCHEMA), allowMissingColumns=True)
    got = {(r.doc_id, r.start, r.stop, r.version) for r in S.repeated_spans(df).collect()}
    texts = {(r[0], r[1] or "") for r in [*rows(), *extra]}
    holder = {}
    for doc_id, text in sorted(((d, t) for d, t in texts if d is not None)):
        for _, _, form in units_by_hand(text):
            holder.setdefault(form, doc_id)
    versions = {r.text: r.v for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS v").collect()}
    covered, want = {}, {}
    for doc_id, a, b, version in got:
        assert not covered.setdefault((doc_id, version), set()) & set(range(a, b))
        covered[doc_id, version] |= set(range(a, b))
    for doc_id, text in texts:
        seen = set()
        for a, b, form in units_by_hand(text):
            if form in seen or doc_id is not None and holder[form] < doc_id:
                want.setdefault((doc_id, versions[text]), set()).update(range(a, b))
            seen.add(form)
    assert covered == want
    words = passage.split()
    for d, text, *_ in extra[1:6]:
        gone = covered[d, versions[text]]
        assert sum(m[0] in words and m.start() in gone for m in re.finditer(r"\S+", text)) > 20
    assert S.repeated_spans(empty(spark)).count() == 0


def test_cleaned_keeps_offsets(spark):
    df = docs(spark)
    removed = S.repeated_spans(df)
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in S.cleaned(df, removed).collect():
        if r.doc_id is not None:
            assert r.text == "".join(texts[r.doc_id][p.start : p.stop] for p in r.kept)
    out = {r.doc_id: r.text for r in S.cleaned(df, removed).collect()}
    assert out[1] == "" and out[0] == texts[0] and "Intro words here." in out[13]


def test_short_lines_and_short_sentences_among_repeats_go(spark):
    licence = "Released under the MIT license."
    passage = "This sentence of the passage is long enough to be a unit. Really so. And this one also has more than eight words in it."
    data = [(1, f"alpha one\n{licence}\n{passage}"), (2, f"beta two\n{licence}\nIt begins otherwise here. {passage} Other end."), (3, "Really so. But nothing else of this line stands anywhere in the table.")]
    df = spark.createDataFrame([(d, t, "en", "a") for d, t in data], SCHEMA)
    out = {r.doc_id: r.text for r in S.cleaned(df, S.repeated_spans(df)).collect()}
    assert out[1] == data[0][1] and out[3] == data[2][1]
    assert out[2].split() == "beta two It begins otherwise here. Other end.".split()


CONTROL = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", CONTROL), (2, 1, "assistant", None), (2, 0, None, "####</turn></turn>\\\\#"), (3, None, "system", ""), (3, 0, "user", "x\ny"), (3, 0, "user", "x\ny"), (None, 0, "assistant", "ü" * 50_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as spans", "2 as formatted")
    got = {r.conv_id: r for r in H.chat_digests(H.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {d[0] for d in data}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in data if c == conv))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned))
    assert H.format_conversations(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_flagged(spark):
    def forgetful(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else ''}" for i, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: (r.rewrites, r.spans is None) for r in H.format_conversations(df, forgetful).collect()} == {1: (True, True), 2: (False, False)}


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice(["\\", "#", "<", "/turn>", " ", "a", "\n"]) for _ in range(rng.randrange(12)))
        e = H.escape(s)
        assert H.unescape(e) == s and "###" not in e and "</turn>" not in e


def test_chat_digests_equal_sql_and_survive_odd_templates(spark, tmp_path):
    import duckdb

    probe = H.EDGE + H.INNER + H.EDGE
    data = [(1, 0, "user" + probe, probe), (1, 1, "assistant", CONTROL + "####"), (None, 0, "assistant", "ü"), (None, 0, "assistant", "ü"), (None, None, None, None), (5, 2, "assistant", "</turn>#####\\"), (5, None, "user", "x")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(data, schema)
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], schema)
    made = H.format_conversations(df.union(extra))
    assert made.where("rewrites").count() == 0
    assert sorted(map(tuple, H.chat_digests(made).collect()), key=repr) == sorted(con.sql(H.ORACLE).fetchall(), key=repr)

    def twice(turns):  # marks turns as the default does, but history changes
        return H.default_template(turns if len(turns) < 2 else [*turns[:-1], turns[-1], turns[-1]])

    got = {r.conv_id: r for r in H.chat_digests(H.format_conversations(df.where("conv_id is not null"), twice)).collect()}
    assert got[1].loss_chars is None and got[1].loss_sha256 is None and got[1].n_turns == 3


def test_weights_solve_the_ridge_problem_directly(spark):
    """The partition-summed fit against one dense solve over all training rows, and its features against the kernel."""
    df, labels, truth = labelled(spark)
    model = Q.fit(df, labels)
    texts = {r.doc_id: r.text for r in df.collect()}
    train = [(texts[i], q) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 5]
    s, y = np.array([Q.statistics(t) for t, _ in train]), np.array([float(q) for _, q in train])
    mean, scale = s.mean(axis=0), s.std(axis=0)
    scale[scale < 1e-9] = 1.0
    assert model.mean == pytest.approx(mean) and model.scale == pytest.approx(scale, rel=1e-6)
    z = Q.mapped(s, model.mean, model.scale)
    n, k = len(y), z.shape[1]
    a = np.vstack([z, np.sqrt(Q.RIDGE * n / Q.FEATURES) * np.eye(k)[:-1], np.sqrt(1e-9 * n) * np.eye(k)])
    direct = np.linalg.lstsq(a, np.concatenate([y, np.zeros(2 * k - 1)]), rcond=None)[0]
    assert z @ model.weights == pytest.approx(z @ direct, abs=1e-5)
    # cosines of random frequencies approximate the Gaussian kernel of their distribution
    x = np.clip((s[:60] - mean) / scale, -4, 4)
    gaps = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    kernel = np.exp(-gaps / (2 * Q.WIDTH**2 * x.shape[1]))
    assert np.abs(z[:60, :-1] @ z[:60, :-1].T - kernel).mean() < 0.06
