"""Host rules, spelling variants and fill-in-the-middle against plain Python and DuckDB."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from helpers import LONG, SCHEMA, docs, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import fill_middle, host_rules, queries, spelling

SPACES = "[\x20\x09-\x0d]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_host_rules", "op12_spelling_variants", "op13_fill_in_middle"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(want.columns) == sorted(got.columns)
    assert plain(got, *want.columns) == sorted(want.fetchall(), key=repr)


# host rules


def measures(text):
    w = [x for x in re.split(SPACES, text or "") if x]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    under = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(under)


def test_measures_match_brute_force(spark):
    more = [(20, "a b c d e f a b c d e " * 9, "en", "a"), (21, "x\nx\n \n\ny\nx", "en", "a"), (22, "# * $ | <b> & % a b \x0b c", "en", "b"), (23, "one two three four five", "en", "b"), (24, "z " * 5000, "en", "b")]
    table = docs(spark).unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    got = plain(host_rules.measured(table), "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((d, s or None, *measures(t)) for d, t, _, s in rows() + more), key=repr)


def hosts(spark):
    """A bad host, two good ones, one bad document alone on its host, and one without a host."""
    good = " ".join(f"word{i}" for i in range(30))
    made = [(i, good + f" {i}", "bad") for i in range(4)] + [(i, "short", "bad") for i in range(10, 90)]
    made += [(i, good + f" {i}", f"good{i % 20}") for i in range(100, 1100)] + [(2000, "short", "tiny"), (2001, good, "tiny"), (2002, good, None), (2003, good, "")]
    return spark.createDataFrame(made, "doc_id long, text string, source string")


@pytest.mark.parametrize("most", [100_000, 0])
def test_verdicts_follow_hosts(spark, most):
    got = {r.doc_id: r for r in host_rules.judged(hosts(spark), max_broadcast=most).collect()}
    assert len(got) == 1088
    assert [d for d, r in sorted(got.items()) if r.kept] == [*range(100, 1100), 2001, 2002, 2003]
    assert got[0].refused == ["few_words"] and not got[0].base_failed
    assert got[2000].base_failed and got[2000].refused is None


def test_prior_is_the_beta_binomial_of_the_moments(spark):
    rates = host_rules.host_rates(host_rules.measured(hosts(spark))).where("rule = 'few_words'").collect()
    n, k = [r.n for r in rates], [r.failures for r in rates]
    total, mean = sum(n), sum(k) / sum(n)
    seen = sum(x * (y / x - mean) ** 2 for x, y in zip(n, k)) / (mean * (1 - mean))
    rho = (seen - (len(n) - 1)) / (total - sum(x * x for x in n) / total - (len(n) - 1))
    strength = min(max(1 / rho - 1, host_rules.WEAKEST), host_rules.STRONGEST)
    for r in rates:
        assert r.prior_strength == pytest.approx(strength) and r.prior_mean == pytest.approx(mean)
        assert r.shrunk == pytest.approx((r.failures + strength * mean) / (r.n + strength))
    tiny = next(r for r in rates if r.host == "tiny")
    assert mean < tiny.shrunk < tiny.rate == 0.5


def test_hosts_alike_are_judged_by_the_mean(spark):
    rates = host_rules.host_rates(host_rules.measured(docs(spark), host_col="lang"))
    assert all(0 <= r.shrunk <= 1 for r in rates.collect())
    one = spark.createDataFrame([(1, "short", "a"), (2, "short", "a")], "doc_id long, text string, source string")
    assert [r.kept for r in host_rules.judged(one).collect()] == [False, False]
    assert host_rules.judged(empty(spark)).collect() == []


def test_host_of_urls(spark):
    found = {"https://www.A.example:80/x": "a.example", "http://u@b.example?q": "b.example", "src3": "src3", "": None, None: None, "WWW.c.example": "c.example"}
    df = spark.createDataFrame(list(found.items()), "place string, host string")
    assert [r.got for r in df.select(host_rules.host_of(df.place).alias("got")).collect()] == list(found.values())


def test_long_text_is_measured_whole(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + " " + " ".join(f"w{i}" for i in range(7))
    df = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    r = host_rules.measured(df).first()
    assert (r.n_words, r.n_repeat_words) == (200_007, 14)


# spelling variants


def near(a, b):
    """Exactly one error between two words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def expected(table):
    n = Counter()
    for d, text, *_ in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, UPPER.lower()))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form = {}
    out = []
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out.append((w, n[w], len(others), form[w], n.get(form[w])))
    root = lambda w: root(form[w]) if form[w] else w
    return sorted(((*r, root(r[0])) for r in out), key=repr)


def spelled(seed=5):
    """Words with their misspellings, rows of a table."""
    rng = random.Random(seed)
    letters = "abcdeé÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "Aaaaaaab"]
    out = []
    for i in range(300):
        text = []
        for _ in range(30):
            w = words[min(int(rng.expovariate(0.2)), len(words) - 1)]
            k = rng.randrange(len(w))
            text.append(rng.choice([w] * 30 + [w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
        out.append((i, " ".join(text), "en", "a"))
    return out


@pytest.mark.parametrize("target", [20_000, 40])
def test_variants_match_brute_force(spark, target):
    table = rows() + spelled()
    df = docs(spark).unionByName(spark.createDataFrame(spelled(), SCHEMA), allowMissingColumns=True)
    got = plain(spelling.variants(spelling.word_counts(df), target=target), "word", "n", "n_near", "form", "form_n", "root")
    assert got == expected(table)
    assert any(r[3] for r in got)


def test_pairs_come_once_and_both_ways(spark):
    words = spelling.word_counts(spark.createDataFrame(spelled(8), SCHEMA))
    pairs = [(r.word, r.near) for r in spelling.near_pairs(words, target=30).collect()]
    assert len(pairs) == len(set(pairs)) > 100
    assert {(b, a) for a, b in pairs} == set(pairs)


def test_a_half_that_all_words_share_is_split(spark):
    rng = random.Random(3)
    made = {"abcdefg" + "".join(rng.choice("xyz") for _ in range(7)): rng.randrange(2, 99) for _ in range(1500)}
    words = spark.createDataFrame(list(made.items()), "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_pairs(words, target=200).collect()}
    assert got == {(a, b) for a in made for b in made if near(a, b)}


def test_chains_of_forms_end_at_the_root(spark):
    chain = [("w" * 20 + "abcdefg"[: 7 - i], 10**i) for i in range(8)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}


def test_no_words(spark):
    assert spelling.variants(spelling.word_counts(empty(spark))).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=30), st.text("abé", min_size=2, max_size=6), st.integers(0, 6))
def test_automaton_numbers_and_completions(words, asked, cut_at):
    ordered = sorted(words)
    automaton = spelling.Automaton(ordered)
    for i, w in enumerate(ordered):
        assert automaton.walked(w, automaton.root, 0)[1] == i
    exact, rest = asked[:cut_at], asked[cut_at:]
    found = list(automaton.one_error(exact, rest))
    assert sorted(found) == [(w, i) for i, w in enumerate(ordered) if w.startswith(exact) and near(w[len(exact) :], rest)]


def test_automaton_is_minimal():
    # both endings are shared by both beginnings: five states, not eight
    assert len(spelling.Automaton(["tap", "taps", "top", "tops"]).edges) == 5


# fill in the middle


def middle(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


ODD = ["\n", "\n\n\n", "a\r\nb\n", "x <S> y\nz", "x <P\n> y\nz", "<\n<P\nM>\n<M\n", "é\nü\U0001f600\n z\x00w\n" * 9, "'\"\n;--\n%", LONG + "\n" + LONG]


@pytest.mark.parametrize("rate", [100, 40])
def test_middles_match_brute_force(spark, rate):
    more = [(100 + 10 * i + k, t, "en", "a") for i, t in enumerate(ODD) for k in range(10)]
    df = docs(spark).unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    got = plain(fill_middle.restored(fill_middle.fill_in_middle(df, rate=rate)), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert got == sorted((middle(d, t, rate) for d, t, *_ in rows() + more), key=repr)


def test_batches_are_handed_on_in_slices(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "", "x" * 50, "y"]})
    monkeypatch.setattr(fill_middle, "SLICE", 10)
    parts = [p["text"].to_pylist() for p in fill_middle._slices(batch, "text")]
    assert parts == [["abc", None, "", "x" * 50], ["y"]]
    assert list(fill_middle._slices(batch.slice(0, 0), "text")) == []


def test_sentinels_that_could_be_misread_are_refused(spark):
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("a<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs(spark), sentinels=bad)
    got = fill_middle.restored(fill_middle.fill_in_middle(docs(spark), sentinels=("<|a'b|>", "<|s|>", "<|m|>")), sentinels=("<|a'b|>", "<|s|>", "<|m|>"))
    assert plain(got, "doc_id", "restored") == sorted(((d, t or "") for d, t, *_ in rows()), key=repr)


def test_empty_table_gives_no_rows(spark):
    assert fill_middle.restored(fill_middle.fill_in_middle(empty(spark))).collect() == []
