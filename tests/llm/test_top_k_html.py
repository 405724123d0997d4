import math
import random

import numpy as np
import pytest

from tidemark.llm import html_text as P
from tidemark.llm import top_k as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(n, d)) * 0.3)]
    same = [float(x) for x in rng.normal(size=d) * 0.3]
    rows += [(n + i, same, 1) for i in range(40)]
    return rows + [(1000, None, 0), (1050, [float("nan")] * d, 0), (1100, [None] + [1.0] * (d - 1), 0), (1150, [float("inf")] * d, 0), (1200, [0.5, 0.25], 0), (1250, [0.0] * d, 0), (None, [0.1] * d, 0), (50, [0.9] * d, 0)]


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 37])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "VECTOR_BLOCK", block)
    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    df = spark.createDataFrame(vectors(), SCHEMA).selectExpr("*", "1 as v", "2 as block", "3 as dim")
    got = sorted(map(tuple, T.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    assert got == brute(vectors())
    assert T.top_k(df.limit(0), df.limit(0)).count() == 0


def test_many_classes_of_norms_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_BROADCAST", 0)
    monkeypatch.setattr(T, "VECTOR_BLOCK", 37)
    df = spark.createDataFrame(vectors(), SCHEMA)
    assert sorted(map(tuple, T.top_k(df, df.where("vec_id % 50 = 0")).collect())) == brute(vectors())


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_groups_of_small_norms_get_no_queries(spark, monkeypatch, spread):
    monkeypatch.setattr(T, "VECTOR_BLOCK", 20)
    monkeypatch.setattr(T, "QUERY_BLOCK", 4)
    monkeypatch.setattr(T, "GROUP", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v * 2.0 ** (rng.random() * spread * 2 - spread)], 0) for i, v in enumerate(np.abs(rng.normal(size=(400, 4))))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, T.top_k(df, df.where("vec_id % 50 = 0")).collect())) == brute(rows)
    sent = T.searched(df, df.where("vec_id % 50 = 0")).where("vec_id is null").count()
    groups = 8 * 10
    assert 8 <= sent < groups / 2 if spread else 8 <= sent <= groups


def test_threshold_stops_early_and_refuses_blocks():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(4000, 2)) * 256).astype(np.int64)
    query = np.array([3, 5])
    best, scored, depth = T.threshold_search(T.Block(np.arange(4000), rows), -1, query, 5, [])
    scores = rows @ query
    assert [s for s, _ in best] == sorted(scores, reverse=True)[:5] and 0 < scored < 1000 and depth < 1000
    low = T.Block(np.arange(5000, 5100), rows[:100] // 100)
    assert T.threshold_search(low, -1, query, 5, best) == (best, 0, 0)


def test_large_components_are_summed_exactly(spark):
    data = [(0, [float(2**40), 1.0, 1.0], 0), (1, [float(2**10), 3.0, 0.0], 0), (2, [float(2**10), 2.0, 2.0], 0), (3, [1e300, 0.0, 0.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in T.top_k(df, df.where("vec_id = 0"), k=3, scale=1).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 2, 2**50 + 4), (0, 3, 1, 2**50 + 3)]


P1 = "<p>This is a long paragraph, with commas, and text. It goes on for a while; it is content.</p>"
TEXT1 = "This is a long paragraph, with commas, and text. It goes on for a while; it is content."


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f'<nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy, now. Cheap!</div><article><h1>Title</h1>{P1}<p>Short.</p></article><footer>&copy; site, all rights.</footer>', f"Title\n\n{TEXT1}\n\nShort."),
        (f'<header><p>Motto of the site, long enough to matter.</p></header><div id="menu"><ul><li>Home<li>About</ul></div><div class="content"><h2>Head</h2>{P1 * 2}</div><div class="sidebar"><p>Other, long. Stuff.</p></div><div class="comments"><p>I agree, totally. Nice.</p></div>', f"Head\n\n{TEXT1}\n\n{TEXT1}"),
        (f"<article>{P1}<form><label>Name, please.</label></form><script>var t='</p>';</script><!-- no --><p>a &amp; b&nbsp;c &lt;d&gt;<br>e   f</p></article>", f"{TEXT1}\n\na & b c <d> e f"),
        (f'<main><section><p><b>Bold <i>start</i></b> of it, yes.<p>Unclosed, next.</section>{P1}</main><aside>Side, note. Here.</aside>', f"Bold start of it, yes.\n\nUnclosed, next.\n\n{TEXT1}"),
        ("", ""),
        ("<nav>Only a menu</nav>", ""),
    ],
)
def test_main_text(body, want):
    assert P.main_text(page(body)) == want


def test_broken_and_long_pages():
    assert P.main_text("<p>plain, text. here <b") == "plain, text. here"
    assert P.main_text("no tags at all, just words.") == "no tags at all, just words."
    long = page("<article>" + P1 * 20_000 + "</article>")
    assert P.main_text(long).count(TEXT1) == 20_000
    P.main_text("<a \"" * 3000)
    P.main_text("<div>" * 3000 + "x")


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", page(f"<article>{P1}</article>"), 5), (2, None, None, 6), (None, "v", "", 7)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in P.extract_pages(df).collect()}
    assert got == {1: ("u", TEXT1, len(TEXT1)), 2: (None, "", 0), None: ("v", "", 0)}
    assert P.extract_pages(df.limit(0)).count() == 0


SENTENCES = "This is a sentence, of some length; it goes on. " * 4


def tables_by_html_parser(html):
    """Path table of well-formed html, by another parser and whole path strings."""
    from html.parser import HTMLParser

    table = {}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack = []

        def handle_starttag(self, tag, attrs):
            self.stack.append(tag)

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            row = table.setdefault("/".join(self.stack), [0, 0, 0, 0])
            n = len(data.strip())
            row[0], row[1], row[2], row[3] = row[0] + n, row[1] + sum(c in ".,;:!?…。、，！？；：" for c in data), row[2] + 1, row[3] + n * ("a" in self.stack)

    Reader().feed(html)
    return sorted(map(tuple, table.values()))


def test_path_table_equals_brute_force():
    rng = random.Random(8)

    def part(depth):
        tag = rng.choice("div section ul ol b a h2".split())
        return f"<{tag}>" + "".join(part(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["some words. ", "more, of them ", "x"]) for _ in range(3)) + f"</{tag}>"

    for _ in range(40):
        html = "<body>" + "".join(part(4) for _ in range(3)) + "</body>"
        assert sorted(P.path_table(P.text_nodes(html)).values()) == tables_by_html_parser(html)


def test_scores_decide_where_no_element_names_the_article(monkeypatch):
    html = f"<body><div>Our best offers</div><ul><li><a href=x>One</a></li></ul><section><h1>Title</h1><p>{SENTENCES}</p><p>Short.</p><p>{SENTENCES}</p></section><div>More from us</div></body>"
    whole = SENTENCES.strip()
    assert P.main_text(html) == f"Title\n\n{whole}\n\nShort.\n\n{whole}"
    monkeypatch.setattr(P, "path_scores", lambda nodes: {e.path: 1.0 for e, _, _ in nodes})
    assert "Our best offers" in P.main_text(html) and "More from us" in P.main_text(html)


def test_parts_of_an_article_stay_together():
    whole = SENTENCES.strip()
    assert P.main_text(f"<main><article><p>{SENTENCES}</p></article><section><p>{SENTENCES}</p></section></main>") == f"{whole}\n\n{whole}"
    assert P.main_text(f"<body><div><div class=intro>short lead</div><div class=body>{SENTENCES}</div></div><div><a href=x>link</a></div></body>") == f"short lead\n\n{whole}"
    assert P.main_text(f"<body><article>{SENTENCES}</article><article>Two. {SENTENCES}</article></body>") == f"{whole}\n\nTwo. {whole}"
    assert P.main_text(f"<article><p class='share-price'>{SENTENCES}</p><div class='post-comments'>Me too.</div><div class='ad-974'>Buy.</div></article>") == whole


def test_deep_nesting_takes_memory_in_proportion():
    import tracemalloc

    html = "<div>" * 50_000 + "Deep text, here." + "</div>" * 50_000
    tracemalloc.start()
    assert P.main_text(html) == "Deep text, here."
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
