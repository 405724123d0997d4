"""Extraction by path scores: against a brute-force version, by ablation, and on what attributes must not do."""

import random
import re
from html.parser import HTMLParser

import pytest

from tidemark.llm import html_text as P

WORDS = "This is a sentence, of some length; it goes on. " * 4
BODY = WORDS.strip()


@pytest.mark.parametrize("inner", ['<p title="The hidden truth">', '<p><a href="/hidden-valley">', '<p><a href="/p?id=menu">', '<p data-id="comments">', '<p data-hidden="false">', "<p data-class='sidebar' title=\"class='ad' style='display:none'\">", "<div class=legal>", "<div class=long-form>", "<p style='background:url(display:none)'>"])
def test_values_of_other_attributes_drop_nothing(inner):
    close = "</a></p>" if "<a" in inner else "</div>" if "<div" in inner else "</p>"
    assert P.main_text(f"<article><p>{WORDS}</p>{inner}Some words here.{close}<p>{WORDS}</p></article>") == f"{BODY}\n\nSome words here.\n\n{BODY}"


@pytest.mark.parametrize("outer", ["<div hidden>", "<div HIDDEN=''>", "<div aria-hidden=true>", "<div style='color:red; display : none'>", "<div role=navigation>", "<div class='x ad'>", "<div id=postComments>", "<div class=cookie-notice>"])
def test_parts_set_apart_go(outer):
    assert P.main_text(f"<article><p>{WORDS}</p>{outer}Some words here.</div><p>{WORDS}</p></article>") == f"{BODY}\n\n{BODY}"


def test_short_items_of_an_article_stay_and_lists_of_links_go():
    items = "".join(f"<li>item {i}</li>" for i in range(20))
    links = "".join(f"<li><a href=/{i}>Read this too</a></li>" for i in range(20))
    html = f"<article><h2 class=header>Head</h2><p>{WORDS}</p><ul>{items}</ul><div><ol>{links}</ol></div><p>Short.</p><p>{WORDS}</p></article>"
    want = ["Head", BODY, *[f"item {i}" for i in range(20)], "Short.", BODY]
    assert P.main_text(html).split("\n\n") == want
    cited = f"<article><p>{WORDS}<a href=/>See this.</a></p></article>"
    assert P.main_text(cited) == f"{BODY} See this."


def test_scores_decide_on_pages_with_an_article(monkeypatch):
    html = f"<body><div>Our best offers, now.</div><article><h1>Title</h1><p>{WORDS}</p><div class=promo><a href=x>Buy one</a> <a href=y>Buy two</a></div><p>{WORDS}</p></article><p>More from us.</p></body>"
    assert P.main_text(html) == f"Title\n\n{BODY}\n\n{BODY}"
    monkeypatch.setattr(P, "path_scores", lambda nodes: {e.path: 1.0 for e, _, _ in nodes})
    even = P.main_text(html)
    assert "best offers" in even and "Buy two" in even and "More from us" in even


# brute force: another parser, paths as lists of steps, sums by search

PARTS = "ad ads advert adverts advertisement banner comment comments footer menu nav navigation notice notices sidebar".split()
GONE = "nav footer aside form menu dialog fieldset script style".split()
INLINE = ("a", "b", "i", "span")


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.nodes, self.block, self.elements = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.elements += 1
        self.block += tag not in INLINE
        self.open.append((tag, dict(attrs).get("class", "") if tag not in ("article", "main") else "", self.elements))

    def handle_endtag(self, tag):
        self.block += tag not in INLINE
        self.open.pop()

    def handle_data(self, data):
        self.nodes.append((list(self.open), self.block, data))


def steps(opened, block=False):
    path = [(t, c) for t, c, _ in opened]
    while block and path and path[-1][0] in INLINE:
        path.pop()
    return path


def brute(html):
    reader = Reader()
    reader.feed(html)
    reader.close()
    article = lambda o: any(t in ("article", "main") for t, _, _ in o)
    out = lambda o: any(t in GONE for t, _, _ in o)
    part = lambda o: any(re.split("[^a-z]+", c)[-1] in PARTS for _, c, _ in o)
    inside = [(o, b, t) for o, b, t in reader.nodes if not out(o) and t.strip()]
    if not inside:
        return ""
    ratios, score, share = [], [], []
    for o, _, _ in inside:
        same = [(p, t) for p, _, t in inside if steps(p, True) == steps(o, True)]
        length = sum(len(t.strip()) for _, t in same)
        points = sum(t.count(x) for _, t in same for x in ".,;:!?")
        linked = sum(len(t.strip()) for p, t in same if any(x[0] == "a" for x in p))
        ratios.append((length / len(same), points / len(same)))
        share.append((1 - linked / length) * (0.05 if part(o) else 1))
    n = len(inside)
    near = lambda i, k: sum(ratios[min(max(j, 0), n - 1)][k] for j in (i - 1, i, i, i + 1)) / 4
    for i, (o, _, _) in enumerate(inside):
        alike = [near(j, 0) * (1 + near(j, 1)) for j in range(n) if steps(inside[j][0], True) == steps(o, True)]
        score.append(sum(alike) / len(alike) * share[i] * (4 if article(o) else 1))
    mean = sum(s * len(t) for s, (_, _, t) in zip(score, inside)) / sum(len(t) for _, _, t in inside)
    strong = [i for i in range(n) if score[i] >= 0.3 * mean]
    a, b = inside[strong[0]], inside[strong[-1]]
    holder = [x for x, y in zip(a[0], b[0]) if x == y]
    while holder and (holder[-1][0] in INLINE or holder[-1][0] == "p" or article(holder[:-1])):
        holder.pop()
    blocks = {}
    for i, (o, block, t) in enumerate(inside):
        if o[: len(holder)] != holder:
            continue
        backed = a[1] <= block <= b[1] or article(holder) or any(x[0] in ("h1", "h2") for x in o)
        if score[i] >= 0.3 * mean or backed and score[i] + 0.5 * share[i] * mean >= 0.3 * mean:
            blocks.setdefault(block, []).append(t)
    return "\n\n".join(" ".join("".join(x).split()) for _, x in sorted(blocks.items()))


@pytest.mark.parametrize("seed", range(60))
def test_extraction_equals_brute_force(seed):
    rng = random.Random(seed)
    marks = ["", "", "", " class=ad", " class=text", " class=box-comments", " class=lead"]

    def part(depth):
        tag = rng.choice("div section ul p p p h2 article nav a b span main footer".split())
        inner = []
        for _ in range(rng.randrange(1, 5)):
            if depth and rng.random() < 0.5:
                inner.append(part(depth - 1))
            inner.append(rng.choice(["some words. ", "more, of them ", "x", WORDS, "one long line of words without a stop "]))
        # paragraphs and links hold no blocks, so both parsers see one tree
        if tag in ("p", "a", "b", "span", "h2"):
            inner = [re.sub("<[^>]*>", "", x) for x in inner]
        return f"<{tag}{rng.choice(marks)}>{''.join(inner)}</{tag}>"

    html = "<html><body>" + "".join(part(4) for _ in range(rng.randrange(1, 6))) + "</body></html>"
    assert P.main_text(html) == brute(html)
