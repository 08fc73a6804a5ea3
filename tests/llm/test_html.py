"""Main text of page layouts that no training page has."""

import time

import numpy as np
import pytest

from cohortkit.llm import htmltext

TEXTS = ["The council met on Tuesday to discuss the new bridge. It will cost a great deal of money, and nobody knows who pays.",
         "A second meeting is planned for May. Residents may send letters until then, or speak at the hearing in person.",
         "The mayor said that work could begin next year, if the state agrees."]
BODY = "<h1>Bridge plan</h1>" + "".join(f"<p>{x}</p>" for x in TEXTS)
NAV = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
FOOT = '<div class="footer">&copy; 2020 The Paper. All rights reserved.</div>'
READERS = '<div class="comments"><p>First! I do not agree with this at all, said a reader.</p><p>Me neither.</p></div>'
WANT = "\n".join(["Bridge plan", *TEXTS])
LAYOUTS = {
    "div": f'{NAV}<div class="x1"><div class="inner">{BODY}</div></div>{FOOT}',
    "bare": f"{NAV}{BODY}{FOOT}",
    "cell": f"<table><tr><td>{NAV}</td><td>{BODY}</td></tr></table>{FOOT}",
    "section": f"{NAV}<section>{BODY}</section>{READERS}{FOOT}",
    "side bar wrapper": f'{NAV}<div class="sidebar-left"><article>{BODY}</article></div>{FOOT}',
    "popular post": f'{NAV}<article class="post popular">{BODY}</article>{READERS}{FOOT}',
    "id main": f'<header><a href="/">The Paper</a></header><div id="main">{BODY}</div>{READERS}{FOOT}',
    "deep": f'{NAV}<div><div><div class="zq"><div>{BODY}</div></div></div></div><aside class="related"><ul><li>'
            f'<a href="a">Other story here</a></li><li><a href="b">One more</a></li></ul></aside>{FOOT}',
    "notice first": f'<div class="cookie">We use cookies. Accept?</div>{NAV}<div class="grid">{BODY}</div>{FOOT}',
    "two asides": f'<aside><a href="a">Ad story</a> <a href="b">More</a></aside><section class="col">{BODY}</section>'
                  f'<aside class="sidebar"><p>Sign up for mails.</p></aside>{READERS}',
    "nothing else": BODY,
}


def words(rng, k):
    return " ".join("".join(rng.choice(list("abcdeilmnorstu"), int(rng.integers(2, 9)))) for _ in range(k))


def paged(i, tag):
    rng = np.random.default_rng(i)
    parts = "".join(f"<p>{words(rng, int(rng.integers(15, 60)))}. {words(rng, 6)}.</p>" for _ in range(int(rng.integers(2, 6))))
    return (f'<html><body><nav><ul><li><a href="/">{words(rng, 1)}</a></li><li><a href="/b">{words(rng, 2)}</a></li></ul></nav>'
            f'<div class="ad">{words(rng, 5)}.</div><{tag}><h1>{words(rng, 4)}</h1>{parts}</{tag}><footer>{words(rng, 4)}</footer></body></html>')


@pytest.fixture(scope="module", params=["article", "div"])
def trees(request):
    """Fitted on pages of one layout, with a marked element or without any."""
    return htmltext.fit_pages([paged(i, request.param) for i in range(80)])


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts_that_no_training_page_has(trees, layout):
    got = htmltext.main_texts(trees, [f"<html><body>{LAYOUTS[layout]}</body></html>"])[0]
    assert all(t in got for t in TEXTS) and "a reader" not in got and "rights reserved" not in got and "cookies" not in got


def test_most_layouts_are_read_exactly(trees):
    pages = [f"<html><body>{x}</body></html>" for x in LAYOUTS.values()]
    assert sum(t == WANT for t in htmltext.main_texts(trees, pages)) >= 9


def test_elements_that_never_end():
    started = time.time()
    nodes, blocks = htmltext.parse("<svg>" * 50_000 + "<p>text</p>")
    assert blocks[-1][1] == "text" and time.time() - started < 20


def test_labels_of_marked_and_barred_elements():
    def good(page):
        nodes, blocks = htmltext.parse(page)
        y = htmltext.weak_labels(nodes, blocks)
        return None if y is None else [t for i, t in blocks if y[i]]

    assert good('<div class="sidebar-left"><article><p>a</p><div class="ad">b</div></article></div>') == ["a"]
    assert good('<article class="post popular"><p>a</p></article><article class="comment"><p>b</p></article>') == ["a"]
    assert good('<div class="comments"><p>a</p></div>') is None
