"""Pages without hints and deep pages; texts in which every value holds the next one."""

import time

import pytest

from cohortscore.llm import html_extract, secret_scan

PARA = " ".join(f"word{i}" for i in range(17))
NAV = "<nav><ul><li><a href=/>menu words</a></li></ul></nav>"


@pytest.fixture(scope="module")
def model():
    return html_extract.Model.fit(html_extract.labelled_pages())


@pytest.mark.parametrize(
    "inner,want",
    [
        (f"<div><h1>A title here</h1><div>{PARA}</div><div>{PARA}</div><div>{PARA}</div></div><footer>foot</footer>", f"A title here {PARA} {PARA} {PARA}"),
        (f"<div class='mainContent'><p>{PARA}</p><p>{PARA}</p></div>", f"{PARA} {PARA}"),
        (f"<main><h1>T</h1><p>{PARA}</p><p><a href=x>{PARA}</a></p></main>", f"T {PARA} {PARA}"),
        (f"<article><header><h1>The title of it</h1></header><p>{PARA}</p><p>{PARA}</p></article>", f"The title of it {PARA} {PARA}"),
        (f"<article><p>{PARA}</p></article><div id=pageFooter>{PARA}</div><div class=userComments><p>{PARA}</p></div>", PARA),
    ],
)
def test_pages_without_hints(model, inner, want):
    assert model.text(f"<html><body>{NAV}{inner}</body></html>") == want


def test_layouts_that_were_not_trained(model):
    right = total = 0
    for page, labels in html_extract.labelled_pages(100, 11):
        for p, y in zip(model.marginals(html_extract.parse(page)[0]), labels):
            right, total = right + ((p >= 0.5) == bool(y)), total + 1
    assert right >= 0.99 * total


def test_deep_pages(model):
    began = time.time()
    for page in ("<div>" * 100_000 + "</b></x>" * 100_000, "<p>" + "<foo>" * 100_000 + "<li>a</li>" * 1_000, "<div>" * 100_000 + PARA + "</div>" * 100_000):
        model.text(page)
    assert time.time() - began < 60


def brute_spans_end(text):
    """(start, end) of what stands after each `key=` up to white space, as a reader would list them."""
    out, at = [], 0
    while (at := text.find("key=", at)) >= 0:
        at += 4
        end = next((i for i in range(at, len(text)) if text[i].isspace()), len(text))
        if end > at:
            out.append((at, end))
    return out


def test_values_in_values():
    of = lambda t: {t[a:b] for a, b in secret_scan.spans(t)}
    assert of("secret=abc&token=def") == {"abc&token=def", "def"}
    assert of("secret=abc&token=def&key=xyz and on") == {"abc&token=def&key=xyz", "def&key=", "xyz"}
    assert of("key=a1 key=b2\nkey=c3") == {"a1", "b2", "c3"}
    for text in ("key=aXb9 key=key=zz", "no names at all", "key=", "key=q1w2e3 　key=r4 key=t5"):
        assert set(secret_scan.spans(text)) == set(brute_spans_end(text))


@pytest.mark.parametrize("text", ["key=" * 250_000, "key=" + "." * 1_000_000 + "a", "secret: " + "x" * 500_000 + "y", "password=" * 60_000 + "\n" + "token=\"" * 20_000])
def test_long_values_in_linear_time(text):
    forest, transitions = secret_scan.trained()
    began = time.time()
    found, p = secret_scan._found([text], forest, transitions)
    assert sum(b - a for _, a, b in found) <= 4 * len(text) and len(p) == len(found)
    assert time.time() - began < 40
