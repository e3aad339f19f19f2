"""Pages of many kinds, each with its article's text written by hand. Boilerplate
words begin with 'zz', so one that is left in is seen at once."""

import re
from collections import Counter

import pytest

from codesieve.llm import html_extract

TEXT = "Rain fell over the old town while the market slowly filled with people."
MORE = "By noon the square was quiet again and the stalls had closed for the day."
ZZ = " ".join(f"zz{w}" for w in "buy now our offers join the list today share this read more".split())
NAV = '<nav><ul><li><a href="/a">zzhome</a></li><li><a href="/b">zznews</a></li></ul></nav>'
FOOT = f"<footer><p>{ZZ}</p></footer>"


def zz(n):
    return " ".join(f"zz{k}" for k in range(n))


#: name: (html of the body, text of its article)
PAGES = {
    "sidebar": (f"{NAV}<article><h1>Head</h1><p>{TEXT}</p></article><div class=\"sidebar\"><p>{ZZ}</p></div>", f"Head {TEXT}"),
    "comments": (f"<article><p>{TEXT}</p></article><section class=\"comments\"><p>{ZZ}</p><p>{ZZ}</p></section>{FOOT}", TEXT),
    "form after": (f"<article><p>{TEXT}</p></article><form><p>{ZZ}</p><input><label>zzname</label></form>", TEXT),
    "aside inside": (f"<article><p>{TEXT}</p><aside><p>{ZZ}</p></aside><p>{MORE}</p></article>", f"{TEXT} {MORE}"),
    "large aside": (f"<article><h1>Head</h1><p>{TEXT}</p><aside><p>{zz(800)}</p></aside><p>{MORE}</p></article>", f"Head {TEXT} {MORE}"),
    "cookie notice": (f"<div class=\"cookie-notice\"><p>{ZZ}</p></div><article><p>{TEXT}</p></article>", TEXT),
    "linked list": ("<article><p>Short.</p><ul><li><a href=1>link one</a></li><li><a href=2>link two</a></li></ul></article>" + FOOT, "Short. link one link two"),
    "links only": (f"{NAV}<article><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></article>{FOOT}", "one two"),
    "table": (f"<main><h2>Prices</h2><table><tr><th>Kind</th><th>Sum</th></tr><tr><td>Tea</td><td>3</td></tr></table><p>{TEXT}</p></main><aside><table><tr><td>zzads</td></tr></table></aside>", f"Prices Kind Sum Tea 3 {TEXT}"),
    "comment articles": (f"<article class=post><p>{TEXT}</p></article><article class=\"comment\"><p>{ZZ}</p></article><article class=comment><p>{ZZ}</p></article>", TEXT),
    "nested comments": (f"<article><p>{TEXT}</p><section id=\"comments\"><article><p>{ZZ}</p></article></section></article>", TEXT),
    "related cards": (f"<main><p>{TEXT}</p><p>{MORE}</p></main><div class=\"related-posts\"><div class=card><h3>zzcard</h3><p>{ZZ}</p></div></div>", f"{TEXT} {MORE}"),
    "advert between": (f"<article><p>{TEXT}</p><div class=\"ad\"><p>{ZZ}</p></div><p>{MORE}</p></article>", f"{TEXT} {MORE}"),
    "no article": (f"<div id=header class=navbar><p>{ZZ}</p></div><div class=content><h1>Head words here</h1><p>{TEXT}</p><p>{MORE}</p></div><div class=\"sidebar\"><p>{ZZ}</p></div>", f"Head words here {TEXT} {MORE}"),
    "no article, comments": (f"<div class=post><p>{TEXT}</p><p>{MORE}</p></div><div id=comments><article class=comment><p>{ZZ}</p></article></div>", f"{TEXT} {MORE}"),
    "no article, list": (f"<div class=content><p>{TEXT}</p><ul><li>first point of all</li><li>second point of all</li></ul><p>{MORE}</p></div>{FOOT}", f"{TEXT} first point of all second point of all {MORE}"),
    "page in a form": (f"<form id=aspnet>{NAV}<article><p>{TEXT}</p></article>{FOOT}</form>", TEXT),
    "all in a form": (f"<form><div><p>{TEXT}</p></div></form>", TEXT),
    "promo outside": (f"<div class=hero><p>{ZZ}</p></div><article><p>{TEXT}</p></article><div class=x1><p>{ZZ}</p></div>", TEXT),
    "header inside": (f"<header><p>{ZZ}</p></header><article><header><h1>Head</h1></header><p>{TEXT}</p></article>", f"Head {TEXT}"),
    "quote and code": (f"<article><blockquote><p>{TEXT}</p></blockquote><pre>x = 1\n  y</pre><p>{MORE}</p></article>{FOOT}", f"{TEXT} x = 1 y {MORE}"),
    "newsletter inside": (f"<article><p>{TEXT}</p><div class=\"newsletter-box\"><form><p>{ZZ}</p></form></div><p>{MORE}</p></article>", f"{TEXT} {MORE}"),
    "open containers": (f"<article><p>{TEXT}</p><div/><p>{MORE}</p></article>{FOOT}", f"{TEXT} {MORE}"),
    "slashed nav": (f"<nav/><ul><li><a href=a>zzhome</a></ul></nav><article><p>{TEXT}</p></article>", TEXT),
    "open title": (f"<article><p>{TEXT}</p><title><p>{MORE}</p></article>", f"{TEXT} {MORE}"),
    "open textarea": (f"<article><p>{TEXT}</p><textarea><p>{MORE}</p></article>", f"{TEXT} {MORE}"),
    "share bar": (f"<article><h1>Head</h1><div class=\"share\"><p>{ZZ}</p></div><p>{TEXT}</p></article>", f"Head {TEXT}"),
    "dialog": (f"<dialog><p>{ZZ}</p></dialog><main><p>{TEXT}</p></main>", TEXT),
    "figure": (f"<article><figure><img src=a alt=b><figcaption>Town square</figcaption></figure><p>{TEXT}</p></article>", f"Town square {TEXT}"),
    "definition list": (f"<article><dl><dt>Tea</dt><dd>A drink.</dd></dl><p>{TEXT}</p></article><div role=complementary><p>{ZZ}</p></div>", f"Tea A drink. {TEXT}"),
}


@pytest.fixture(scope="module")
def fitted(spark):
    counts = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        counts.update(html_extract.fit_counts(r.html) or {})
    return html_extract.weights_from([(k, i, n) for (k, i), n in counts.items()])


def results(weights):
    return {name: html_extract.extract(f"<html><head><title>zztitle</title></head><body>{page}</body></html>", weights) for name, (page, _) in PAGES.items()}


def test_templates_with_fitted_weights(fitted):
    got = results(fitted)
    assert {n: t for n, t in got.items() if re.search("zz", t)} == {}
    wrong = {n: t for n, t in got.items() if t != PAGES[n][1]}
    assert len(wrong) <= 0.05 * len(PAGES), wrong


def test_the_fit_is_not_worse_than_the_defaults(fitted):
    def right(weights):
        return sum(t == PAGES[n][1] for n, t in results(weights).items())

    assert right(fitted) >= right({})


def test_many_open_raw_elements_take_linear_time():
    import time

    def seconds(n):
        begin = time.process_time()
        html_extract.extract("<p>word " + "<title>" * n, {})
        return time.process_time() - begin

    seconds(1000)
    assert seconds(160_000) < 6 * seconds(40_000) + 0.5
