import html
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from codesieve.llm import html_extract, url_filter


def brute_region(weights):
    best = (0.0, 0, 0)
    for i in range(len(weights)):
        for j in range(i + 1, len(weights) + 1):
            if sum(weights[i:j]) > best[0] + 1e-12:
                best = (sum(weights[i:j]), i, j)
    return best


def test_best_region_against_all_regions():
    rng = random.Random(2)
    for _ in range(200):
        weights = [rng.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(rng.randint(0, 14))]
        start, end = html_extract.best_region(weights)
        assert abs(sum(weights[start:end]) - brute_region(weights)[0]) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>Head words</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site name</a></header><nav><ul><li><a href="/x">One</a><li><a href="/y">Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First&nbsp;para   with <b>bold</b>ed
words &eacute; and &#233;.<aside>Side note here</aside><p>Second para<br>after break, with enough words to count as text.<form><input name=q>Find<button>Go</button></form>
<script>x()</script><!-- note --><ul><li>Item one<li>Item two</ul></article>
<div id="comments"><p>A reader says many words in this place, more and more words.</p></div><div class="sidebar">Links and links</div><footer>&copy; foot</footer></body></html>"""


def test_page_parts():
    counts = [(k, i, n) for (k, i), n in html_extract.fit_counts(PAGE).items()]
    for weights in ({}, html_extract.weights_from(counts)):
        text = html_extract.extract(PAGE, weights)
        assert text == (
            "Title & more First para with bolded words é and é. Second para after break, with enough words to count as text. Item one Item two"
        )


@pytest.mark.parametrize("page", [None, "", "<", "<p", "&am", "<script>x", "<!-- x", "<p></p>", "<a b='c", "</p></p>"])
def test_odd_pages(page):
    assert html_extract.extract(page, {}) in ("", "&am", "<")


def test_plain_and_long_pages():
    assert html_extract.extract("just a text", {}) == "just a text"
    many = "<p>" + "word " * 50_000 + "</p>"
    assert html_extract.extract(many, {}) == ("word " * 50_000).strip()
    assert html_extract.extract("<div>" * 3000 + "deep words here " * 2000 + "</div>" * 3000, {}).startswith("deep")


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumnRenamed("url", "url").coalesce(2)
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for p in pages.collect():
        text = article_text(p.html)
        assert got[p.page_id].text == text and got[p.page_id].n_chars == len(text) and got[p.page_id].url == p.url


def article_text(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())


def unmarked(page):
    """The page without a word of what its parts are for: no article, nav, footer or class."""
    page = re.sub(r"</?article>", "", page)
    page = re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", page)
    return page.replace('<div class="ad">', "<div>")


def test_the_region_decides_on_held_out_pages(spark, monkeypatch):
    """Weights from some pages judge others that lost every mark; nothing but
    the region can leave menus, adverts and footers out of those."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    counts = Counter()
    for page in pages[:125]:
        counts.update(html_extract.fit_counts(page))
    weights = html_extract.weights_from([(k, i, n) for (k, i), n in counts.items()])

    def right():
        return sum(html_extract.extract(unmarked(p), weights) == article_text(p) for p in pages[125:])

    assert right() >= 0.95 * len(pages[125:])
    monkeypatch.setattr(html_extract, "best_region", lambda scores: (0, len(scores)))
    assert right() == 0


def test_attributes():
    for page in ("<p title=it's>one two</p><p>don't three</p><p>four", "<p title=a\"b>one two</p><p>don't three</p><p>four", "<p title='it\"s' =x \"y>one two<p>don't three<p>four"):
        assert html_extract.extract(page, {}) == "one two don't three four"
    assert html_extract.extract("<p>a > b < c</p><p title='x>y'>d</p><p title=\"open>e f</p>", {}) == "a > b < c d e f"


@pytest.mark.parametrize("word, bad", [("ad", True), ("ad-banner", True), ("Cookie-Notice", True), ("related-posts", True), ("sidebar-left", True), ("has-sidebar", False), ("comments-open", False), ("related-work", False), ("post", False), ("", False)])
def test_class_words(word, bad):
    assert html_extract.boilerplate_word(word) == bad
    page = f'<p>before words</p><div class="box {word}"><p>some more words</p></div><p>after words</p>'
    assert ("some more" not in html_extract.extract(page, {})) == bad


def test_the_page_itself_is_never_boilerplate():
    page = '<body class="no-sidebar ad"><article class="post comments-open comments"><header><h2 id="related">Title of words</h2></header><p>text words here</p></article></body>'
    assert html_extract.extract(page, {}) == "Title of words text words here"


@pytest.mark.parametrize("part, close", [("<div>", "</span>"), ("<p><b>", ""), ("<div class=a>", "</p>"), ("<a b='", ""), ("<!-", ""), ("<x y=\"z'", "</x"), ("<", ""), ("&am", ""), ("<script>", "</scrip")])
def test_long_bad_markup_takes_linear_time(part, close):
    def seconds(n):
        page = "<p>words of text</p>" + part * n + close * n
        begin = time.process_time()
        html_extract.extract(page, {})
        return time.process_time() - begin

    n = 1_000_000 // (len(part) + len(close))
    seconds(1000)
    assert seconds(n) < 6 * seconds(n // 4) + 0.5


def test_tables_with_gaps(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "u", "<p>x y</p>", "b")], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "x y", 3), (1, "", 0), (1, "", 0)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


URLS = [
    "http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "https://x.example.com/de/1", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/",
    "http://com/a", "http://com", "http://notexample.com/en/", "http://x.org#a/b?c", "mailto:x", "", None, "a://b://c/d", "http://h.co.uk/ß?", "http://x.net/en/1",
    "http://x.net/en/1",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fits = [
        (len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def brute_reputation(pages):
    def parts(host):
        labels = host.split(".")
        two = ".".join(labels[-2:])
        return (".".join(labels[-3:]), two) if two in url_filter.DOUBLE_SUFFIXES else (two, labels[-1])

    hosts = defaultdict(lambda: [0, 0])
    for host, verdict in pages:
        hosts[host][0] += verdict is not None
        hosts[host][1] += verdict == "block"
    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for host, (n, k) in hosts.items():
        d, s = parts(host)
        for table, key in ((domains, (d, s)), (suffixes, s)):
            table[key][0] += n
            table[key][1] += k

    def level(counts, prior):
        labelled = [(n, k, prior(key)[0]) for key, (n, k) in counts.items() if n]
        total = sum(x[0] for x in labelled)
        c = url_filter.LEAST_STRENGTH
        if total:
            base = sum(n * p * (1 - p) for n, k, p in labelled) / total
            between = max((sum(n * (k / n - p) ** 2 for n, k, p in labelled) - sum(p * (1 - p) for n, k, p in labelled)) / total, 0)
            c = min(max(base / between - 1, url_filter.LEAST_STRENGTH), url_filter.MOST_STRENGTH) if between > 0 else url_filter.MOST_STRENGTH
        out = {}
        for key, (n, k) in counts.items():
            p, size = prior(key)
            s = min(c, size)
            out[key] = ((k + s * p) / (n + s), n + s)
        return out

    s = level(suffixes, lambda key: (0.5, 2.0))
    d = level(domains, lambda key: s[key[1]])
    return level(hosts, lambda host: d[parts(host)])


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, lower string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    split = [brute_parts(u) for u in URLS]
    ruled = [brute_rule(*x) for x in split]
    known = brute_reputation([(h, v) for (h, _), (_, v) in zip(split, ruled)])
    for k, ((host, path), (rule, verdict)) in enumerate(zip(split, ruled)):
        mean, size = known[host]
        lower = mean - url_filter.SCORE_Z * math.sqrt(mean * (1 - mean) / (size + 1))
        expected = verdict or ("block" if lower > url_filter.BOUND else "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, expected)
        assert abs(got[k].reputation - mean) < 1e-5
    plan = url_filter.filter_urls(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_unknown_hosts_are_allowed(spark):
    urls = [f"http://bad.net/es/{k}" for k in range(30)] + ["http://good.org/a", "http://bad.net/other"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df).collect()}
    assert got[30] == "allow" and got[31] == "block"
