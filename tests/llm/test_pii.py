import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesieve.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a1@.+-(4 5)0\né%"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["1.2.3.4.5.6.7.8", "a@b.c@d.e", "x@y", "1.2.3.256", "4111111111111111", "4111-1111 1111-1111", "+1 (212) 555-0123.", "+1234567", "é a@b.co"])
def test_base_cases(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("stretch", [1, 2, 256])
def test_dynamic_program_equals_enumeration(monkeypatch, stretch):
    """Best segmentation and partition sum, against all of them."""
    text = "call 212 555 0123 now"
    zone = pii.Zone(text, 5, 17)
    rng = np.random.default_rng(stretch)
    scores = rng.normal(size=(len(zone.pairs), len(pii.KINDS)))
    n = len(zone.bounds) - 1
    totals, best = [], (-np.inf, None)

    def walk(at, total, chosen):
        nonlocal best
        if at == n:
            totals.append(total)
            best = max(best, (total, tuple(chosen)))
            return
        walk(at + 1, total, chosen)
        for k, (i, j) in enumerate(zone.pairs):
            if i == at:
                for y in range(len(pii.KINDS)):
                    walk(j, total + scores[k, y], [*chosen, (k, y)])

    walk(0, 0.0, [])
    log_z, p = zone.forward_backward(scores)
    assert abs(log_z - np.logaddexp.reduce(totals)) < 1e-9
    row = dict(zip(zone.pairs, scores))
    monkeypatch.setattr(pii, "STRETCH", stretch)
    monkeypatch.setattr(pii, "_features_of", lambda t, s, b, pairs: np.array([row[x] for x in pairs]))
    found = pii.decode(text, 5, 17, np.eye(len(pii.KINDS)))
    assert abs(sum(x[3] for x in found) - best[0]) < 1e-9 and len(found) == len(best[1])
    k = 0
    with_k = np.logaddexp.reduce([t for t in _with(zone, scores, k)]) if zone.pairs else 0
    assert abs(p[k, 0] - np.exp(with_k - log_z)) < 1e-9


def _with(zone, scores, k):
    """Totals of the segmentations that hold candidate k as the first kind."""
    n = len(zone.bounds) - 1
    out = []

    def walk(at, total, held):
        if at == n:
            if held:
                out.append(total)
            return
        walk(at + 1, total, held)
        for m, (i, j) in enumerate(zone.pairs):
            if i == at:
                for y in range(len(pii.KINDS)):
                    walk(j, total + scores[m, y], held or (m, y) == (k, 0))

    walk(0, 0.0, False)
    return out


@pytest.fixture(scope="module")
def weights():
    return pii.fit(pii.training_zones([]))


def test_variants_are_found_and_plain_numbers_are_not(weights):
    rng = random.Random(1)
    found = total = 0
    for _ in range(40):
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        mail = f"user{rng.randint(1, 99)} at host{rng.randint(1, 9)} dot example dot com"
        for kind, span in (("phone", phone), ("email", mail)):
            text = f"thing {span} other words"
            total += 1
            found += (kind, 6, 6 + len(span)) in pii.added_spans(text, pii.base_spans(text), weights)
    assert found / total > 0.9
    for text in pii.PLAIN:
        assert pii.added_spans(text, pii.base_spans(text), weights) == []


def test_long_zones_are_decoded_whole_and_in_linear_time(weights):
    """A zone is not cut, wherever in it a segment lies; many numbers do no harm."""
    card = "4111111111111111 4111111111111111"
    for ahead in (0, 1, 7, 50, 397, 1000):
        text = "no " + "1 " * ahead + card + " end"
        alone = pii.added_spans("no 1 " + card + " end", [], weights)
        found = pii.added_spans(text, pii.base_spans(text), weights)
        if ahead:
            assert [x for x in found if x[1] >= 3 + 2 * ahead] == [(k, s + 2 * ahead - 2, e + 2 * ahead - 2) for k, s, e in alone]

    def seconds(n):
        text = "call +1 (212) 555-0123, 10.0.0.1 " * n + "12 34 " * n
        begin = time.process_time()
        pii.added_spans(text, pii.base_spans(text), weights)
        return time.process_time() - begin

    seconds(50)
    assert seconds(2000) < 7 * seconds(500) + 0.5


def test_the_sampled_zones_do_not_depend_on_the_partitions(spark, monkeypatch):
    texts = [(k, f"call (212) 555-{k:04} or 10.1.{k % 200}.7 now") for k in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(pii, "fit", lambda found: seen.append([(x.start, len(x.pairs), true) for x, true in found]))
    for n in (1, 7):
        pii.fit_weights(df.repartition(n), "doc_id", "text", 2000)
    assert seen[0] == seen[1] and len(seen[0]) > pii.SAMPLE_ZONES


def test_a_card_written_twice(weights):
    text = "no 4111111111111111 4111111111111111 end"
    assert pii.base_spans(text) == []
    assert pii.added_spans(text, [], weights) == [("card", 3, 19), ("card", 20, 36)]


def test_table(spark, docs, rows, no_docs):
    more = [
        (900, "mail a.b@c.example.com or +1 (212) 555-0123, 10.0.0.1, 4111 1111 1111 1111"), (901, None), (902, ""), (903, "5" * 20_000),
        (904, "é" * 5000 + " x@y.zz"), (None, "x@y.zz"),
    ]
    df = spark.createDataFrame(more, "doc_id long, text string")
    got = pii.find_pii(df).collect()
    for (doc_id, text), r in zip(more, got):
        base = brute(text or "")
        assert (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) == (doc_id, *(sum(k == x[0] for x in base) for k in pii.KINDS))
        assert r.base_sha256 == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert set(pii.shown(base).split(",")) <= set(r.spans.split(","))
    assert got[0].spans.startswith("email:5:") and got[0].n_added == 0
    assert pii.find_pii(docs).count() == len(rows) and pii.find_pii(no_docs).count() == 0
