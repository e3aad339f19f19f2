"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns give exact spans. The model adds those that they miss: a card
written twice in a row, a phone number without its plus sign, an address with
"at" and "dot". It scores whole candidate segments by features of the segment
(its digits, grouping, separators, checks, the words before it), and a dynamic
program over the boundaries of a zone picks borders and types together. A
segment is bounded (``MAX_SEGMENT`` tokens); all other tokens are outside.

Zones are the places where a candidate can lie: digit groups, "@", "at ... dot".
The rest of a text is outside whatever the weights, so the program over zones
equals one over the whole text. A zone of any length is decoded whole: candidates
are scored a stretch of tokens at a time and the program runs on, so time is linear
in the zone and only the borders chosen so far are held.

Weights are fitted on at most ``sample_docs`` rows: base spans there and variants
of them (other separators, no plus sign, words for signs) are the segments, all
else is outside. Base spans always stay; model spans are added where they do not
touch one, with at least ``MIN_ODDS`` of log odds over leaving them out.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import bounded_ids, map_frames

KINDS = ("email", "ip", "card", "phone")
MAX_SEGMENT = 24
SAMPLE_DOCS = 2_000
#: Zones that fit the model, and the length up to which a zone is one of them.
SAMPLE_ZONES, LONGEST_LABELLED = 400, 400
MIN_ODDS = 1.0
CONTEXT = 24

AT_SIGN_RIGHT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each '@' outwards instead of from each letter."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = AT_SIGN_RIGHT.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start, in code points."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def shown(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


#: Where a candidate can lie: digit groups of seven digits or more, an "@", or
#: a spelled-out address.
ZONE = re.compile(
    r"[+(]?[0-9](?:[\x20().+/-]{0,3}[0-9]){6,}+|[0-9]{1,3}(?:[\x20\[(]*[.,][\x20\])]*[0-9]{1,3}){3}"
    r"|[A-Za-z0-9._%+-]{1,64}(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}"
    r"(?:(?:\x20?\.\x20?|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}){1,5}",
    re.I,
)
PIECE = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
#: Tokens whose candidates are scored together.
STRETCH = 256


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint stretches of text that may hold a segment."""
    for m in ZONE.finditer(text):
        yield m.span()


def segments(zone: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Token bounds of a zone and candidate (first, last) bounds, by first.

    A candidate begins and ends at a letter, digit, '+' or bracket and has at
    most MAX_SEGMENT tokens.
    """
    bounds = [0, *(m.end() for m in PIECE.finditer(zone))]
    n = len(bounds) - 1
    closes = [k > 0 and zone[bounds[k] - 1].isalnum() for k in range(n + 1)]
    pairs = []
    for i in range(n):
        if zone[bounds[i]].isalnum() or zone[bounds[i]] in "+(":
            for j in range(i + 1, min(i + MAX_SEGMENT, n) + 1):
                if closes[j] and bounds[j] - bounds[i] >= 7:
                    pairs.append((i, j))
    return bounds, pairs


CUES = {
    "phone": re.compile(r"\b(?:tel|phone|call|mobile|cell|fax|dial|telefon|tél|téléphone|teléfono|whatsapp)\b", re.I),
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|addr|from|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|mastercard|amex|karte|carte|tarjeta|payment)\b", re.I),
}
#: Last labels that spelled-out addresses mostly end in (fixed values).
TOP_LEVEL = frozenset("com org net edu gov info biz io co de fr es it uk eu us ru cn jp br in nl".split())
MORE = re.compile(r"\x20?(?:\.|[\[(]dot[\])]|dot\x20)\x20?[A-Z0-9]", re.I)
EMAIL_SHAPE = re.compile(r"[A-Z0-9._%+-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)+", re.I)
SPELLED_SHAPE = re.compile(
    r"[A-Z0-9._%+-]+(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Z0-9-]+(?:(?:\x20?\.\x20?|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Z0-9-]+)+",
    re.I,
)
FEATURES = [
    "bias", "email_shape", "spelled_shape", "bracketed", "octets", "octets_spaced", "luhn_16_19", "card_groups", "fails_luhn",
    "plus", "phone_groups", "digits_8_15", "digits_10_11", "paren_area", "letters", "edge_digit", "edge_letter", "separators_mixed",
    "one_group", "goes_on", "top_level", "no_top_level", "cue_email", "cue_ip", "cue_card", "cue_phone",
]
_AT = {name: k for k, name in enumerate(FEATURES)}


def features(segment: str, before: str, after: str) -> np.ndarray:
    """Features of a whole segment and its surroundings."""
    f = np.zeros(len(FEATURES))
    f[0] = 1
    digits = _digits(segment)
    groups = re.findall(r"[0-9]+", segment)
    sizes = [len(g) for g in groups]
    letters = sum(c.isalpha() for c in segment)
    marks = {c for c in segment if not c.isalnum()}

    def on(name: str, holds) -> None:
        f[_AT[name]] = 1.0 if holds else 0.0

    on("email_shape", "@" in segment and EMAIL_SHAPE.fullmatch(segment))
    spelled = letters and SPELLED_SHAPE.fullmatch(segment)
    on("spelled_shape", spelled and not f[1])
    known = spelled and re.split(r"[\x20.\])]", segment.lower())[-1] in TOP_LEVEL
    on("top_level", known and not f[1])
    on("no_top_level", spelled and not known and not f[1])
    on("bracketed", spelled and ("(at)" in segment.lower() or "[at]" in segment.lower()))
    quad = not letters and len(groups) == 4 and all(n <= 3 and int(g) <= 255 for g, n in zip(groups, sizes))
    on("octets", quad and marks == {"."})
    on("octets_spaced", quad and "." in marks and marks != {"."})
    card = not letters and 16 <= len(digits) <= 19
    on("fails_luhn", card and not luhn(digits))
    on("luhn_16_19", card and luhn(digits))
    on("card_groups", card and (sizes == [4, 4, 4, 4] or len(sizes) == 1))
    phone = not letters and 8 <= len(digits) <= 15
    on("plus", segment[0] == "+")
    on("digits_8_15", phone)
    on("digits_10_11", phone and len(digits) in (10, 11))
    on("phone_groups", phone and len(sizes) >= 3 and sizes[-1] == 4 and sizes[-2] == 3)
    on("paren_area", phone and re.search(r"\([0-9]{3}\)", segment))
    on("letters", letters)
    on("edge_digit", (before[-1:].isdigit() or after[:1].isdigit()) or re.match(r"[.-][0-9]", after) or re.search(r"[0-9][.-]$", before))
    on("edge_letter", before[-1:].isalpha() or after[:1].isalpha())
    on("separators_mixed", len(marks - set("()+")) > 1 and not letters)
    on("one_group", len(groups) == 1 and not letters)
    on("goes_on", MORE.match(after))
    for kind, cue in CUES.items():
        on(f"cue_{kind}", cue.search(before))
    return f


def _features_of(text: str, start: int, bounds: list[int], pairs: list[tuple[int, int]]) -> np.ndarray:
    """Features of candidates, with CONTEXT characters before and 12 after."""
    rows = []
    for i, j in pairs:
        lo, hi = start + bounds[i], start + bounds[j]
        rows.append(features(text[lo:hi], text[max(0, lo - CONTEXT) : lo], text[hi : hi + 12]))
    return np.array(rows).reshape(len(pairs), len(FEATURES))


class Zone:
    """One zone in training: its candidates and their features."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.start = start
        self.bounds, self.pairs = segments(text[start:end])
        self.x = _features_of(text, start, self.bounds, self.pairs)

    def forward_backward(self, scores: np.ndarray) -> tuple[float, np.ndarray]:
        """log Z and the probability of each (candidate, kind)."""
        n = len(self.bounds) - 1
        joint = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        begins: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(self.pairs):
            ends[j].append(k)
            begins[i].append(k)
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [alpha[j - 1], *(alpha[self.pairs[k][0]] + joint[k] for k in ends[j])]
            alpha[j] = _logsum(terms)
        for i in range(n - 1, -1, -1):
            terms = [beta[i + 1], *(beta[self.pairs[k][1]] + joint[k] for k in begins[i])]
            beta[i] = _logsum(terms)
        if not len(scores):
            return alpha[n], scores
        outer = np.array([alpha[i] + beta[j] for i, j in self.pairs]) - alpha[n]
        return alpha[n], np.exp(np.minimum(scores + outer[:, None], 0))


def decode(text: str, start: int, end: int, weights: np.ndarray) -> list[tuple[str, int, int, float]]:
    """Borders and types of greatest total score in a zone, with each segment's score."""
    bounds, pairs = segments(text[start:end])
    n = len(bounds) - 1
    top = [0.0] * (n + 1)
    back: list[tuple[int, int, float] | None] = [None] * (n + 1)
    done = at = 0
    while at < len(pairs):
        stop = at
        while stop < len(pairs) and pairs[stop][0] < pairs[at][0] + STRETCH:
            stop += 1
        scores = _features_of(text, start, bounds, pairs[at:stop]) @ weights.T
        kinds = scores.argmax(axis=1).tolist()
        for (i, j), kind, row in zip(pairs[at:stop], kinds, scores.tolist()):
            for k in range(done + 1, i + 1):  # all candidates that end here are in
                if top[k - 1] >= top[k]:
                    top[k], back[k] = top[k - 1], None
            done = max(done, i)
            value = top[i] + row[kind]
            if value > top[j]:
                top[j], back[j] = value, (i, kind, row[kind])
        at = stop
    for k in range(done + 1, n + 1):
        if top[k - 1] >= top[k]:
            top[k], back[k] = top[k - 1], None
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
            continue
        i, kind, score = back[j]
        out.append((KINDS[kind], start + bounds[i], start + bounds[j], score))
        j = i
    return out[::-1]


def _logsum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def _variants(kind: str, span: str, rng: random.Random) -> Iterator[str]:
    """Other ways to write a base span."""
    if kind == "email":
        local, domain = span.split("@", 1)
        yield f"{local} at {domain.replace('.', ' dot ')}"
        yield f"{local} (at) {domain}"
        yield f"{local}[at]{domain.replace('.', '[dot]')}"
    elif kind == "card":
        d = _digits(span)
        yield " ".join(d[k : k + 4] for k in range(0, len(d), 4))
        yield f"{span} {span}"
    elif kind == "phone":
        d = _digits(span)
        if len(d) >= 11:
            a, b, c = d[-10:-7], d[-7:-4], d[-4:]
            yield rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}"])
    elif kind == "ip":
        yield span.replace(".", " . ")


#: Texts that hold no personal data but look a little like it.
PLAIN = (
    "Version 2.0.1 of 2019-04-05 has 1234567 lines", "order 20190405123 shipped", "1,234,567,890 words", "see pages 100 - 200 - 300",
    "meet at noon dot the line", "serial 1234567890123456", "pi is 3.14159265358979", "build 10.20.30.400 failed", "2019 2020 2021 2022",
)
SEEDS = (
    ("email", "ann.lee@mail.example.com"), ("ip", "192.0.2.17"), ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"),
    ("phone", "+1 (212) 555-0123"),
)


def training_zones(sample: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 0) -> list[tuple[Zone, list[tuple[int, int]]]]:
    """Zones with their true (candidate, kind), from snippets and variants."""
    rng = random.Random(seed)
    texts: list[tuple[str, list[tuple[str, int, int]]]] = list(sample)
    texts += [(t, []) for t in PLAIN]
    base = [(k, t[s:e]) for t, spans in sample for k, s, e in spans][:SAMPLE_ZONES] + list(SEEDS) * 3
    for kind, span in base:
        for variant in [span, *_variants(kind, span, rng)]:
            text = f"thed {variant} ation"
            if kind == "card" and variant == f"{span} {span}":
                texts.append((text, [(kind, 5, 5 + len(span)), (kind, 6 + len(span), 6 + 2 * len(span))]))
            else:
                texts.append((text, [(kind, 5, 5 + len(variant))]))
    out = []
    for text, spans in texts:
        for start, end in zones(text):
            zone = Zone(text, start, end)
            index = {(zone.bounds[i] + start, zone.bounds[j] + start): k for k, (i, j) in enumerate(zone.pairs)}
            true = [(index[s, e], KINDS.index(k)) for k, s, e in spans if (s, e) in index]
            if zone.pairs:
                out.append((zone, true))
    return out


def fit(zones_: list[tuple[Zone, list[tuple[int, int]]]], rounds: int = 120, decay: float = 0.02) -> np.ndarray:
    """Weights (kind, feature) of greatest penalised likelihood, by Adagrad steps."""
    w = np.zeros((len(KINDS), len(FEATURES)))
    w[:, 0] = -2.0
    memory = np.full_like(w, 1e-8)
    for _ in range(rounds):
        gradient = -decay * w
        for zone, true in zones_:
            _, p = zone.forward_backward(zone.x @ w.T)
            gradient -= p.T @ zone.x / len(zones_)
            for k, y in true:
                gradient[y] += zone.x[k] / len(zones_)
        memory += gradient**2
        w += 0.8 * gradient / np.sqrt(memory)
    return w


def _spark_hash(text: str) -> int:
    """What Spark's ``xxhash64`` gives for a string."""
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)
    return value - (1 << 64) if value >> 63 else value


def fit_weights(df: DataFrame, id_col: str, text_col: str, sample_docs: int) -> np.ndarray:
    """Weights from the zones of at most ``sample_docs`` rows."""
    ids = bounded_ids(df.select(F.col(id_col).alias("chosen")), "chosen", sample_docs)
    sample = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("chosen"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The zones of least hash, whatever the partitions.
        least: list[tuple[int, str, str]] = []
        for batch in batches:
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                for start, end in zones(text):
                    if end - start > LONGEST_LABELLED:
                        continue
                    lo, hi = max(0, start - CONTEXT), end + 12
                    snippet = text[lo:hi]
                    place = -_spark_hash(snippet)
                    if len(least) == SAMPLE_ZONES and place <= least[0][0]:
                        continue
                    inside = shown([(k, s - lo, e - lo) for k, s, e in base if start <= s and e <= end])
                    entry = (place, snippet, inside)
                    if entry in least:
                        continue
                    if len(least) < SAMPLE_ZONES:
                        heapq.heappush(least, entry)
                    else:
                        heapq.heappushpop(least, entry)
        yield pd.DataFrame([x[1:] for x in least], columns=["snippet", "spans"])

    rows = map_frames(sample.select("text"), run, "snippet string, spans string")
    rows = rows.distinct().orderBy(F.xxhash64("snippet"), "snippet", "spans").limit(SAMPLE_ZONES).collect()
    parsed = []
    for row in rows:
        spans = [x.split(":") for x in row["spans"].split(",") if x]
        parsed.append((row["snippet"], [(k, int(s), int(e)) for k, s, e in spans]))
    return fit(training_zones(parsed))


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Model spans that touch no base span and are surely better than none."""
    out = []
    starts, ends = _covered(base)
    for start, end in zones(text):
        k = bisect_right(starts, start) - 1
        if k >= 0 and end <= ends[k]:
            continue
        for kind, s, e, score in decode(text, start, end, weights):
            k = bisect_right(starts, e - 1) - 1
            if score >= MIN_ODDS and (k < 0 or ends[k] <= s):
                out.append((kind, s, e))
    return out


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def find_pii(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None, sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """One row per row of ``df``: id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans, n_added.

    The counts and the digest cover the base spans; ``spans`` lists all, the
    model's included, ``n_added`` counts those. Null text counts as empty.
    Repeated rows and null ids stay. Other columns of ``df`` are ignored.
    """
    if weights is None:
        weights = fit_weights(df, id_col, text_col, sample_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                more = added_spans(text, base, weights)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + more), len(more)))
            frame = pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
            frame.insert(0, "id", batch["id"])
            yield frame

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return map_frames(rows, run, schema).withColumnRenamed("id", id_col)
