"""Required words: read off patterns by hand, and never missing from a match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codesieve.operators import prefilter, scan
from codesieve.operators.rules import CONTENT, POLICY, SECURITY

PACKS = (*SECURITY, *POLICY, *CONTENT)


@pytest.mark.parametrize(
    "pattern, words",
    [
        (r"AKIA[0-9A-Z]{16}", ("AKIA",)), (r"(?i)(?:Pass|pwd)\s*=", ("pass", "pwd")), (r"a|bcd", ()), (r"(?:abc)*def?g", ("de",)[:0]), (r"(?:abc)+x", ("abc",)),
        (r"\beval\s*\(", ("eval",)), (r"a\.bcd(?!efgh)[xyz]", ("a.bcd",)), (r"(foo|ba).*(quux|corge)", ("corge", "quux")), (r"x{3}", ()), (r"(?:hello){2,3}", ("hello",)),
        (r"(?:hello){0,3}", ()), (r"[^]a]bcd", ("bcd",)), (r"colou?red", ("colo",)),
    ],
)
def test_words_of_patterns(pattern, words):
    assert prefilter.required(pattern) == words


def test_all_pack_rules_ask_for_words():
    assert all(prefilter.required(r.pattern) for r in PACKS)


def sample(rng, pattern):
    """A text near a match: its words, in a random order, with noise."""
    words = list(prefilter.required(pattern)) + re.findall(r"[a-z/]{2,}", pattern)
    marks = [" ", "(", "='abcdefghijkl'", '"', ".", "\n", ": ", " = True", "True", "False", "+", "{x}"]
    return "".join(rng.choice(words if rng.random() < 0.5 else marks).replace("/", rng.choice("/.")) for _ in range(rng.randint(1, 12)))


def test_every_match_holds_a_required_word():
    rng = random.Random(3)
    matches = 0
    for rule in PACKS:
        for _ in range(400):
            text = sample(rng, rule.pattern)
            text = text.upper() if rng.random() < 0.2 else text
            if re.search(rule.pattern, text):
                matches += 1
                low = text.lower() if prefilter.ignores_case(rule.pattern) else text
                assert any(w in low for w in prefilter.required(rule.pattern)), (rule, text)
    assert matches > 300


def test_same_findings_without_the_words(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.concat("text", F.lit("\nPASSWORD = 'abcdef'\neval (x)")).alias("code"))
    rules = [*SECURITY, *POLICY]
    found = [sorted(map(str, scan.scan_first(docs, rules).collect())), sorted(map(str, scan.scan_all(docs, rules).collect())), sorted(map(str, scan.scan_summary(docs, rules).collect()))]
    monkeypatch.setattr(scan, "required", lambda pattern: ())
    plain = [sorted(map(str, scan.scan_first(docs, rules).collect())), sorted(map(str, scan.scan_all(docs, rules).collect())), sorted(map(str, scan.scan_summary(docs, rules).collect()))]
    assert found == plain and len(found[0]) >= 2 * docs.count()
