import random

import pytest

EXTRA = "id string, fp string, h string, len string, head string, key string, word string, bits string, again string, n string, keep string, found string, place string, gone string, trusted string, chosen string"


def words(rng, n):
    syllables = ("ba", "ce", "di", "fo", "gu", "lan", "mer", "nis", "or", "pu")
    return [" ".join([rng.choice(syllables) + rng.choice(syllables) + rng.choice(syllables)]) for _ in range(n)]


def corpus():
    """Rows with nulls, blanks, a very long text, copies, near copies, shared passages."""
    rng = random.Random(7)
    passage = " ".join(words(rng, 60))
    base = [" ".join(words(rng, rng.randint(60, 200))) for _ in range(25)]
    texts = list(base)
    texts += [base[0]] * 5 + [base[1].upper(), base[2] + " tail", base[3].replace(" ", "\n", 3)]
    texts += [base[k] + " " + passage + " " + base[k + 1] for k in (4, 6, 8)]
    texts += [None, "", " \n\t ", "one", "one", "a b c", "é ü ß 漢字 Σ", passage + " " + passage]
    texts += [" ".join(words(rng, 30_000)), "x" * 50_000, "line\nline\nline\n" * 20]
    return [(k, t, "en", (None, "b", "a", "ä")[k % 4], len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus() + [(0, corpus()[0][1], "en", "b", 1), (None, "no id here", "en", "a", 1)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names operators use inside."""
    names = [c.split()[0] for c in EXTRA.split(", ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    return spark.createDataFrame([(*r, *names) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
