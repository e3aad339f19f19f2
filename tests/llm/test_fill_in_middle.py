"""Fill-in-middle against a plain Python version, and its exact round trip."""

import hashlib
import random
import re

from codesieve.llm import fill_in_middle as fim

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def plain(id_, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (id_, n, "plain", None, None, text)
    if h[3] % 100 < 80:
        return (id_, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (id_, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_equals_plain_version(docs, rows):
    got = sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted((plain(r[0], r[1]) for r in rows), key=repr)


def test_odd_texts_in_small_slices(spark, monkeypatch):
    rng = random.Random(3)
    pool = "ab \n\t\x0b\x0c\r\x00\x1f\x85\xa0ü漢😀\u2028\uffff<>PSM"
    data = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for k in range(600)]
    data += [(k, x) for k, x in enumerate(("<P>", "a<", "<P <S <M", "<", "P>", " ", "\n\n", None, "a", "<<<S", "a <P>"), 600)]
    monkeypatch.setattr(fim, "SLICE", 100)
    df = spark.createDataFrame(data, "doc_id long, text string")
    made = fim.fill_in_middle(df)
    got = {r.doc_id: tuple(r) for r in made.collect()}
    assert got == {k: plain(k, t) for k, t in data}
    assert {r[2] for r in got.values()} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored(made.output, made.form).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {k: t or "" for k, t in data}


def test_slices_hold_all_rows():
    import pyarrow as pa

    texts = pa.array(["a" * k for k in (3, 0, fim.SLICE + 5, 7, 0, fim.SLICE, 1)])
    parts = list(fim._slices(texts))
    assert [at for at, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == 7
    assert list(fim._slices(texts.slice(0, 0))) == []


def test_empty_table(no_docs):
    assert fim.fill_in_middle(no_docs).count() == 0 and fim.digests(no_docs).columns[-1] == "restored_sha256"
