"""Token counts, packing: the libraries themselves are the reference."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codesieve.llm import packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a<|endoftext|>b <|endoftext|>", "<|startoftext|> x<|endoftext|>", "it's WE'LL  two\n\n three \t", "ΑΣ ΣΑ Σ", "e\u0301 é", "漢字かな 123 ４５",
    "a\u00a0b\u2003c\x1cd\x85e", "🎉🎉 !!! <|ENDOFTEXT|>", "''s '' 's", "İstanbul ǅ ﬁ", "\u0301x \u0301", "x" * 300 + " " + "!" * 300, " lead", "trail ",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    count = len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)
    assert token_counts.count_tokens(text, token_counts.Lengths({}, BYTES)) == count
    ids = np.array(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.encode(text, packing.WordIds(WORDS)) == ids


LENGTHS, IDS = token_counts.Lengths({}, BYTES), packing.WordIds(WORDS)


def library_count(text):
    return len(token_counts.tokenizer_of(BYTES).encode(text, add_special_tokens=False).ids)


def library_ids(text):
    return np.array(token_counts.tokenizer_of(WORDS).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert token_counts.count_tokens(text, LENGTHS) == library_count(text)
    assert packing.encode(text, IDS) == library_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(sorted(packing.odd_characters(WORDS))[:1500] + list("aB1!' \n\t\u00a0\u2003\u0301\u0334ΣÉ")), max_size=30))
def test_texts_of_characters_that_the_libraries_class_differently(text):
    assert token_counts.count_tokens(text, LENGTHS) == library_count(text)
    assert packing.encode(text, IDS) == library_ids(text)


@pytest.mark.parametrize("frame", ["a@'s ", "1@ !@ ", "e\u0301@\u0334\u0345 "])
def test_every_character(frame):
    """No category left out before and after letters and clitics; of the other
    places every eighth block, and each block with a character of its own rules."""
    every, odd = token_counts.characters(), packing.odd_characters(WORDS)
    for at in range(0, len(every), 256):
        if frame != "a@'s " and at % 2048 and odd.isdisjoint(every[at : at + 256]):
            continue
        text = "".join(frame.replace("@", c) for c in every[at : at + 256])
        if token_counts.count_tokens(text, LENGTHS) != library_count(text) or packing.encode(text, IDS) != library_ids(text):
            for c in every[at : at + 256]:
                one = frame.replace("@", c)
                assert token_counts.count_tokens(one, LENGTHS) == library_count(one), hex(ord(c))
                assert packing.encode(one, IDS) == library_ids(one), hex(ord(c))
            raise AssertionError(f"block {at:x}")


def test_the_planes_left_out_hold_no_letters():
    rest = "".join(map(chr, [*range(0x40000, 0xE0000), *range(0xF0000, 0x110000)]))
    assert token_counts.regex.search(r"[\p{L}\p{N}\s]", rest) is None
    split = token_counts.pre_tokenizers.Split(token_counts.Regex(r"[\p{L}\p{N}\s]"), "removed", invert=True)
    assert split.pre_tokenize_str(rest) == []


def test_counts_of_a_table(docs, rows, no_docs):
    tokenizer = Tokenizer.from_file(BYTES)
    expected = []
    for r in rows:
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)
        expected.append((r[0], len((r[1] or "").encode()), n, n > 1024))
    for size in (60_000, 8):
        got = token_counts.token_counts(docs, table_size=size, sample_rows=size).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert token_counts.token_counts(no_docs).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 3)
    lengths = token_counts.Lengths({"a": 1}, BYTES)
    for k in range(50):
        lengths[f" word{k}"]
    assert len(lengths) <= 6 and lengths["a"] == 1


def test_packing(docs, rows, no_docs):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected.append((r[0], k, at, len(part), zlib.crc32(part.tobytes())))
    for shard in (20_000, 10):
        got = packing.pack(docs, shard_pieces=shard).collect()
        assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, expected))
        filled = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled.get(r.sequence_id, 0)
            filled[r.sequence_id] = r.offset + r.length
        assert max(filled.values()) <= 4096
        if shard == 20_000:
            assert len(filled) <= -(-sum(x[3] for x in expected) // 4096) + 1
    assert packing.pack(no_docs).count() == 0


def test_shards_do_not_show_in_the_number_of_sequences(spark):
    """Short pieces fill sequences to the brim; each shard alone would leave one open."""
    rng = random.Random(1)
    lengths = [rng.randint(1, 9) for _ in range(4000)]
    df = spark.createDataFrame([(1, " ".join(["a"] * (n - 1))) for n in lengths], "doc_id long, text string").repartition(5)
    for shard in (50, 4000):
        got = packing.pack(df, capacity=64, shard_pieces=shard).collect()
        assert sorted(r.length for r in got) == sorted(lengths)
        filled = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled.get(r.sequence_id, 0)
            filled[r.sequence_id] = r.offset + r.length
        assert max(filled.values()) <= 64
        assert sum(n <= 32 for n in filled.values()) <= 2 and len(filled) <= 1.05 * sum(lengths) / 64 + 2


def brute_best_fit(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits)[1]
        else:
            rooms.append(capacity)
            k = len(rooms) - 1
        out.append(rooms[k])
        rooms[k] -= n
    return out, len(rooms)


@pytest.mark.parametrize("capacity", [7, 64, 100, 4096])
def test_best_fit_takes_the_tightest_room(capacity):
    rng = random.Random(capacity)
    lengths = sorted((rng.randint(1, capacity) for _ in range(400)), reverse=True)
    sequences, offsets = packing.best_fit_decreasing(lengths, capacity)
    rooms, bins = brute_best_fit(lengths, capacity)
    assert [capacity - o for o in offsets] == rooms and len(set(sequences)) == bins


def test_odd_characters_are_found_by_a_task(spark):
    """The driver's Python holds no tokenizer after it has planned the packing."""
    import subprocess
    import sys

    import public_tokenizers

    from codesieve.llm import packing, token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    code = (
        "from pyspark.sql import SparkSession\nfrom codesieve.llm import packing, token_counts\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "packing.pieces(s.createDataFrame([(1, 'a b')], 'doc_id long, text string'))\n"
        "print('held', len(token_counts._TOKENIZERS))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "held 0", out.stderr[-500:]
    assert packing.odd_pattern(spark, path) == token_counts.pattern_of(packing.odd_characters(path))
