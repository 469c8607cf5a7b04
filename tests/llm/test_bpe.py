"""The encoder against the tokenizer library, and its defined cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from wanderframe.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ALPHABET = "'sdtrevlm  \n\t a1é中.!\"\U0001f600٣ऽ́"


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    t.encode_special_tokens = True
    return t


def ours(enc, texts):
    out = []
    for _, _, ids, n in bpe.encode_array(enc, pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def test_equals_library(enc, library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3001, "=" * 999, "ab" * 2000, "<|endoftext|>", "x" * 100_000, "", "﻿int main() {\r\n}"]
    assert ours(enc, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=8))
def test_word_starts_follow_the_pattern(texts):
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begins = np.cumsum([0, *map(len, texts)])[:-1].astype(np.int64)
    got = set(np.flatnonzero(bpe.word_starts(points, begins)).tolist()) if joined else set()
    assert got == {b + m.start() for b, t in zip(begins.tolist(), texts, strict=True) for m in PATTERN.finditer(t)}


LETTERS = {"random": "abcdefghijklmnopqrstuvwxyz", "frequent": "etaoin", "chinese": "".join(map(chr, range(0x4E00, 0x4F00))), "thai": "".join(map(chr, range(0xE01, 0xE2E))), "one": "x", "marks": "=-*/#"}


@pytest.mark.parametrize("kind", LETTERS)
def test_a_word_of_100_000_letters(enc, library, kind):
    import time

    word = "".join(random.Random(1).choices(LETTERS[kind], k=100_000))
    began = time.process_time()
    got = ours(enc, [word, "and " + word[:5000] + " more"])
    assert time.process_time() - began < 10
    assert got == [e.ids for e in library.encode_batch([word, "and " + word[:5000] + " more"], add_special_tokens=False)]


def test_barriers_are_where_no_entry_reaches(enc):
    rnd = random.Random(2)
    entries = set(enc.entries)
    longest = max(map(len, entries))
    for _ in range(30):
        word = bytes(rnd.choices(b"etaoqzx=\xe4\xb8", k=60))
        text = word.decode("latin-1")
        spanned = {k for a in range(60) for b in range(a + 2, min(60, a + longest) + 1) if text[a:b] in entries for k in range(a + 1, b)}
        assert enc.barriers(word).tolist() == [k for k in range(1, 60) if k not in spanned]


def test_pieces_of_long_words(enc, library, monkeypatch):
    """With all words cut at their barriers the ids stay the same."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choices(ALPHABET + "thequick=", k=rnd.randint(0, 80))) for _ in range(500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "LONG", 1)
    assert ours(enc, texts) == want


@pytest.mark.parametrize("unit", ["x", "=", "abc", " ", "ha", "etaoinshrdlu"])
def test_words_in_parts(enc, library, unit, monkeypatch):
    """A word without barriers is contracted part by part, whatever the parts."""
    text = unit * (3001 // len(unit)) + "".join(random.Random(3).choices(unit, k=1500))
    want = library.encode(text, add_special_tokens=False).ids
    for part in (100, 333, 1 << 11):
        monkeypatch.setattr(bpe, "PART", part)
        assert ours(bpe.Encoder(enc.path), [text])[0] == want


def test_a_million_times_one_letter(enc, library):
    """Such a word takes the memory of its parts."""
    texts = ["x" * 1_000_001, "=" * 400_000, "ab" * 300_000]
    assert ours(enc, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_vocabulary_entry_contracts_to_itself(enc):
    import json

    vocab = json.load(open(bpe.vocabulary()))["model"]["vocab"]
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters.values())}
    tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t) and "<|" not in t}
    ids, n = enc.contract(list(tokens.values()))
    assert n.tolist() == [1] * len(tokens)
    assert ids.tolist() == list(tokens)


def test_cache_starts_afresh(enc, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    one = ours(enc, ["alpha beta gamma delta"])
    assert ours(enc, ["alpha beta gamma delta"]) == one
    assert len(enc.known) <= 8


def test_cases_in_spark(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "hello world"), (4, "hello world"), (None, "x")]
    df = spark.createDataFrame([(i, t, t, 7) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = [(r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()]
    assert (1, []) in got and (2, []) in got and got.count((4, [31373, 995])) == 2 and any(i is None for i, _ in got)
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    assert counts[1] == 0 and counts[4] == 2
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    back = bpe.decode_ids(bpe.encode_corpus(df)).where("doc_id IS NOT NULL").select("doc_id", "decoded").distinct()
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: "", 2: "", 3: "  \n", 4: "hello world"}
