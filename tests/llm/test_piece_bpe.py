"""Encoding and decoding against the library of the model format."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from areastats.llm import piece_bpe, queries

MODEL = Path(queries.PIECE_MODEL).read_bytes()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
VOCABULARY = piece_bpe.Vocabulary(MODEL)
PARTS = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "日", "本", "😀", "\0", "</s>", "<0x0A>", "12", " " * 17, "İ"]


def encoded(texts):
    ids, counts = VOCABULARY.encode(texts)
    ends = counts.cumsum()
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)]


def same(texts):
    want = LIBRARY.encode(texts)
    assert encoded(texts) == want
    assert [VOCABULARY.decode(w) for w in want] == LIBRARY.decode(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_any_text(texts):
    same(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=8))
def test_built_texts(texts):
    same(texts)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz", "=-_", "01"])
def test_words_of_few_letters(letters):
    rng = random.Random(5)
    same(["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)])


def test_runs_of_spaces():
    same([" " * k + end for k in range(70) for end in ("", "a", "!", "\n", "日", "  b")])


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000, "ab" * 50_000, "日本" * 50_000, "word " * 40_000])
def test_very_long_texts(text):
    same([text])


def test_long_random_word():
    rng = random.Random(6)
    same(["".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(100_000))])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 3), st.integers(120, 258)), max_size=12))
def test_any_ids(ids):
    assert VOCABULARY.decode(ids) == LIBRARY.decode(ids)
    both = np.array([*ids, 2, *ids], np.int64)
    assert VOCABULARY.decode_all(both, np.array([len(ids) + 1, 0, len(ids)])) == [LIBRARY.decode(ids), "", LIBRARY.decode(ids)]


def test_unknown_ids_are_an_error():
    with pytest.raises(ValueError):
        VOCABULARY.decode([32_000])
    with pytest.raises(ValueError):
        VOCABULARY.decode([-1])


def test_known_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(piece_bpe, "KNOWN_SYMBOLS", 50)
    fresh = piece_bpe.Vocabulary(MODEL)
    for k in range(20):
        text = f"some words number {k} and other words"
        assert fresh.encode([text])[0].tolist() == LIBRARY.encode(text)


def test_words_of_one_hash(monkeypatch):
    """Two words that share a hash under the first salt are told apart under the next."""
    fresh = piece_bpe.Vocabulary(MODEL)
    real = fresh._hashes
    monkeypatch.setattr(fresh, "_hashes", lambda *a: real(*a) % (5 if fresh.salt == 0 else 2**64 - 1))
    text = "many different words of many lengths"
    assert fresh.encode([text])[0].tolist() == LIBRARY.encode(text) and fresh.salt == 1


def test_chunks_hold_every_text(monkeypatch):
    monkeypatch.setattr(piece_bpe, "CHUNK_CHARS", 5)
    assert list(piece_bpe._chunks(["ab", "cde", "f", "", "ghijklmn", "o"])) == [["ab", "cde"], ["f", ""], ["ghijklmn"], ["o"]]


def test_query_against_the_library(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op13_piece_round_trip"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = LIBRARY.encode(text or "", add_eos=True)
        row = found[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_edges(spark):
    schema = "doc_id long, text string, ids string, n_tokens int"
    rows = [(1, None), (1, ""), (2, "two words"), (2, "two words"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], schema)
    got = piece_bpe.encode(docs, MODEL)
    want = sorted([(str(i), LIBRARY.encode(t or "", add_eos=True)) for i, t in rows])
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == want
    spelled = piece_bpe.decode(got, MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in spelled) == sorted((str(i), t or "") for i, t in rows)
    none = spark.createDataFrame([], schema)
    assert piece_bpe.decode(piece_bpe.encode(none, MODEL), MODEL).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [None, 2])], "doc_id long, ids array<int>")
    assert [r.text for r in piece_bpe.decode(ids, MODEL).collect()] == ["", ""]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.Vocabulary(b"")
