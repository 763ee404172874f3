"""Encoding and decoding against the public library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import sentencepiece as S
from tests.llm.conftest import prose

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = S.Vocabulary.load(PATH)
ALPHABET = ["a", "b", "t", "h", "e", " ", "  ", "▁", "\n", "é", "日", "\x00", "\U00013000", "!", "0", "the ", "ab", "<s>", "<0x41>", "\t"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join) | st.text(max_size=40))
def test_encodes_and_decodes_as_the_library(text):
    ids = LIBRARY.encode(text)
    assert next(S.Encoder(OURS).encode([text])) == ids
    assert OURS.decode(ids) == LIBRARY.decode(ids)
    if text:  # the merge rounds alone, over the whole text as one word
        assert list(OURS.merge_words([S.SPACE + text.replace(" ", S.SPACE)])[0]) == ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 300), max_size=12))
def test_decodes_any_ids_as_the_library(ids):
    assert OURS.decode(ids) == LIBRARY.decode(ids)


def test_long_texts_and_runs():
    rng = random.Random(1)
    for text in [prose(rng, 20_000), "ab" * 5000, " " * 3000 + "x", "a" + " " * 999, "é" * 2000]:
        assert next(S.Encoder(OURS).encode([text])) == LIBRARY.encode(text)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED_WORDS", 10)
    rng, encoder = random.Random(2), S.Encoder(OURS)
    for _ in range(30):
        texts = [prose(rng, 8) for _ in range(3)]
        assert list(encoder.encode(texts)) == LIBRARY.encode(texts)


def test_frames(documents):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, "  two  spaces ")]
    df = documents(rows)
    out = S.decode(S.encode(df, OURS, digests=True), OURS)
    assert out.columns == [*df.columns, "ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in out.collect():
        ids = LIBRARY.encode(r.text or "")
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), r.text or "")
        assert (r.ids_sha256, r.decoded_sha256) == (sha(",".join(map(str, ids))), sha(r.text or ""))
    assert S.encode(documents([]), OURS).collect() == []


def test_refuses_vocabularies_it_cannot_follow():
    with pytest.raises(ValueError, match="byte pieces"):
        S.Vocabulary(["<unk>", "a"], [0.0, -1.0], ["unknown", "normal"])
