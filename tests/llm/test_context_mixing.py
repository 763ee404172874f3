from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import context_mixing as cm
from tests.llm.conftest import prose


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().translate(cm._LOWER).split(), None]


def plain_base(rows):
    """Token counts and base scores by their definition."""
    counts = Counter(t for i, x in rows if i is not None and not held_out(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, x in rows:
        words = tokens(x)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, len(words), sum(counts[w] > 0 for w in words), n, base))
    return out


def crc():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7


def scored(documents, rows):
    found = cm.trained_and_scored(documents(rows), crc() != 2)
    return found, found.collect()


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(80)) + f" Only{i} x") for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "  \t\n"), (None, "then ouble"), (5, rows[5][1]), (1003, "Straße ÉA \x85 a\xa0b")]


def test_counts_and_base_scores(documents, monkeypatch):
    monkeypatch.setattr(cm, "SENT_WORDS", 20)  # most words are joined
    monkeypatch.setattr(cm, "GATHERED", 50)
    rows = corpus()
    frame, found = scored(documents, rows)
    assert frame.columns[: len(documents([]).columns)] == documents([]).columns
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in found), key=str)
    assert got == sorted(((*r[:4], round(r[4], 8)) for r in plain_base(rows)), key=str)


def test_held_out_texts_are_likelier_than_by_word_counts(documents):
    _, found = scored(documents, corpus(n=600))
    out = [r for r in found if held_out(r.doc_id) and r.n_tokens > 5]
    assert len(out) > 50
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in found)
    # word salad in the same letters is less likely, byte by byte, than the language
    rng = random.Random(2)
    salad = [(i, "".join(rng.sample(prose(rng, 40), 200))) for i in range(2000, 2060)]
    model = cm.train(documents(corpus(n=600)))
    mean = lambda rows: np.mean([r.bits_per_byte for r in cm.score(documents(rows), model).collect()])
    assert mean(salad) > mean([(i, prose(rng, 40)) for i in range(60)]) + 1


def test_probabilities_of_all_continuations_add_up():
    """The scores are those of one distribution: over the bytes after a beginning they sum to 1."""
    rng = random.Random(3)
    words = [w.encode() for w in prose(rng, 500).split()]
    leads, marker = [cm.written(w)[: cm.LEAD] for w in words], np.array([i % 3 for i in range(len(words))])
    tails = [cm.written(w) for w in words if len(w) >= cm.LEAD]
    tables = [np.zeros(1 << b, np.uint16) for b in cm.TABLE_BITS]
    parts = [cm.events(leads, marker), cm.events(tails)]
    for k, table in enumerate(tables):
        zeros, ones = (sum(np.bincount(e.slots[k][e.bit == b], minlength=len(table)) for e in parts) for b in (0, 1))
        table[:] = cm.packed_counts(zeros, ones)
    mixer, curve = cm.Mixer.fresh(), cm.fresh_curve()
    both = lambda: cm.string_scores(leads, marker, cm.Evidence.of(tables), mixer).sum() + cm.string_scores(tails, None, cm.Evidence.of(tables), mixer).sum()
    before = both()
    for strings, marks in ((leads, marker), (tails, None)):
        cm.learn(strings, marks, np.ones(len(strings), np.int64), tables, mixer, curve)
    assert both() > before
    every = [bytes([b]) for b in range(256)]
    for begin, marks in ((b"th", np.ones(256, np.int64)), (b"", np.zeros(256, np.int64)), (b"thon", None)):
        scores = cm.string_scores([begin + b for b in every], marks, cm.Evidence.of(tables), mixer)
        known = cm.string_scores([begin], marks[:1], cm.Evidence.of(tables), mixer)[0] if begin and marks is not None else 0.0
        assert (10 ** (scores - known)).sum() == pytest.approx(1.0, abs=1e-4)


def test_blocks_and_pieces_do_not_change_a_score(documents, monkeypatch):
    rows = corpus(n=100)
    model = cm.train(documents(rows))
    want = {r.doc_id: r.score for r in cm.score(documents(rows), model).collect()}
    monkeypatch.setattr(cm, "PIECE_BYTES", 300)
    monkeypatch.setattr(cm, "REMEMBERED", 10)
    got = {r.doc_id: r.score for r in cm.score(documents(rows), model).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-4) for i in want)


def test_counts_are_packed_exactly_while_small():
    n = np.arange(40_000_000, step=9973)
    got = cm._COUNT[cm.packed_counts(n, n) & 255]
    assert np.all(np.abs(got / np.maximum(n, 1) - 1)[1:] < 0.05)
    small = np.arange(32)
    assert (cm._COUNT[cm.packed_counts(small, small) >> 8] == small).all()


def test_empty_tables_and_a_very_long_word(documents):
    assert scored(documents, [])[1] == []
    rows = [(1, "x" * 300_000), (2, "thon " * 50_000), (3, "a b")]
    _, found = scored(documents, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    none = cm.score(documents(rows), cm.train(documents([]))).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in none} == {(0, 0, 0.0)}


def test_markers_are_the_last_frequent_word_before():
    piece = cm.piece_of(pa.array(["a the b the of c", "b", None]), {b"the": 1, b"of": 2})
    assert [piece.words[n] for n in piece.number] == [b"a", b"the", b"b", b"the", b"of", b"c", b"", b"b", b"", b""]
    assert piece.marker.tolist() == [0, 0, 1, 1, 1, 2, 2, 0, 0, 0]


def test_a_word_that_is_not_sent_is_scored_once_where_equal_words_meet(monkeypatch):
    made: list[bytes] = []

    def scores(strings, marker, evidence, mixer):
        if marker is None:
            made.extend(strings)
        return np.arange(1.0, len(strings) + 1)

    monkeypatch.setattr(cm, "string_scores", scores)
    monkeypatch.setattr(cm, "PIECE_BYTES", 1)
    frequent = cm.Frequent(pa.array([b"", b"often", b"the"], pa.binary()), np.array([9, 7, 5]), np.array([0.0, -2.0, 0.0]))
    shared = type("Shared", (), {"value": (None, frequent, {}, None)})
    texts = pa.RecordBatch.from_arrays([pa.array(["often seldom", "seldom often the", "seldom rarely"]), pa.array([0, 1, 2])], names=["text", "row"])
    out = pa.Table.from_batches(list(cm._scorer(0, shared)(iter([texts])))).to_pylist()
    assert made == [] and [r["known"] for r in out] == [2, 3, 1]
    assert [r["rare"] for r in out] == [[b"seldom"], [b"seldom"], [b"seldom", b"rarely"]]
    joined = [([2], [b"rarely"]), ([0], [b"seldom"]), ([1, 2], [b"seldom", b"seldom"])]
    batches = [pa.RecordBatch.from_arrays([pa.array(row), pa.array(word, pa.binary()), pa.array([1] * len(row)), pa.array([None] * len(row), pa.int64())], names=["row", "word", "times", "c"]) for row, word in joined]
    tails = pa.Table.from_batches(list(cm._rare_scorer(shared)(iter(batches)))).column("tail").to_pylist()
    assert made == [b"rarely ", b"seldom "] and tails == [1.0, 1.0, 1.0, 1.0]
