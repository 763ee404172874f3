from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from barloom.llm import lexical
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(documents, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in documents]
    n_docs = sum(bool(b) for _, b in bags)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, t in items:
        wanted.setdefault(item, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, bag in bags:
            n = sum(bag.values())
            score = 0
            for t in terms & bag.keys():
                m = 50 + (50 * n * n_docs) // length
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc, score))
        found.sort(key=lambda x: x[:2] + (x[2] or 0,))
        out += [(item, rank, f[2], f[3]) for rank, f in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    return lambda items: spark.createDataFrame([(i, t, 1, 2, "d") for i, t in items], "item_id bigint, text string, rank int, score int, doc string")


def test_scores_are_those_of_the_formula(documents, benchmark):
    rng = random.Random(5)
    texts = [(i, prose(rng, rng.randrange(60))) for i in range(300)]
    texts += [(1000 + i, texts[7][1]) for i in range(40)]  # a group of copies, all tied
    texts += [(5000, None), (5001, ""), (5002, " .,! "), (None, texts[3][1]), (3, texts[3][1]), (5003, "Straße x_y 12AB ab12")]
    items = [(i, prose(rng, 9)) for i in range(20)] + [(20, None), (21, "...."), (22, texts[7][1]), (22, "12ab"), (None, "straße x y"), (23, "the the THE then")]
    want = plain(texts, items, 10)
    assert rows(lexical.search(documents(texts), benchmark(items), k=10)) == want


def test_more_items_than_one_automaton_and_small_blocks(documents, benchmark, monkeypatch):
    rng = random.Random(6)
    texts = [(i, prose(rng, 30)) for i in range(200)]
    items = [(i, prose(rng, 6)) for i in range(30)]
    want = plain(texts, items, 5)
    for name, value in (("MAX_ITEMS", 8), ("CELLS", 100), ("HELD", 40)):
        monkeypatch.setattr(lexical, name, value)
    assert rows(lexical.search(documents(texts), benchmark(items), k=5)) == want


def test_empty_tables(documents, benchmark):
    assert rows(lexical.search(documents([]), benchmark([(1, "a b")]))) == []
    assert rows(lexical.search(documents([(1, "a b")]), benchmark([]))) == []
    assert rows(lexical.search(documents([(1, "a b")]), benchmark([(1, None)]))) == []


def test_a_very_long_text(documents, benchmark):
    rng = random.Random(7)
    texts = [(1, prose(rng, 400_000)), (2, "then " * 10), (3, "x" * 3_000_000 + " thenth")]
    items = [(1, "then thenth ouble"), (2, "x" * 3_000_000)]
    assert rows(lexical.search(documents(texts), benchmark(items))) == plain(texts, items, 50)
