"""Hits of benchmark windows against a search for every window."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from barloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        v = words(item_text)
        n = min(window, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(6)
    few = ["a", "b", "c", "É", "x1", "Ünï"]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.choice([1, 3, 9, 10, 11, 14, 25])))) for i in range(3, 40)]
    items = [x for x in items if len(words(x[1])) > 2]
    items += [(100, ""), (101, None), (None, "zz yy xx"), (9, "a repeated id, with its own words here and many more of them"), (200, "Stop_word"), (3, items[0][1])]
    docs = [" ".join(rng.choice(few + ["q"]) for _ in range(rng.randrange(60))) for _ in range(120)]
    docs += [f"Some Text: {t.upper()}! more" for _, t in items if t] + [None, "", "...", "zz-yy_xx", "stop WORD"]
    return items, list(enumerate(docs))


@pytest.mark.parametrize("chars", [2_000_000, 300])
def test_equals_brute_force(spark, documents, monkeypatch, chars):
    monkeypatch.setattr(D, "MAX_ITEM_CHARS", chars)  # the second: several automata
    items, docs = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in D.summary(D.find_hits(documents(docs), bench)).collect()}
    assert got == {i: brute_force(t, items) for i, t in docs}


def test_removal(spark, documents):
    item = "one two three four five six seven eight nine ten eleven twelve"
    lead = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"{lead} — {item.upper()}; the end"), (2, item), (3, lead), (4, None), (5, ""), (1, f"{item} {lead} {item}.")]
    df = documents(docs)
    out = D.decontaminate(df, spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    assert out.columns == df.columns
    assert sorted((r.doc_id, str(r.text)) for r in out.collect()) == sorted([(1, f"{lead} — ; the end"), (1, f" {lead} ."), (3, lead), (4, "None"), (5, "")])
    assert D.decontaminate(df, spark.createDataFrame([], "item_id bigint, text string")).count() == len(docs)
    assert D.find_hits(documents([]), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect() == []
