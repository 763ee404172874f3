"""Line deduplication against a comparison of all pairs of lines."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from barloom.llm import line_dedup as L
from tests.llm.conftest import prose


def brute_force(docs):
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for n, line in enumerate(L.lines_of(t)):
            if line:
                first.setdefault(line, (i, n))
    lines, root = list(first), {line: line for line in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for y, b in enumerate(lines):
        for a in lines[:y]:
            if L.similar(L.shingles(a), L.shingles(b)):
                root[find(b)] = find(a)
    keep = {}
    for line in lines:
        r = find(line)
        keep[r] = min(keep.get(r, first[line]), first[line])
    out = {}
    for i, t in docs:
        raw = (t or "").split("\n")
        gone = [bool(line) and keep[find(line)] != (i, n) for n, line in enumerate(L.lines_of(t))]
        out[i] = None if t is None else "\n".join(r for r, g in zip(raw, gone) if not g)
    return out


def test_equals_brute_force(documents):
    rng = random.Random(3)
    base = [prose(rng, 30) for _ in range(12)]

    def edited(line):
        words = line.split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = "zebra"
        return " ".join(words)

    docs = [(i, "\n".join([edited(rng.choice(base)) for _ in range(4)] + [prose(rng, 25), "Of.", "", "  Of. "])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, prose(rng, 20_000)), (104, "a"), (105, "a\na")]
    got = {r.doc_id: r.text for r in L.deduplicate(documents(docs)).collect()}
    assert got == brute_force(docs)


def test_variants_of_one_line_in_one_bucket_stay_connected(documents):
    # a long chain of edits: neighbours are similar, ends are not
    words = prose(random.Random(5), 60).split()
    docs = []
    for i in range(40):
        docs.append((i, " ".join(words)))
        words[i] = "zebra"
    got = {r.doc_id: r.text for r in L.deduplicate(documents(docs)).collect()}
    assert got[0] == docs[0][1] and all(got[i] == "" for i in range(1, 40))


def test_columns_nulls_and_repeats(documents):
    df = documents([(1, "one line of text"), (1, "one line of text"), (None, "one line of text"), (2, "one line of text"), (None, "mine alone")])
    out = L.deduplicate(df)
    assert out.columns == df.columns
    rows = sorted(((r.doc_id, r.text, r.text_hash) for r in out.collect()), key=str)
    # rows alike in id and text share their fate
    assert rows == [(1, "one line of text", "x"), (1, "one line of text", "x"), (2, "", "x"), (None, "", "x"), (None, "mine alone", "x")]


def test_empty_table(documents):
    assert L.deduplicate(documents([])).collect() == []



def test_sketches_never_rule_out_similar_lines_and_keep_most_others_from_their_texts():
    rng = random.Random(11)
    base = [prose(rng, n) for n in (1, 2, 8, 30, 60, 90, 30, 40)] + ["ab" * 300, "a", "abc", "abc\0", "é漢" * 40]
    lines = list(base)
    for line in base:
        words = line.split()
        for k in (1, 2, 3):
            lines.append(" ".join("zebra" if rng.random() < 0.02 * k else w for w in words))
        lines.append(line[: len(line) * 9 // 10])
    cells, fewest = L.sketches(lines)
    assert all(n <= len(L.shingles(line)) for n, line in zip(fewest.tolist(), lines))
    assert cells.max() == L.FULL  # more shingles in a cell than it can count
    for a in range(len(lines)):
        may = L.maybe_similar(cells[a], fewest[a], cells, fewest)
        assert all(m for m, line in zip(may, lines) if L.similar(L.shingles(lines[a]), L.shingles(line)))
    other = [" ".join(str(rng.randrange(10**6)) for _ in range(40)) for _ in range(40)]
    cells, fewest = L.sketches(other)
    assert sum(L.maybe_similar(cells[a], fewest[a], cells, fewest).sum() for a in range(40)) < 60


def test_texts_of_lines_without_a_similar_one_stay_where_they_are(documents, monkeypatch):
    # lines that share a bucket with many others, none of which is similar
    rng = random.Random(2)
    words = [str(rng.randrange(10**6)) for _ in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(150)]
    docs += [(200, docs[0][1] + " x"), (201, docs[1][1] + " x")]
    compared = []
    verified = L._verified
    monkeypatch.setattr(L, "_verified", lambda pairs: compared.append(pairs.count()) or verified(pairs))
    got = {r.doc_id: r.text for r in L.deduplicate(documents(docs)).collect()}
    assert got == brute_force(docs)
    buckets = L.buckets(L.signatures([line for _, line in docs]))
    sharing = sum(any((b == other).any() for j, other in enumerate(buckets) if j != i) for i, b in enumerate(buckets))
    assert 2 <= compared[0] < sharing / 3


def test_shingles_as_numbers_compare_like_sets_of_them():
    rng = random.Random(4)
    base = [prose(rng, 20), prose(rng, 3), "abcdefg", "abcdefgh", "aaaaaaaaaaaaaa", "\u00e9t\u00e9 \u0151sz " * 5, "x" * 400 + "y"]
    lines = base + [line[: len(line) * k // 10] for line in base for k in (8, 9)] + [line + " é" for line in base]
    for a in lines:
        for b in lines:
            exact = L.Comparison()
            assert exact.similar(1, a, 2, b) == L.similar(L.shingles(a), L.shingles(b))
    assert all(len(L.shingle_numbers(line)) == len(L.shingles(line)) for line in lines if len(line) >= 7)
    # characters that do not fit, and lines of less than a shingle, are compared as text
    assert L.shingle_numbers("漢字漢字漢字漢字") is None and L.shingle_numbers("abc") is None
    assert not L.Comparison().similar(1, "abc", 2, "abc\0\0\0\0")


def test_lines_that_only_have_exact_copies_are_found_in_one_pass_over_the_texts(documents, monkeypatch):
    rng = random.Random(6)
    own = [" ".join(str(rng.randrange(10**6)) for _ in range(30)) for _ in range(30)]
    docs = [(i, f"license line of everybody\n{own[i]}") for i in range(30)] + [(50, "twice here\ntwice here")]
    passes = []
    occurrences = L._occurrences
    monkeypatch.setattr(L, "_occurrences", lambda *a: passes.append(occurrences(*a).count()) or occurrences(*a))
    got = {r.doc_id: r.text for r in L.deduplicate(documents(docs)).collect()}
    assert got == brute_force(docs)
    # the two lines that repeat, and no line that occurs once
    assert passes == [32]


def plain_shared(rows):
    """What a window over the plain rows of buckets gives."""
    members, out = defaultdict(list), set()
    for bucket, k in rows:
        members[bucket].append(k)
    for bucket, ks in members.items():
        band, different = bucket & L.REPEATED, min(ks) < max(ks)
        if band == L.REPEATED or different or len(ks) > 1 and band == 0:
            least = min(ks) if different and band != L.REPEATED else None
            out |= {(bucket, k, least) for k in ks}
    return out


def test_buckets_of_several_lines_are_found_as_by_a_window():
    rng = np.random.default_rng(8)
    for n, values, lines in ((0, 1, 1), (1, 1, 1), (50, 10, 3), (5000, 900, 40), (5000, 2, 5000)):
        bucket, k = rng.integers(-values, values, n), rng.integers(-lines, lines, n)
        got = [(b, x, least if different else None) for b, x, least, different in zip(*(c.tolist() for c in L.shared_of(bucket, k)))]
        assert len(got) == len(set(got)) and set(got) == plain_shared(zip(bucket.tolist(), k.tolist()))


def test_buckets_travel_packed_by_partition_and_lose_none(documents):
    rng = random.Random(9)
    lines = [prose(rng, 12) for _ in range(150)]
    docs = [(i, f"{lines[i]}\n{lines[i][:-3]} end\n{lines[i // 2]}") for i in range(150)]
    texts = documents(docs).select("text").repartition(2)
    signed = L._signed_lines(texts, 3)
    rows = signed.collect()
    # not one row for each of seven buckets a line
    assert 0 < len(rows) <= 2 * 3 and {r.part for r in rows} <= {0, 1, 2}
    pairs = []
    for r in rows:
        bucket, k = np.frombuffer(r.packed, np.int64).reshape(2, -1).tolist()
        assert {(b >> 3) % 3 for b in bucket} == {r.part}
        pairs += zip(bucket, k)
    different = {line for _, t in docs for line in L.lines_of(t)}
    assert len({p for p in pairs if p[0] & L.REPEATED != L.REPEATED}) == L.BANDS * len(different)
    got = [tuple(r) for r in L._shared_buckets(signed, 3).collect()]
    assert len(got) == len(set(got)) and {(b, k, n) for b, k, n in got if n is not None} == {r for r in plain_shared(pairs) if r[2] is not None}


def test_one_pass_gives_places_and_each_candidate_text_once_a_task(documents):
    docs = [(i, f"line of everybody\nalone {i}") for i in range(6)]
    k = {line: L._keys([line])[1][0] for line in ("line of everybody", "alone 2")}
    maps = []
    for line in k:
        maps.append(np.zeros(L.MAP_BITS // 64, np.int64))
        at = int(k[line]) & (L.MAP_BITS - 1)
        maps[-1][at >> 6] = np.uint64(1 << (at & 63)).astype(np.int64)
    rows = L._rows(documents(docs).coalesce(1), "doc_id", "text")
    got = [(r.doc, r.line_no, r.line) for r in L._occurrences(rows, *maps).collect()]
    assert sorted(got, key=str) == sorted([(0, 0, "line of everybody"), *((i, 0, None) for i in range(1, 6)), (2, 1, None)], key=str)


def test_shingles_of_many_lines_at_once_are_those_of_each():
    rng = random.Random(4)
    lines = [prose(rng, n) for n in (20, 3, 1, 200)] + ["abc", "abcdefg", "漢字" * 9, "", "x" * 50, "é" * 7]
    exact = L.Comparison()
    exact.learn(dict(enumerate(lines)))
    for i, line in enumerate(lines):
        alone, many = L.shingle_numbers(line), exact.numbers[i]
        assert (alone is None) == (many is None)
        if alone is not None:
            assert alone.tolist() == many.tolist() and len(alone) == len(L.shingles(line))


def test_second_pass_only_links_roots_of_components(documents, monkeypatch):
    # a chain of edits whose lines share buckets, so that comparing all of a bucket joins what stars left apart
    words = prose(random.Random(5), 60).split()
    docs = []
    for i in range(40):
        docs.append((i, " ".join(words)))
        words[i] = "zebra"
    passes = []
    connected = L.connected_components

    def recorded(edges):
        found = connected(edges)
        passes.append(([(r.a, r.b) for r in edges.collect()], {r.node: r.root for r in found.collect()}))
        return found

    monkeypatch.setattr(L, "connected_components", recorded)
    got = {r.doc_id: r.text for r in L.deduplicate(documents(docs)).collect()}
    assert got[0] == docs[0][1] and all(got[i] == "" for i in range(1, 40))
    (_, first), (links, _) = passes
    assert links and all(first.get(x, x) == x for link in links for x in link)


def sorts_texts(df) -> bool:
    return "SortMergeJoin" in df._jdf.queryExecution().sparkPlan().toString()


def test_no_task_sorts_whole_texts(spark, documents):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.deduplicate(documents([(1, "one line of text"), (2, "one line of text"), (None, "one line of text"), (3, None)]))
        assert not sorts_texts(out)
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(1, "one line of text"), (2, ""), (3, None), (None, "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
