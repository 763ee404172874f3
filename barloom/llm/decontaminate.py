"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.batches import by_pieces, input_columns, lean
from barloom.session import kept

WINDOW_WORDS = 10
#: Item text an automaton is built over; more items take further passes over the documents.
MAX_ITEM_CHARS = 2_000_000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to lower case, every byte that belongs to no word to a space.
_NORMAL = bytes(32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, with what ends in each state."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW_WORDS):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if words:
                sequences.append((item, words))
                last = 0
                for w in words:
                    last = self._extend(last, w)
        n = len(self.link)
        #: State of the last ``window`` words, for the states that hold as many.
        self.window_state = [-1] * n
        #: Items below the window length that end in a state as a whole: length, then ids.
        self.whole: list[dict[int, set]] = [{} for _ in range(n)]
        self.window_items: dict[int, set] = {}
        self.shortest = min([window, *(len(w) for _, w in sequences)])
        for state in sorted(range(1, n), key=self.length.__getitem__):
            above = self.link[state]
            if self.window_state[above] >= 0:
                self.window_state[state] = self.window_state[above]
            elif self.length[state] >= window > self.length[above]:
                self.window_state[state] = state
        for item, words in sequences:
            for at, (state, matched) in enumerate(self.walk(words)):
                if at + 1 >= window:
                    self.window_items.setdefault(self.window_state[state], set()).add(item)
                elif len(words) < window and at + 1 == len(words):
                    self.whole[state].setdefault(matched, set()).add(item)
        #: The nearest state at or above each that has whole items; -1 without one.
        self.whole_above = [-1] * n
        for state in sorted(range(n), key=self.length.__getitem__):
            self.whole_above[state] = state if self.whole[state] else self.whole_above[self.link[state]] if state else -1

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._copy(last, word, there)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            there = self.next[at][word]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._copy(at, word, there)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.link) - 1

    def _copy(self, at: int, word: int, there: int) -> int:
        """Split off from ``there`` what is reached from ``at`` and its suffixes."""
        copy = self._state(self.length[at] + 1, dict(self.next[there]))
        self.link[copy], self.link[there] = self.link[there], copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word."""
        state = matched = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            there = self.next[state].get(w)
            if there is not None:
                state, matched = there, matched + 1
            yield state, matched

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Hit words of a document as flags, and the items that have a window in it."""
        flags, items = np.zeros(len(words), bool), set()
        if not self.vocabulary or len(words) < self.shortest:
            return flags, items
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(ids < 0)
        begins, ends = np.r_[0, unknown + 1], np.r_[unknown, len(ids)]
        for a in np.flatnonzero(ends - begins >= self.shortest):
            begin, end = int(begins[a]), int(ends[a])
            for at, (state, matched) in enumerate(self.walk(ids[begin:end].tolist()), begin):
                if matched >= self.window:
                    flags[at - self.window + 1 : at + 1] = True
                    items |= self.window_items.get(self.window_state[state], set())
                above = self.whole_above[state]
                while above >= 0:
                    for size, ids_there in self.whole[above].items():
                        if size <= matched:
                            flags[at - size + 1 : at + 1] = True
                            items |= ids_there
                    above = self.whole_above[self.link[above]] if above else -1
        return flags, items


def find_hits(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """``documents`` with ``n_words``, ``hit_runs`` (first and last place of each run of hit words) and ``item_ids``.

    A window is ``window`` consecutive item words, or a whole shorter item. Null
    or wordless documents have no words; items without words are ignored; an
    item without an id marks words but is not listed; items or documents that
    repeat give the same as one. Items are spread over as many automata as their
    measured size asks for, and every document passes through each of them. Very
    long texts are walked like others; an empty table gives no rows; input columns
    that have one of the new names are replaced by them.
    """
    items, parts = _items(benchmark, item_id, item_text)
    added = T.StructType.fromDDL("n_words bigint, hit_runs array<array<bigint>>, item_ids array<string>")
    names = [f.name for f in documents.schema.fields if f.name not in added.names]
    found = documents.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("bigint").alias("n_words"), *[F.array().cast(added[c].dataType).alias(c) for c in ("hit_runs", "item_ids")])
    for part in range(parts):
        if part:
            found = kept(found, "hits")
        automaton = _automaton(items, part, parts, window)
        found = found.mapInArrow(lean(_marker(automaton, names.index(text), found.columns)), found.schema)
    return found


def _runs(flags: np.ndarray) -> list[list[int]]:
    """First and last place of each run of flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [[a, b - 1] for a, b in edge.reshape(-1, 2).tolist()]


def _items(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS) -> tuple[DataFrame, int]:
    """The items, and the number of automata that their measured size asks for."""
    items = input_columns(benchmark, item_id=item_id, text=item_text)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, int(size // MAX_ITEM_CHARS) + 1


def _automaton(items: DataFrame, part: int, parts: int, window: int) -> Automaton:
    own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
    return Automaton([(r.item_id if r.item_id is None else str(r.item_id), r.text) for r in own.collect()], window)


def _marker(automaton: Automaton, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, text_at):
            counts, runs, found = [], [], []
            for t, before, listed in zip(*(batch.column(i).to_pylist() for i in (text_at, len(names) - 2, len(names) - 1))):
                words = words_of(t)
                flags, items = automaton.hits(words)
                for a, b in before:
                    flags[a : b + 1] = True
                counts.append(len(words))
                runs.append(_runs(flags))
                found.append(sorted({*listed, *(i for i in items if i is not None)}))
            columns = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names) - 3)), *columns], names=names)

    return run


def summary(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`find_hits` per document."""
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0] + 1)
    return hits.select(
        F.col(doc_id), "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", max_span: int = 0, max_coverage: float = 0.5, **names: str) -> DataFrame:
    """``documents`` without hit passages; documents mostly made of them go.

    Runs of over ``max_span`` hit words are cut out of the text, from the first
    to the last of their words. A document in which hit words make up more than
    ``max_coverage`` of all words goes altogether. Others stay as they are, null
    and empty ones too. Columns are those of ``documents``, whatever their names.
    """
    columns = documents.columns
    at = columns.index(text)
    private = [f"_{i}" for i in range(len(columns))]
    plain = documents.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(columns, private)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema.fields])
    items, parts = _items(benchmark, **names)
    if parts == 1:
        automaton = _automaton(items, 0, 1, names.get("window", WINDOW_WORDS))
        return plain.mapInArrow(lean(_cutter(at, columns, max_span, max_coverage, automaton)), schema)
    hits = find_hits(plain, benchmark, private[at], **names)
    return hits.select(*private, "n_words", "hit_runs").mapInArrow(lean(_cutter(at, columns, max_span, max_coverage)), schema)


def _cutter(at: int, columns: list[str], max_span: int, max_coverage: float, automaton: Automaton | None = None):
    """Cuts runs of hit words; they come with the rows, or an automaton finds them in the same pass."""
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, at):
            texts, keep = [], []
            found = zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()) if automaton is None else None
            for t in batch.column(at).to_pylist():
                if found is None:
                    words = words_of(t)
                    count, runs = len(words), _runs(automaton.hits(words)[0])
                else:
                    count, runs = next(found)
                hit = sum(b - a + 1 for a, b in runs)
                keep.append(not runs or hit <= max_coverage * count)
                texts.append(_cut(t, [r for r in runs if r[1] - r[0] + 1 > max_span]) if keep[-1] and runs else t)
            out = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(n)]
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep, pa.bool_()))

    return run


def _cut(text: str, runs: list[list[int]]) -> str:
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw.translate(_LOWER))]
    out, done = [], 0
    for a, b in runs:
        out.append(raw[done : spans[a][0]])
        done = spans[b][1]
    return b"".join([*out, raw[done:]]).decode()


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
