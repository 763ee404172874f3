"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Edge cases: a null text counts as empty and gives no ids; text without spaces is
one long word; repeated rows are encoded each on their own; an empty table gives
no rows; extra columns pass through untouched, but for those that have the name
of a new column, which takes their place. Models whose normaliser changes the text are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.batches import by_pieces, chunks, lean

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Words remembered by a task, twice at most: recent ones, and those before them.
REMEMBERED_WORDS = 50_000
#: Characters of words whose merge rounds run together.
MERGED_CHARS = 250_000
#: A vocabulary is sent to every task, so its size is checked.
MAX_PIECES = 1_000_000


class Vocabulary:
    """Pieces, pair ranks and byte values of a BPE model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"{len(pieces)} pieces; at most {MAX_PIECES} are sent to the tasks")
        self.n = len(pieces)
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.byte_ids = np.full(256, -1, np.int64)
        self.surface, self.space_first = [], np.zeros(self.n, bool)
        self.is_byte = np.zeros(self.n, bool)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                value = int(p[3:5], 16)
                self.byte_ids[value] = i
                self.is_byte[i] = True
                self.surface.append(bytes([value]))
            elif k == "control":
                self.surface.append(b"")
            elif k == "unknown":
                self.surface.append(" ⁇ ".encode())
            else:
                self.space_first[i] = p.startswith(SPACE)
                self.surface.append(p.replace(SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        # characters that only occur inside longer pieces get symbols of their own after the pieces
        inner = sorted({c for p in normal for c in p} - normal.keys())
        self.inner = "".join(inner)
        symbols = normal | {c: self.n + i for i, c in enumerate(inner)}
        self.symbol_of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol_of_char[ord(s)] = i
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        self.base = np.int64(self.n + len(inner))
        pairs = []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs.append((left * int(self.base) + right, rank_of[scores[i]], i))
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs] + [NONE], np.int32)
        self.pair_merged = np.array([p[2] for p in pairs] + [-1], np.int32)
        #: Words can be encoded apart if no piece holds the space mark after another character.
        self.by_word = not any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in normal)
        self.run_lengths = {len(p): i for p, i in normal.items() if p.strip(SPACE) == ""}
        # runs of the mark are put together last of all if their pieces share the lowest score
        tied = {scores[i] for i in self.run_lengths.values()}
        self.runs_last = len(tied) == 1 and all(scores[i] > min(tied) for p, i in normal.items() if len(p) > 1 and p.strip(SPACE))
        self.digits = [str(i) for i in range(self.n)]

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """Read a model file with the public library's own reader."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, train = model.normalizer_spec, model.trainer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or train.treat_whitespace_as_suffix or train.model_type != 2:
            raise ValueError(f"{path}: only BPE models that keep the text as it is and put a space first are supported")
        kinds = {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
        if any(p.type not in kinds for p in model.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        return Vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], [kinds[p.type] for p in model.pieces])

    # --- merge rounds ---------------------------------------------------------

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the pair table; its last place means no pair."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        hit = at < len(self.pair_keys)
        hit[hit] = self.pair_keys[at[hit]] == key[hit]
        return np.where(hit & (left >= 0) & (right >= 0), at, len(self.pair_keys))

    def merge_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word: rounds of simultaneous leftmost merges over flat symbol arrays."""
        done: list[tuple[int, ...]] = [()] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.symbol_of_char[code]
        sym = np.where(sym < 0, -1 - code.astype(np.int64), sym)  # an unknown character keeps its code
        word = np.repeat(np.arange(len(words)), sizes)
        pair = self._pairs(sym, word)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(self.pair_rank[pair], first)
            length = np.diff(np.r_[first, len(sym)])
            ended = best == NONE
            if ended.any():
                over = np.repeat(ended, length)
                self._finish(sym[over], word[over], done)
                sym, word, pair = sym[~over], word[~over], pair[~over]
                best, length = best[~ended], length[~ended]
                if not len(sym):
                    break
            low = np.repeat(best, length)
            at = self._leftmost(np.flatnonzero(self.pair_rank[pair] == low))
            at = self._without_conflicts(sym, word, pair, low, at)
            sym[at] = self.pair_merged[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            new = place[at]
            touched = np.r_[new, new[new > 0] - 1]
            pair[touched] = self._pairs_at(sym, word, touched)
        return done

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._pairs_at(sym, word, np.arange(len(sym)))

    def _pairs_at(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), len(self.pair_keys))
        inside = at + 1 < len(sym)
        inside[inside] = word[at[inside]] == word[at[inside] + 1]
        out[inside] = self._find(sym[at[inside]], sym[at[inside] + 1])
        return out

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of places that overlap in a row, every other one from the left."""
        fresh = np.r_[True, at[1:] != at[:-1] + 1]
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - begin) % 2 == 0]

    def _without_conflicts(self, sym, word, pair, low, at) -> np.ndarray:
        """Only the leftmost merge of a word in which a merge makes a pair that comes before the others."""
        several = np.flatnonzero(np.r_[False, word[at[1:]] == word[at[:-1]]] | np.r_[word[at[1:]] == word[at[:-1]], False])
        if not len(several):
            return at
        some = at[several]
        made = self.pair_merged[pair[some]]
        bad = np.zeros(len(some), bool)
        merged_before = np.zeros(len(sym), bool)
        merged_before[at] = True
        for step in (2, -1, -2):  # the next symbol as it stands; the one before; a merge that ends just before
            other = some + step
            near = (other >= 0) & (other < len(sym))
            near[near] = word[other[near]] == word[some[near]]
            if step == -2:
                near[near] = merged_before[other[near]]
            left, right = made[near], sym[other[near]]
            if step == -2:
                left, right = self.pair_merged[pair[other[near]]], left
            elif step == -1:
                left, right = right, left
            bad[near] |= self.pair_rank[self._find(left, right)] <= low[some[near]]
        if not bad.any():
            return at
        alone = np.unique(word[some[bad]])
        later = np.r_[False, word[at[1:]] == word[at[:-1]]]
        return at[~(later & np.isin(word[at], alone))]

    def _finish(self, sym: np.ndarray, word: np.ndarray, done: list[tuple[int, ...]]) -> None:
        if (sym < 0).any() or (sym >= self.n).any():
            sym, word = self._to_bytes(sym, word)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        ids, ends = sym.tolist(), [*first[1:].tolist(), len(sym)]
        for w, a, b in zip(word[first].tolist(), first.tolist(), ends):
            done[w] = tuple(ids[a:b])

    def _to_bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces, as the byte pieces of their characters."""
        odd = (sym < 0) | (sym >= self.n)
        kinds, which = np.unique(sym[odd], return_inverse=True)
        spelt = [[int(self.byte_ids[b]) for b in (chr(-1 - s) if s < 0 else self.inner[s - self.n]).encode()] for s in kinds.tolist()]
        count = np.ones(len(sym), np.int64)
        count[odd] = np.array([len(x) for x in spelt])[which]
        out = np.repeat(sym, count)
        begin = (np.cumsum(count) - count)[odd]
        for i in range(4):
            has = count[odd] > i
            out[begin[has] + i] = np.array([x[i] if i < len(x) else -1 for x in spelt])[which[has]]
        return out, np.repeat(word, count)

    def space_run(self, n: int) -> tuple[int, ...]:
        """Ids of ``n`` space marks on their own: always the leftmost pair that forms a piece."""
        blocks: list[int] = []
        for _ in range(n):
            blocks.append(1)
            while len(blocks) > 1 and blocks[-2] + blocks[-1] in self.run_lengths:
                blocks[-2:] = [blocks[-2] + blocks[-1]]
        return tuple(self.run_lengths[b] for b in blocks)

    # --- decoding -------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if ids and self.space_first[ids[0]]:
            raw = raw[1:]
        elif ids and not self.surface[ids[0]]:  # control pieces come first
            lead = next((i for i in ids if self.surface[i]), None)
            raw = raw[1:] if lead is not None and self.space_first[lead] else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:  # every byte that is not part of a character is marked on its own
            text = raw.decode("utf-8", "surrogateescape")
            return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text)


class Encoder:
    """Encodes texts word by word and remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.mark = vocabulary.run_lengths.get(1)
        self.split = vocabulary.by_word and vocabulary.runs_last and self.mark is not None

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        if not self.split:
            whole = [SPACE + t.replace(" ", SPACE) for t in texts if t]
            got = iter(self.vocabulary.merge_words(whole))
            for t in texts:
                yield list(next(got)) if t else []
            return
        parts = [t.replace(SPACE, " ").split(" ") for t in texts]
        if len(self.words) > REMEMBERED_WORDS:  # words used since stay, the others go
            self.words, self.older = {}, self.words
        missing = list(set(chain.from_iterable(parts)).difference(self.words))
        if self.older:
            self.words.update((w, self.older[w]) for w in missing if w in self.older)
            missing = [w for w in missing if w not in self.older]
        for a, b in chunks([len(w) for w in missing], MERGED_CHARS):
            self.words.update(zip(missing[a:b], self.vocabulary.merge_words([SPACE + w for w in missing[a:b]])))
        for t, words in zip(texts, parts):
            if not t:
                yield []
            elif "" in words:
                yield self._with_runs(words)
            else:
                yield list(chain.from_iterable(map(self.words.__getitem__, words)))

    def _with_runs(self, words: list[str]) -> list[int]:
        ids: list[int] = []
        marks = 0
        for w in words:
            marks += 1
            if w:
                got = self.words[w]
                if got[0] == self.mark:
                    got = got[1:]
                else:
                    marks -= 1
                ids += self.vocabulary.space_run(marks)
                ids += got
                marks = 0
        return ids + list(self.vocabulary.space_run(marks))


def _with_column(df: DataFrame, out: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name not in {n for n, _ in out}], *[T.StructField(n, t) for n, t in out]])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str | None = "ids", digests: bool = False) -> DataFrame:
    """``df`` with the ids of every whole text in the column ``into``, unless that is None.

    With ``digests`` the ids are also decoded again, and the columns ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256`` are added.
    """
    out = [(into, T.ArrayType(T.IntegerType()))] if into else []
    if digests:
        out += [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    schema = _with_column(df, out)
    kept = [f.name for f in schema.fields[: len(schema.fields) - len(out)]]
    made = [n for n, _ in out]
    source = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in by_pieces(batches, len(kept)):
            rows = []
            for ids in encoder.encode([t or "" for t in batch.column(len(kept)).to_pylist()]):
                row = (pa.array(ids, pa.int32()),) if into else ()
                if digests:
                    joined = ",".join(map(vocabulary.digits.__getitem__, ids))
                    row += (len(ids), _sha(joined), _sha(vocabulary.decode(ids)))
                rows.append(row)
            columns = [_lists(c) if into and i == 0 else pa.array(c) for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns], names=[*kept, *made])

    return source.mapInArrow(lean(run), schema)


def _lists(rows: tuple[pa.Array, ...]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(rows))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of every id list; null lists give empty text."""

    schema = _with_column(df, [(into, T.StringType())])
    kept = [f.name for f in schema.fields[:-1]]
    source = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [vocabulary.decode(i or []) for i in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, into])

    return source.mapInArrow(lean(run), schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
