"""Language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.batches import by_pieces, chunks, input_columns
from barloom.session import kept

#: Frequent words of which the last one seen is a context, and words whose counts are sent to every task.
MARKER_WORDS, SENT_WORDS = 31, 131_072
#: Slots of each predictor's table, as powers of two. Fixed: contexts that meet in a slot share its counts.
TABLE_BITS = (16, 20, 21, 21, 22, 22)
#: Bytes at the beginning of a word that are predicted with the marker word; the rest looks at the word alone.
LEAD = 4
#: Different words a task gathers, and leads whose scores it remembers, before it starts again.
GATHERED, REMEMBERED = 100_000, 100_000
#: Text a task takes at a time, and bytes of different words whose bits are worked on at a time.
PIECE_BYTES, BLOCK_BYTES = 1_000_000, 20_000
#: Slots of one part of a table on its way through the shuffle.
SLICE = 1 << 14
#: Bins of the refinement, and how many observations the mixed probability counts for there.
BINS, TRUST = 24, 30.0

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b""  # stands after the last word; written as a line feed, words as their bytes and a space


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*(text or "").encode().translate(_LOWER).split(), _END]


# --- contexts and counts ----------------------------------------------------------

_BIT = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.uint8)
#: Place in the byte before each bit: a one, then the bits so far.
_NODE = ((np.arange(256)[:, None] >> np.arange(8, 0, -1)) | (1 << np.arange(8))).astype(np.uint8)
#: The same within each half of the byte: 1 to 15, so that the four bits of a half lie in one block of 16 slots.
_STEP = np.concatenate([_NODE[:, :4], (np.arange(256)[:, None] % 16 >> np.arange(4, 0, -1)) | (1 << np.arange(4))], axis=1).astype(np.uint32)
_FACTOR, _MULTIPLIER = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return (h ^ (h >> np.uint64(29))) * _FACTOR >> np.uint64(34)


def written(word: bytes) -> bytes:
    """The bytes of a word and what ends it."""
    return word + b" " if word else b"\n"


@dataclass
class Events:
    """The bits of some strings: byte by byte, with the slots of each bit in the tables."""

    code: np.ndarray
    #: First byte of each string, and the number of its bytes.
    begin: np.ndarray
    size: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    tail: bool


def events(strings: list[bytes], marker: np.ndarray | None = None) -> Events:
    """Bits of the leads of words after their ``marker``, or, without, of what comes after the leads.

    The contexts of a lead are the last one, two and three bytes, and the last
    one, two and three with the marker word; those of a tail the last one to five
    bytes and the whole word so far.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(size) - size
    code = np.frombuffer(b"".join(strings), np.uint8)
    place = np.arange(len(code)) - np.repeat(begin, size)
    tail = marker is None
    last = [np.where(place >= k, np.r_[np.zeros(min(k, len(code)), np.uint8), code[:-k]], 0).astype(np.uint64) for k in range(1, 6 if tail else 4)]
    two = last[0] | last[1] << np.uint64(8)
    three = two | last[2] << np.uint64(16)
    if tail:
        power = np.cumprod(np.full(int(size.max(initial=1)), _MULTIPLIER, np.uint64))
        term = (code.astype(np.uint64) + np.uint64(1)) * power[place]
        so_far = np.cumsum(term) - term
        so_far -= np.repeat(so_far[begin], size)
        four = three | last[3] << np.uint64(24)
        contexts = [two, three, four, four | last[4] << np.uint64(32), so_far ^ place.astype(np.uint64)]
        here = place >= LEAD
        code, contexts, last = code[here], [c[here] for c in contexts], [x[here] for x in last]
        size = size - LEAD
        begin = np.cumsum(size) - size
    else:
        mark = np.repeat(marker.astype(np.uint64) + np.uint64(1), size) << np.uint64(24)
        contexts = [two, three, last[0] | mark, three | mark, two | mark]
    node = _NODE[code]
    slots = [(last[0].astype(np.uint32)[:, None] << np.uint32(8)) | node]
    step = _STEP[code]
    half = (code >> 4).astype(np.uint64) + np.uint64(1) << np.uint64(56)
    for k, (bits, context) in enumerate(zip(TABLE_BITS[1:], contexts)):
        context = context ^ np.uint64((2 * k + tail + 1) << 48)
        slot = np.empty((len(code), 8), np.uint32)
        mask = np.uint64((1 << bits) - 1)
        slot[:, :4] = (_mixed(context) & mask)[:, None]
        slot[:, 4:] = (_mixed(context ^ half) & mask)[:, None]
        slot ^= step
        slots.append(slot)
    return Events(code, begin, size, _BIT[code], slots, tail)


#: Counts are kept exactly up to 31 and in steps of a factor 2 ** (1 / 8) above.
_EXACT = 32
_COUNT = np.concatenate([np.arange(_EXACT), _EXACT * 2.0 ** (np.arange(256 - _EXACT) / 8)])


def packed_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Both counts of a slot in 16 bits."""
    out = np.zeros(len(zeros), np.uint16)
    for counts, shift in ((zeros, 8), (ones, 0)):
        large = _EXACT + np.rint(8 * np.log2(np.maximum(counts, _EXACT) / _EXACT)).astype(np.int64)
        out |= (np.where(counts < _EXACT, counts, np.minimum(large, 255)).astype(np.uint16) << shift).astype(np.uint16)
    return out


def _evidence() -> np.ndarray:
    """Log odds of a one in eighths by packed counts; then those without one zero, then those without one one."""
    zeros, ones = _COUNT[:, None], _COUNT[None, :]
    fewer = lambda n: np.where((n >= 1) & (n < _EXACT), n - 1, n)
    odds = lambda n0, n1: np.clip(np.rint(8 * np.log((n1 + 0.4) / (n0 + 0.4))), -127, 127)
    return np.stack([odds(zeros, ones), odds(fewer(zeros), ones), odds(zeros, fewer(ones))]).astype(np.int8).reshape(-1)


def _seen() -> np.ndarray:
    """How well known a slot is, in the same order as the evidence: never seen, up to three times, more."""
    total = _COUNT[:, None] + _COUNT[None, :]
    levels = [np.digitize(total - d, [0.5, 3.5]) for d in (0, 1, 1)]
    return np.stack(levels).astype(np.uint8).reshape(-1)


_EVIDENCE, _SEEN = _evidence(), _seen()
_INPUTS = len(TABLE_BITS) + 1
_GATES = 2 * 9 * 8


@dataclass
class Mixer:
    """Weights of the predictors by gate, and the refinement of what they give together."""

    weights: np.ndarray
    seen: np.ndarray
    ones: np.ndarray

    @classmethod
    def fresh(cls) -> Mixer:
        weights = np.full((_INPUTS, _GATES), 0.2)
        weights[-1] = 0.0
        return cls(weights, np.zeros(256 * BINS), np.zeros(256 * BINS))

    def refined(self) -> np.ndarray:
        middle = 1 / (1 + np.exp(-(np.arange(BINS) - BINS / 2 + 0.5)))
        return ((self.ones + TRUST * np.tile(middle, 256)) / (self.seen + TRUST)).astype(np.float32)


@dataclass
class Evidence:
    """What scoring reads of the tables: log odds, and for the last two how well known a slot is."""

    odds: list[np.ndarray]
    seen: list[np.ndarray]

    @classmethod
    def of(cls, tables: list[np.ndarray]) -> Evidence:
        return cls([_EVIDENCE[t] for t in tables], [_SEEN[t] for t in tables[-2:]])

    def inputs(self, found: Events) -> tuple[list[np.ndarray], np.ndarray]:
        """Evidence of each predictor for each bit, and the gate."""
        return [o.take(s) for o, s in zip(self.odds, found.slots)], _gate(found, *(x.take(s) for x, s in zip(self.seen, found.slots[-2:])))


def _gate(found: Events, before_last: np.ndarray, last: np.ndarray) -> np.ndarray:
    return ((before_last * 3 + last + 9 * found.tail) * 8 + np.arange(8, dtype=np.uint8)).astype(np.intp)


def _held_back(tables: list[np.ndarray], found: Events) -> tuple[list[np.ndarray], np.ndarray]:
    """The same while learning: a bit's own occurrence is taken out of the counts, which then tell what would be known without it."""
    shift = (np.uint32(1) + found.bit.astype(np.uint32)) << np.uint32(16)
    states = [table[slot] + shift for table, slot in zip(tables, found.slots)]
    return [_EVIDENCE[s] for s in states], _gate(found, _SEEN[states[-2]], _SEEN[states[-1]])


def _logits(weights: np.ndarray, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
    total = weights[-1].take(gate)
    for w, x in zip(weights * np.float32(0.125), inputs):
        total += w.take(gate) * x
    return np.clip(total, -13.0, 13.0, out=total)


def _refinement_cell(code: np.ndarray, logits: np.ndarray) -> np.ndarray:
    bins = np.clip(logits + BINS / 2, 0, BINS - 1).astype(np.int32)
    return _NODE[code].astype(np.int32) * BINS + bins


def string_scores(strings: list[bytes], marker: np.ndarray | None, evidence: Evidence, mixer: Mixer) -> np.ndarray:
    """log10 probability of each lead after its marker word, or of each word's tail after its lead."""
    weights, refined = mixer.weights.astype(np.float32), mixer.refined()
    # chance of a zero, then of a one, in each cell
    halves = 0.5 * np.concatenate([1 - refined, refined])
    out = np.empty(len(strings))
    for a, b in chunks([len(w) for w in strings], BLOCK_BYTES):
        found = events(strings[a:b], None if marker is None else marker[a:b])
        logits = _logits(weights, *evidence.inputs(found))
        cell = _refinement_cell(found.code, logits) + found.bit.astype(np.int32) * len(refined)
        np.negative(logits, where=found.bit == 1, out=logits)
        chance = np.float32(0.5) / (1 + np.exp(logits)) + halves.take(cell)
        out[a:b] = np.add.reduceat(np.log10(chance).sum(axis=1, dtype=np.float64), found.begin)
    return out


def fresh_curve() -> np.ndarray:
    """Curvature that keeps the first weights in place until something is learned; one matrix a gate."""
    return np.tile(np.eye(_INPUTS) * 100.0, (_GATES, 1, 1))


def learn(strings: list[bytes], marker: np.ndarray | None, times: np.ndarray, tables: list[np.ndarray], mixer: Mixer, curve: np.ndarray) -> None:
    """Predict, then update the mixer, block by block.

    A gate's weights take a Newton step by the block's slope and all the
    curvature gathered so far, so that steps get smaller as more is seen.
    """
    for a, b in chunks([len(w) for w in strings], BLOCK_BYTES):
        found = events(strings[a:b], None if marker is None else marker[a:b])
        bit = found.bit
        inputs, gate = _held_back(tables, found)
        logits = _logits(mixer.weights.astype(np.float32), inputs, gate)
        p = 1 / (1 + np.exp(-logits))
        weight = np.repeat(times[a:b].astype(np.float32), found.size)[:, None]
        pull, bend = weight * (bit - p), weight * np.maximum(p * (1 - p), 1e-3)
        both = np.stack([*(x * np.float32(0.125) for x in inputs), np.ones_like(p)], axis=2)
        for place in range(8):
            order = np.argsort(gate[:, place], kind="stable")
            cuts = np.searchsorted(gate[order, place], np.arange(place, _GATES + 8, 8).astype(gate.dtype))
            x, bent, pulled = both[order, place], bend[order, place], pull[order, place]
            for g, lo, hi in zip(range(place, _GATES, 8), cuts[:-1], cuts[1:]):
                if lo < hi:
                    curve[g] += (x[lo:hi] * bent[lo:hi, None]).T @ x[lo:hi]
                    mixer.weights[:, g] += np.linalg.solve(curve[g], x[lo:hi].T @ pulled[lo:hi])
        cell = _refinement_cell(found.code, logits).ravel()
        wide = np.broadcast_to(weight, bit.shape)
        mixer.seen += np.bincount(cell, weights=wide.ravel(), minlength=256 * BINS)
        mixer.ones += np.bincount(cell, weights=(wide * bit).ravel(), minlength=256 * BINS)


# --- Spark: what is gathered from the corpus ---------------------------------------


def _split(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of all texts, without their ends, and the text of each."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    return np.repeat(np.arange(len(column)), size)[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()


def _bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _word_counts(documents: DataFrame) -> DataFrame:
    """``(word, c)`` of all tokens."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0
        for batch in by_pieces(batches, 0, PIECE_BYTES):
            ends += batch.num_rows
            _, words = _split(batch.column(0))
            times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            held.append(pa.table({"word": words.dictionary.cast(pa.binary()), "c": pa.array(times, pa.int64())}))
            if sum(map(len, held)) > 2 * GATHERED:
                held = [summed(held)]
                if len(held[0]) > GATHERED:
                    yield from held.pop().to_batches()
        if ends:
            yield from summed([*held, pa.table({"word": pa.array([_END], pa.binary()), "c": pa.array([ends], pa.int64())})]).to_batches()
        # the worker lives on, and what its next task needs is not what this one held
        held.clear()
        pa.default_memory_pool().release_unused()

    return documents.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _counter_batch(counted: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], names=["word", "c"])


@dataclass
class Piece:
    """The tokens of some documents: different words and leads, their numbers in order, and the marker before each."""

    spelled: pa.Array
    leads: list[bytes]
    number: np.ndarray
    lead_number: np.ndarray
    marker: np.ndarray
    document: np.ndarray

    @cached_property
    def words(self) -> list[bytes]:
        return [*_bytes(self.spelled), _END]


def piece_of(texts: pa.Array, markers: dict[bytes, int]) -> Piece:
    document, encoded = _split(texts)
    n = len(texts)
    # the end stands after the last word of each text and has the last number
    ends = np.cumsum(np.bincount(document, minlength=n))
    number = np.insert(encoded.indices.to_numpy().astype(np.int64), ends, len(encoded.dictionary))
    document = np.insert(document, ends, np.arange(n))
    spelled = encoded.dictionary.cast(pa.binary())
    space = pa.scalar(b" ", pa.binary())
    leads = pa.concat_arrays([pc.binary_slice(pc.binary_join_element_wise(spelled, space, b""), 0, LEAD), pa.array([written(_END)], pa.binary())]).dictionary_encode()
    names = sorted(markers, key=markers.__getitem__)
    kinds = pc.fill_null(pc.index_in(spelled, pa.array(names, pa.binary())), -1).to_numpy()
    kind = np.r_[np.r_[[markers[w] for w in names], 0][kinds] if len(kinds) else [], 0].astype(np.int64)[number]
    begin = (ends + np.arange(n) - np.bincount(document, minlength=n) + 1)[document]
    at = np.arange(len(number))
    latest = np.maximum.accumulate(np.where(kind > 0, at, 0))
    before = np.r_[0, latest[:-1]]
    marker = np.where((before >= begin) & (at > begin), kind[before], 0)
    return Piece(spelled, _bytes(leads.dictionary), number, leads.indices.to_numpy().astype(np.int64)[number], marker, document)


def _lead_counts(documents: DataFrame, markers: dict[bytes, int]) -> DataFrame:
    """``(word, c)``: how often each lead follows each marker word, whose number is the last byte."""
    spread = MARKER_WORDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()
        for batch in by_pieces(batches, 0, PIECE_BYTES):
            piece = piece_of(batch.column(0), markers)
            pairs, times = np.unique(piece.lead_number * spread + piece.marker, return_counts=True)
            for lead, marker, c in zip((pairs // spread).tolist(), (pairs % spread).tolist(), times.tolist()):
                counted[piece.leads[lead] + bytes((marker,))] += c
            if len(counted) > GATHERED:
                yield _counter_batch(counted)
                counted.clear()
        if counted:
            yield _counter_batch(counted)
        counted.clear()
        pa.default_memory_pool().release_unused()

    return documents.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _strings(counts: DataFrame, leads: DataFrame) -> DataFrame:
    """``(string, marker, c)``: all leads with their marker, and all words that have a tail, in a fixed order."""
    tails = counts.filter(F.length("word") >= LEAD).select(F.concat("word", F.lit(b" ")).alias("string"), F.lit(None).cast("int").alias("marker"), "c")
    marked = leads.select(F.expr("substring(word, 1, length(word) - 1)").alias("string"), F.expr("conv(hex(substring(word, -1, 1)), 16, 10)").cast("int").alias("marker"), "c")
    both = marked.unionByName(tails)
    return both.repartition(F.xxhash64("string")).sortWithinPartitions(F.xxhash64("string", "marker"), "string", "marker")


def _strings_in(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray | None, np.ndarray]]:
    """Leads with their markers, then tails, each with how often they occur."""
    for is_tail in (False, True):
        part = batch.filter(pc.equal(pc.is_null(batch.column(1)), is_tail))
        if part.num_rows:
            yield _bytes(part.column(0)), None if is_tail else part.column(1).to_numpy().astype(np.int64), part.column(2).to_numpy()


def _few_tasks(strings: DataFrame) -> DataFrame:
    """As many tasks as there are cores: each keeps tables of a fixed size, so their number must not follow the input."""
    return strings.coalesce(strings.sparkSession.sparkContext.defaultParallelism)


def _tables(strings: DataFrame) -> list[np.ndarray]:
    """Counts of all contexts, over all words; partial tables are added part by part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(2 << bits, np.uint32) for bits in TABLE_BITS]
        pack = zstandard.ZstdCompressor(level=1)

        def parts() -> Iterator[pa.RecordBatch]:
            for k, table in enumerate(sums):
                for i in range(0, len(table), 2 * SLICE):
                    part = table[i : i + 2 * SLICE]
                    if part.any():
                        columns = [pa.array([k], pa.int32()), pa.array([i // (2 * SLICE)], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["k", "part", "counts"])
                table[:] = 0

        gathered = 0
        for batch in batches:
            for some, marker, times in _strings_in(batch):
                if gathered + times.sum() > 1 << 31:
                    yield from parts()
                    gathered = 0
                gathered += times.sum()
                for a, b in chunks([len(w) for w in some], BLOCK_BYTES):
                    found = events(some[a:b], None if marker is None else marker[a:b])
                    each = np.repeat(times[a:b], found.size)[:, None]
                    each = np.broadcast_to(each.astype(np.uint32), found.bit.shape).ravel()
                    for table, slot in zip(sums, found.slots):
                        np.add.at(table, (slot * np.uint32(2) + found.bit).ravel(), each)
        yield from parts()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(2 * SLICE, np.int64)
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def done() -> pa.RecordBatch:
            state = pack.compress(packed_counts(total[::2], total[1::2]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([state], pa.binary())], names=["k", "part", "counts"])

        for batch in batches:
            for k, part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (k, part):
                    if held is not None:
                        yield done()
                    held = (k, part)
                    total[:] = 0
                raw = np.frombuffer(unpack.decompress(counts), np.uint32)
                total[: len(raw)] += raw
        if held is not None:
            yield done()

    schema = "k int, part int, counts binary"
    merged = _few_tasks(strings).mapInArrow(count, schema).repartition("k", "part").sortWithinPartitions("k", "part").mapInArrow(add, schema)
    out = [np.zeros(1 << bits, np.uint16) for bits in TABLE_BITS]
    for r in merged.collect():
        state = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), np.uint16)[: len(out[r.k])]
        out[r.k][r.part * SLICE : r.part * SLICE + len(state)] = state
    return out


def _mixer(strings: DataFrame, shared) -> Mixer:
    """Mixers that the tasks learned online from all strings, averaged by how much each has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, curve, total = Mixer.fresh(), fresh_curve(), 0
        for batch in batches:
            for some, marker, times in _strings_in(batch):
                learn(some, marker, times, shared.value, mixer, curve)
                total += times.sum()
        if total:
            state = np.concatenate([mixer.weights.ravel(), curve.ravel(), mixer.seen, mixer.ones])
            yield pa.RecordBatch.from_arrays([pa.array([state.tolist()], pa.list_(pa.float64()))], names=["state"])

    mixer = Mixer.fresh()
    learned = [np.array(r.state) for r in _few_tasks(strings).mapInArrow(run, "state array<double>").collect()]
    if learned:
        ends = np.cumsum([_INPUTS * _GATES, _GATES * _INPUTS * _INPUTS, 256 * BINS])
        weights, curves, seen, ones = zip(*(np.split(s, ends) for s in learned))
        # a gate's weights count by the curvature that a task gathered there
        curves = [c.reshape(_GATES, _INPUTS, _INPUTS) for c in curves]
        pulls = sum(np.einsum("gij,jg->gi", c, w.reshape(_INPUTS, _GATES)) for c, w in zip(curves, weights))
        mixer = Mixer(np.linalg.solve(sum(curves), pulls[:, :, None])[:, :, 0].T.copy(), sum(seen), sum(ones))
    return mixer


def tail_scores(words: list[bytes], evidence: Evidence, mixer: Mixer) -> np.ndarray:
    """log10 probability of what comes after the lead of each word; zero for words that have no more."""
    out = np.zeros(len(words))
    long = [i for i, w in enumerate(words) if len(w) >= LEAD]
    if long:
        out[long] = string_scores([written(words[i]) for i in long], None, evidence, mixer)
    return out


@dataclass
class Frequent:
    """Words that every task knows."""

    words: pa.Array
    counts: np.ndarray
    tails: np.ndarray


@dataclass
class LanguageModel:
    """What scoring needs: exact word counts as a table, and the shared part that every task gets."""

    counts: DataFrame
    tokens: int
    words: int
    shared: object


def train(documents: DataFrame, text: str = "text") -> LanguageModel:
    """Gather the statistics of all ``documents`` and learn the mixer from them.

    Words are counted exactly, then how often each lead, the first bytes of a
    word, follows each marker word (the last of the 31 most frequent words). That
    is all that the contexts look at, so the tables and the mixer are made from
    these counts instead of from the texts. The tables have a fixed size, in
    which every context of the corpus is counted; the number of words and leads
    is not bounded. Null and empty texts have no words but an end. No documents
    give a model that knows nothing.
    """
    source = input_columns(documents, text=text)
    counts = kept(_word_counts(source), "words")
    tokens, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sent = [(bytes(r.word), r.c) for r in counts.orderBy(F.col("c").desc(), "word").limit(SENT_WORDS).collect()]
    markers = {w: i for i, w in enumerate([w for w, _ in sent if w != _END][:MARKER_WORDS], 1)}
    strings = kept(_strings(counts, _lead_counts(source, markers)), "strings")
    context = documents.sparkSession.sparkContext
    tables = _tables(strings)
    sent_tables = context.broadcast(tables)
    mixer = _mixer(strings, sent_tables)
    sent_tables.unpersist()
    evidence = Evidence.of(tables)
    # the frequent words with their counts, and the scores of their tails, in alphabetical order
    sent.sort()
    known = [w for w, _ in sent]
    frequent = Frequent(pa.array(known, pa.binary()), np.array([c for _, c in sent], np.int64), tail_scores(known, evidence, mixer))
    return LanguageModel(counts, tokens, words, context.broadcast((evidence, frequent, markers, mixer)))


# --- scoring ----------------------------------------------------------------------


def score(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``documents`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte``.

    ``score`` is the model's log10 probability of the words and the end of a
    text: the product over the bits of its bytes, each predicted from its
    contexts, mixed and refined. The learned state stays as it is while scoring,
    so a text's score does not depend on what is scored before it. ``base_score``
    is that of words by their counts plus one. Counts of frequent words are at
    hand in every task, as are the scores of what comes after their leads; the
    counts of all others are joined, and each of those words is scored there.

    Null and empty texts are scored by their end alone; very long texts and
    words are worked on in blocks. Repeated rows are scored each by itself; an
    empty table gives no rows. Input columns that have one of the new names are
    replaced, others stay.
    """
    added = T.StructType.fromDDL("n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")
    names = [c for c in documents.columns if c not in added.names]
    private = [f"_{i}" for i in range(len(names))]
    plain = documents.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, private)], F.col(f"`{text}`").alias("text"))
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    found = numbered.mapInArrow(_scorer(len(names), model.shared), T.StructType([*numbered.drop("text", "row").schema.fields, *T.StructType.fromDDL(_FOUND).fields]))
    found = kept(found, "scored")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    # equal words come together in the join, so that each is scored about once
    scored = rare.join(model.counts, "word", "left").select("row", "word", "times", "c").mapInArrow(_rare_scorer(model.shared), "row bigint, times bigint, c bigint, tail double")
    more = scored.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("known_more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("base_more"), F.sum(F.col("times") * F.col("tail")).alias("score_more")
    )
    joined = found.join(more, "row", "left")
    share = F.log10(F.lit(float(model.tokens + model.words + 1)))
    base = F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * share
    value = F.col("score") + F.coalesce("score_more", F.lit(0.0))
    return joined.select(
        *[F.col(p).alias(c) for p, c in zip(private, names)], "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), value.alias("score"), (value / -np.log10(2.0) / F.col("n_bytes")).alias("bits_per_byte"),
    )


_FOUND = "row bigint, n_tokens bigint, n_bytes bigint, known bigint, base double, score double, rare array<binary>, times array<bigint>"


def _scorer(width: int, shared):
    spread = MARKER_WORDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, frequent, markers, mixer = shared.value
        # one more at the end, for words that are not among the frequent
        counts, tails = np.r_[frequent.counts, -1], np.r_[frequent.tails, 0.0]
        known: dict[bytes, float] = {}

        def of_leads(keys: list[bytes]) -> np.ndarray:
            if len(known) > REMEMBERED:
                known.clear()
            new = [k for k in keys if k not in known]
            if new:
                made = string_scores([k[:-1] for k in new], np.fromiter((k[-1] for k in new), np.int64, len(new)), evidence, mixer)
                known.update(zip(new, made.tolist()))
            return np.fromiter((known[k] for k in keys), float, len(keys))

        for batch in by_pieces(batches, width, PIECE_BYTES):
            n_docs = batch.num_rows
            piece = piece_of(batch.column(width), markers)
            pairs, of = np.unique(piece.lead_number * spread + piece.marker, return_inverse=True)
            keys = [piece.leads[i] + bytes((m,)) for i, m in zip((pairs // spread).tolist(), (pairs % spread).tolist())]
            spelled = pa.concat_arrays([piece.spelled, pa.array([_END], pa.binary())])
            at = pc.fill_null(pc.index_in(spelled, frequent.words), len(frequent.words)).to_numpy()
            value = of_leads(keys)[of] + tails[at][piece.number]
            sums = lambda x: np.bincount(piece.document, weights=x, minlength=n_docs)
            c = counts[at][piece.number]
            base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), 0.0)
            size = pc.binary_length(spelled).to_numpy().astype(np.int64)[piece.number] + 1
            # the words that are not at hand, with their number in each document
            open_at = np.flatnonzero(c < 0)
            each, times = np.unique(piece.document[open_at] * len(spelled) + piece.number[open_at], return_counts=True)
            offsets = pa.array(np.searchsorted(each // len(spelled), np.arange(n_docs + 1)), pa.int32())
            rare = spelled.take(pa.array(each % len(spelled)))
            columns = [
                batch.column(width + 1), pa.array(np.bincount(piece.document, minlength=n_docs)), pa.array(sums(size).astype(np.int64)), pa.array(sums(c >= 0).astype(np.int64)),
                pa.array(sums(base)), pa.array(sums(value)), pa.ListArray.from_arrays(offsets, rare), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), *columns], names=[*batch.schema.names[:width], *(f.split()[0] for f in _FOUND.split(", "))])

    return run


def _rare_scorer(shared):
    """``(row, times, c, tail)`` of ``(row, word, times, c)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, _, _, mixer = shared.value
        last, last_score = None, 0.0
        for batch in batches:
            words = batch.column(1).dictionary_encode()
            spelled = _bytes(words.dictionary)
            # the last word of a batch goes on in the next
            fresh = [w for w in spelled if w != last]
            made = iter(tail_scores(fresh, evidence, mixer).tolist())
            score = np.array([last_score if w == last else next(made) for w in spelled])[words.indices.to_numpy()]
            if len(score):
                last, last_score = spelled[words.indices[-1].as_py()], score[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(score, pa.float64())], names=["row", "times", "c", "tail"])

    return run


def trained_and_scored(documents: DataFrame, learn_from: Column, text: str = "text") -> DataFrame:
    """Scores of all ``documents`` by a model of those for which ``learn_from`` holds."""
    return score(documents, train(documents.filter(learn_from), text), text)
