"""Fuzzy line deduplication by MinHash, exact verification and connected components."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.batches import CHUNK_CHARS, by_pieces, chunks, input_columns, lean
from barloom.llm.components import Forest, connected_components
from barloom.session import kept

SHINGLE_CHARS = 7
THRESHOLD = 0.8
#: At the threshold a pair shares a band with probability 1 - (1 - 0.8**3)**7 = 0.993, and more above it.
BANDS, ROWS = 7, 3
#: Last bits of a row that stands for a line seen again, where those of a bucket are its band.
REPEATED = 7
#: Lines whose signature a task remembers having sent.
REMEMBERED_LINES = 100_000
#: Members of a bucket that are compared with each other in one piece.
BLOCK = 256
#: Pairs whose sketches are compared at a time.
NEAR_PAIRS = 8192
#: Groups of up to this size share the numbers of their pairs.
FEW = 32
#: Larger groups compare finer sketches before texts.
FINE_FROM = 8
#: Bits of the map that keeps lines without any candidate out of the shuffle.
MAP_BITS = 1 << 26
#: Cells of a line's sketch, a byte each; a full one stands for that many shingles or more.
CELLS, FULL = 64, 255
#: The same where the texts are at hand, which leaves few comparisons in vain.
FINE_CELLS = 1024
#: Characters whose hashes are minimised at a time, so that they stay in the cache.
PIECE_CHARS = 200_000
#: The same for sketches, which sort them.
SKETCH_CHARS = 50_000
#: Buckets that a task packs at a time, by the partition they go to.
PACKED_BUCKETS = 1 << 19

_rng = np.random.default_rng(20_240_501)
_XORS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_FACTORS = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def normal(line: str) -> str:
    """A line without white space around it and with single spaces inside."""
    line = line.strip()
    return " ".join(line.split()) if "  " in line or "\t" in line else line


def lines_of(text: str | None) -> list[str]:
    return [normal(line) for line in (text or "").split("\n")]


def shingles(line: str) -> set[str]:
    """Character shingles; a shorter line is one shingle."""
    return {line[i : i + SHINGLE_CHARS] for i in range(max(1, len(line) - SHINGLE_CHARS + 1))}


def similar(a: set[str], b: set[str]) -> bool:
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= THRESHOLD * (len(a) + len(b) - both)


def shingle_numbers(line: str) -> np.ndarray | None:
    """The line's different shingles in order, each as one number of 9 bits a character; none where that is not exact."""
    return all_shingle_numbers([line])[0]


def all_shingle_numbers(lines: list[str]) -> list[np.ndarray | None]:
    """``shingle_numbers`` of many lines, packed in a row; those across lines go."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)
    if len(code) < SHINGLE_CHARS:
        return [None] * len(lines)
    packed = np.zeros(len(code) - SHINGLE_CHARS + 1, np.uint64)
    for i in range(SHINGLE_CHARS):
        packed <<= np.uint64(9)
        packed |= code[i : len(packed) + i]
    wide = np.concatenate(([0], np.cumsum(code >= 512)))
    end = np.cumsum(size)
    out: list[np.ndarray | None] = []
    for a, b, exact in zip((end - size).tolist(), end.tolist(), (wide[end] == wide[end - size]).tolist()):
        if exact and b - a >= SHINGLE_CHARS:
            own = packed[a : b - SHINGLE_CHARS + 1]
            own.sort()
            different = np.empty(len(own), bool)
            different[0] = True
            np.not_equal(own[1:], own[:-1], out=different[1:])
            out.append(own[different])
        else:
            out.append(None)
    return out


def similar_numbers(a: np.ndarray, b: np.ndarray) -> bool:
    """``similar`` for shingles as numbers."""
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    merged = np.concatenate((a, b))
    merged.sort()
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both >= THRESHOLD * (len(a) + len(b) - both)


class Comparison:
    """Exact comparison of lines, whose shingles are made once for as long as it remembers them."""

    def __init__(self):
        self.numbers: dict = {}

    def learn(self, lines: dict) -> None:
        """Make the shingles of these named lines at once, a piece of them at a time, and remember no others."""
        self.numbers = {name: self.numbers[name] for name in lines if name in self.numbers}
        names = [name for name in lines if name not in self.numbers]
        for a, b in chunks([len(lines[name]) for name in names], SKETCH_CHARS):
            self.numbers.update(zip(names[a:b], all_shingle_numbers([lines[name] for name in names[a:b]])))

    def of(self, name, line: str) -> np.ndarray | None:
        if name not in self.numbers:
            if len(self.numbers) >= BLOCK:
                self.numbers.clear()
            self.numbers[name] = shingle_numbers(line)
        return self.numbers[name]

    def similar(self, a, line_a: str, b, line_b: str) -> bool:
        x, y = self.of(a, line_a), self.of(b, line_b)
        return similar(shingles(line_a), shingles(line_b)) if x is None or y is None else similar_numbers(x, y)


# --- signatures -------------------------------------------------------------------


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles in a row, where each line's begin, and how many it has; those across lines lie between."""
    padded = [line if len(line) >= SHINGLE_CHARS else line.ljust(SHINGLE_CHARS, "\0") for line in lines]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    h = np.zeros(len(code) - SHINGLE_CHARS + 1, np.uint32)
    for i in range(SHINGLE_CHARS):
        h *= np.uint32(0x01000193)
        h += code[i : len(h) + i]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h, np.cumsum(size) - size, size - SHINGLE_CHARS + 1


def _own_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of one line after the other, and how many each has."""
    h, begin, n = _hashes(lines)
    within = np.ones(len(h), bool)
    for i in range(1, SHINGLE_CHARS):
        within[begin[1:] - i] = False
    return h[within], n


def signatures(lines: list[str]) -> np.ndarray:
    """MinHash values, one row per hash function and one column per line."""
    h, n = _own_hashes(lines)
    begin = np.cumsum(n) - n
    out, mixed = np.empty((BANDS * ROWS, len(lines)), np.uint32), np.empty_like(h)
    for k in range(BANDS * ROWS):
        np.bitwise_xor(h, _XORS[k], out=mixed)
        np.multiply(mixed, _FACTORS[k], out=mixed)
        np.minimum.reduceat(mixed, begin, out=out[k])
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """One bucket per line and band, as signed longs whose last three bits are the band."""
    out = np.empty((signature.shape[1], BANDS), np.int64)
    for band in range(BANDS):
        h = np.full(signature.shape[1], band + 1, np.uint64)
        for row in signature[band * ROWS : (band + 1) * ROWS]:
            h ^= row
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, band] = h.view(np.int64) & ~REPEATED | band
    return out


def sketches(lines: list[str], n_cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of each line fall into each cell, and at least how many different ones it has."""
    own, n = _own_hashes(lines)
    end = np.cumsum(n)
    cells = np.bincount(np.repeat(np.arange(0, len(lines) * n_cells, n_cells), n) + own % n_cells, minlength=len(lines) * n_cells).reshape(-1, n_cells)
    for a, b in zip((end - n).tolist(), end.tolist()):
        own[a:b].sort()
    fresh = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=fresh[1:])
    fresh[end - n] = True
    return np.minimum(cells, FULL).astype(np.uint8), np.add.reduceat(fresh, end - n, dtype=np.int64)


def maybe_similar(cells_a: np.ndarray, fewest_a: np.ndarray, cells_b: np.ndarray, fewest_b: np.ndarray) -> np.ndarray:
    """False only where the threshold is out of reach: lines share no more shingles than their cells have in common."""
    common = np.minimum(cells_a, cells_b)
    reached = common.sum(axis=-1, dtype=np.int64) * (1 + THRESHOLD) + 1e-6 >= THRESHOLD * (fewest_a + fewest_b)
    return reached | (common.max(axis=-1, initial=0) == FULL)


def _cells(column: pa.Array | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), np.uint8).reshape(-1, CELLS)


def _keys(lines: list[str]) -> tuple[list[bytes], np.ndarray]:
    """128-bit keys of lines, and their first halves as longs."""
    keys = [xxhash.xxh3_128_digest(line.encode()) for line in lines]
    return keys, np.frombuffer(b"".join(keys), np.int64)[::2]


def _signed_lines(texts: DataFrame, n_parts: int) -> DataFrame:
    """``(part, packed)``: buckets of the different lines of each task, a bounded memory apart, and one that ends in REPEATED for those seen again.

    ``packed`` holds the buckets that go to one part, then the ``k`` of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        made: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in by_pieces(batches, 0, PIECE_CHARS):
            found: dict[int, str] = {}
            again: set[int] = set()
            for t in batch.column(0).to_pylist():
                lines = [line for line in lines_of(t) if line]
                if lines:
                    for k, line in zip(_keys(lines)[1].tolist(), lines):
                        if k in found or k in seen:
                            again.add(k)
                        else:
                            found[k] = line
            if len(seen) > REMEMBERED_LINES:
                seen.clear()
            seen.update(found)
            if found:
                numbers = np.fromiter(found, np.int64, len(found))
                made.append((buckets(signatures(list(found.values()))).ravel(), np.repeat(numbers, BANDS)))
            if again:
                numbers = np.fromiter(again, np.int64, len(again))
                made.append((numbers | REPEATED, numbers))
            n += BANDS * len(found) + len(again)
            if n >= PACKED_BUCKETS:
                yield packed(made)
                made, n = [], 0
        if n:
            yield packed(made)

    def packed(made: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, k = (np.concatenate(c) for c in zip(*made))
        part = ((bucket >> 3) % n_parts).astype(np.int32)
        order = np.argsort(part, kind="stable")
        bucket, k = bucket[order], k[order]
        used, begin = np.unique(part[order], return_index=True)
        ends = [*begin.tolist()[1:], len(k)]
        out = [bucket[a:b].tobytes() + k[a:b].tobytes() for a, b in zip(begin.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out, pa.binary())], names=["part", "packed"])

    return texts.mapInArrow(lean(run), "part int, packed binary")


def shared_of(bucket: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, k, least, different)`` of all rows of some buckets: each line of a bucket of several lines once, with the smallest.

    Where ``different`` is false, the line is alone in its bucket but occurs again.
    """
    order = np.argsort(bucket)
    bucket, k = bucket[order], k[order]
    same = bucket[1:] == bucket[:-1]
    repeated = bucket & REPEATED == REPEATED
    several = np.zeros(len(bucket), bool)
    several[1:] |= same
    several[:-1] |= same
    some = several | repeated
    bucket, k, several = bucket[some], k[some], several[some]
    order = np.lexsort((k, bucket))
    bucket, k, several = bucket[order], k[order], several[order]
    first = np.ones(len(bucket), bool)
    first[1:] = bucket[1:] != bucket[:-1]
    once = first.copy()
    once[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(first)
    n = np.diff(np.append(begin, len(bucket)))
    least, most = np.repeat(k[begin], n), np.repeat(k[begin + n - 1], n)
    different = (least < most) & (bucket & REPEATED != REPEATED)
    again = (bucket & REPEATED == REPEATED) | several & (bucket & REPEATED == 0)
    keep = once & (different | again)
    return bucket[keep], k[keep], least[keep], different[keep]


def _shared_buckets(signed: DataFrame, n_parts: int) -> DataFrame:
    """``(bucket, k, least)``: each line of a bucket of several lines once, with the smallest; ``least`` is null for lines that occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.column(1).to_pylist():
                both = np.frombuffer(row, np.int64)
                halves.append((both[: len(both) // 2], both[len(both) // 2 :]))
        if halves:
            bucket, k = (np.concatenate(c) for c in zip(*halves))
            halves.clear()
            bucket, k, least, different = shared_of(bucket, k)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(k), pa.array(least, mask=~different)], names=["bucket", "k", "least"])

    return signed.repartitionById(n_parts, "part").mapInArrow(lean(run), "bucket bigint, k bigint, least bigint")


# --- bit maps ---------------------------------------------------------------------


def bit_map(numbers: DataFrame) -> np.ndarray:
    """A fixed-size map with the bit of every ``k`` set; the fuller it is, the less it keeps out."""
    words = numbers.groupBy(F.expr(f"pmod(k, {MAP_BITS}) >> 6").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(k, {MAP_BITS}) & 63 AS int))")).alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for batch in words.select("w", "bits").toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _marked(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    at = k & (MAP_BITS - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


# --- steps ------------------------------------------------------------------------


def _occurrences(rows: DataFrame, candidates: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """``(key, k, doc, text_hash, line_no, line)`` of every line in one of the maps that is not blank.

    ``line`` is null but for the lines among the candidates, once for each task, a
    bounded memory apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in by_pieces(batches, 2):
            lines, row, number = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                got = [(n, line) for n, line in enumerate(lines_of(t)) if line]
                lines += [line for _, line in got]
                number += [n for n, _ in got]
                row += [i] * len(got)
            if not lines:
                continue
            keys, k = _keys(lines)
            candidate = _marked(candidates, k)
            hit = np.flatnonzero(candidate | _marked(repeated, k))
            if len(seen) > REMEMBERED_LINES:
                seen.clear()
            texts: list[str | None] = []
            for i, wanted in zip(hit.tolist(), candidate[hit].tolist()):
                fresh = wanted and keys[i] not in seen
                if fresh:
                    seen.add(keys[i])
                texts.append(lines[i] if fresh else None)
            place = pa.array(np.array(row, np.int64)[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in hit], pa.binary()), pa.array(k[hit]), batch.column(0).take(place), batch.column(1).take(place), pa.array(np.array(number, np.int32)[hit]), pa.array(texts, pa.string())],
                names=["key", "k", "doc", "text_hash", "line_no", "line"],
            )

    return rows.mapInArrow(lean(run), f"key binary, k bigint, doc {rows.schema['doc'].dataType.simpleString()}, text_hash bigint, line_no int, line string")


def _texts(occurrences: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(key, k, line, cells, fewest)``: each different line of the ``candidates`` once, with its sketch."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, 2, SKETCH_CHARS):
            if batch.num_rows:
                cells, fewest = sketches(batch.column(2).to_pylist())
                columns = [*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(fewest, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cells", "fewest"])

    # a line is dealt out by the first half of its key once, for the candidates and for its copies
    found = occurrences.filter("line IS NOT NULL").select("key", "k", "line").repartition("k")
    # the numbers are what is hashed, so texts are sorted once, for their copies
    once = found.join(candidates.hint("shuffle_hash"), "k", "left_semi").groupBy("k", "key").agg(F.first("line").alias("line"))
    return once.select("key", "k", "line").mapInArrow(lean(sketched), "key binary, k bigint, line string, cells binary, fewest bigint")


def _lines(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(key, line)`` of the lines whose ``k`` is among the numbers, and of the few others that share their bits."""
    bits = bit_map(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(bits, batch.column(1).to_numpy()))).select(["key", "line"])

    return texts.select("key", "k", "line").mapInArrow(lean(run), "key binary, line string")


def _near(pairs: DataFrame) -> DataFrame:
    """Of ``(k, least, a, cells_a, fewest_a, b, cells_b, fewest_b)`` the pairs ``(k, least, a, b)`` whose sketches allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = maybe_similar(_cells(batch.column(4)), batch.column(5).to_numpy(), _cells(batch.column(6)), batch.column(7).to_numpy())
            yield batch.select(["k", "least", "a", "b"]).filter(pa.array(good))

    return pairs.select("k", "least", "a", "b", "cells_a", "fewest_a", "cells_b", "fewest_b").mapInArrow(lean(run), "k bigint, least bigint, a binary, b binary")


def _verified(pairs: DataFrame) -> DataFrame:
    """Of ``(a, line_a, b, line_b)`` the pairs ``(a, b)`` that reach the threshold exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = Comparison()
        for batch in by_pieces(batches, 1, PIECE_CHARS):
            rows = [*zip(*(c.to_pylist() for c in batch.columns))]
            exact.learn({a: line for a, line, _, _ in rows} | {b: line for _, _, b, line in rows})
            good = [exact.similar(a, line_a, b, line_b) for a, line_a, b, line_b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "line_a", "b", "line_b").mapInArrow(lean(run), "a binary, b binary")


_GROUP = ("bucket", "i", "j")


def _grouped(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*_GROUP, *columns).repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one group after the other, which stream in group order."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


@functools.cache
def _few_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``y > x`` below a small ``n``, made once in a process."""
    return np.tril_indices(n, -1)


def _near_by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Each group's rows, and the pairs ``x < y`` of them, by ``y``, in different components whose sketches allow the threshold.

    Columns begin with ``bucket, i, j, block, root`` and end with ``cells, fewest``.
    Many groups are looked through at a time, pairs of one block only where it stands alone.
    """

    def found(groups: list[list[tuple]]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
        rows = [r for group in groups for r in group]
        names: dict[bytes, int] = {}
        root = np.array([names.setdefault(r[4], len(names)) for r in rows])
        block, alone = np.array([r[3] for r in rows]), np.array([r[1] == r[2] for r in rows])
        cells, fewest = _cells([r[-2] for r in rows]), np.array([r[-1] for r in rows])
        place = np.cumsum([0, *map(len, groups)])
        parts = []
        for start, group in zip(place.tolist(), groups):
            y, x = _few_pairs(len(group)) if len(group) <= FEW else np.tril_indices(len(group), -1)
            x, y = x + start, y + start
            apart = (root[x] != root[y]) & (alone[x] | (block[x] != block[y]))
            parts.append((x[apart], y[apart]))
        x, y = (np.concatenate(p) for p in zip(*parts))
        may = np.zeros(len(x), bool)
        for a in range(0, len(x), NEAR_PAIRS):
            p, q = x[a : a + NEAR_PAIRS], y[a : a + NEAR_PAIRS]
            may[a : a + NEAR_PAIRS] = maybe_similar(cells[p], fewest[p], cells[q], fewest[q])
        x, y = x[may], y[may]
        cut = np.searchsorted(y, place)
        for group, start, a, b in zip(groups, place, cut, cut[1:]):
            yield group, x[a:b] - start, y[a:b] - start

    groups, n = [], 0
    for rows in _by_group(batches):
        groups.append(rows)
        n += len(rows)
        if n >= BLOCK:
            yield from found(groups)
            groups, n = [], 0
    if groups:
        yield from found(groups)


def _with_partners(groups: DataFrame) -> DataFrame:
    """Rows ``(bucket, i, j, block, root, key, k, cells, fewest)`` whose sketch allows a link to another component in their group."""

    schema = "bucket bigint, i bigint, j bigint, block bigint, root binary, key binary, k bigint, cells binary, fewest bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64(), pa.binary(), pa.int64()]
        names = [c.split()[0] for c in schema.split(", ")]
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in enumerate(kinds)], names=names)

        for rows, x, y in _near_by_group(batches):
            out += [rows[n] for n in np.union1d(x, y).tolist()]
            if len(out) > 10_000:
                yield made()
                out = []
        if out:
            yield made()

    return _grouped(groups, "block", "root", "key", "k", "cells", "fewest").mapInArrow(lean(run), schema)


def _across(groups: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the roots of different components with similar lines inside a block of a bucket.

    Rows ``(bucket, i, j, block, root, key, line, cells, fewest)`` stream in group
    order; only lines that are not yet connected are compared, each link connects
    two parts.
    """

    def links(rows: list[tuple], x: np.ndarray, y: np.ndarray, exact: Comparison) -> Iterator[tuple[bytes, bytes]]:
        if len(rows) > FINE_FROM:
            parts = [sketches([r[6] for r in rows[a:b]], FINE_CELLS) for a, b in chunks([len(r[6]) for r in rows], SKETCH_CHARS)]
            fine, different = (np.concatenate(p) for p in zip(*parts))
            steps = range(0, len(x), BLOCK)
            may = [maybe_similar(fine[p], different[p], fine[q], different[q]) for p, q in ((x[a : a + BLOCK], y[a : a + BLOCK]) for a in steps)]
            may = np.concatenate([np.zeros(0, bool), *may])
            x, y = x[may], y[may]
            # shingles of a larger group are made for pairs that are left, as long as they fit
            exact, left = Comparison(), {*x.tolist(), *y.tolist()}
            if sum(len(rows[n][6]) for n in left) <= CHUNK_CHARS:
                exact.learn({rows[n][5]: rows[n][6] for n in left})
        forest = Forest()
        for p, q in zip(x.tolist(), y.tolist()):
            (root_a, key_a, line_a), (root_b, key_b, line_b) = rows[p][4:7], rows[q][4:7]
            if forest.find(root_a) != forest.find(root_b) and exact.similar(key_a, line_a, key_b, line_b):
                forest.union(root_a, root_b)
                yield root_a, root_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[bytes, bytes]] = []
        held: list[tuple[list[tuple], np.ndarray, np.ndarray]] = []
        chars = 0

        def found() -> Iterator[tuple[bytes, bytes]]:
            exact.learn({rows[n][5]: rows[n][6] for rows, x, y in held if len(rows) <= FINE_FROM for n in {*x.tolist(), *y.tolist()}})
            for group in held:
                yield from links(*group, exact)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.binary()), pa.array([b for _, b in made], pa.binary())], names=["a", "b"])

        exact = Comparison()
        for rows, x, y in _near_by_group(batches):
            if len(x):
                held.append((rows, x, y))
                chars += sum(len(r[6]) for r in rows)
            if chars > PIECE_CHARS:
                made += found()
                held, chars = [], 0
            if len(made) > 10_000:
                yield out()
                made = []
        made += found()
        if made:
            yield out()

    return _grouped(groups, "block", "root", "key", "line", "cells", "fewest").mapInArrow(lean(run), "a binary, b binary")


def _rooted(keys: DataFrame, components: DataFrame, node: str = "key") -> DataFrame:
    """``keys`` with the root of the component of each one's ``node``, which is its own root where it has no link."""
    found = components.select(F.col("node").alias(node), F.col("root").alias("reached"))
    return keys.join(found, node, "left").withColumn("root", F.coalesce("reached", node)).drop("reached")


def line_components(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of similar lines, components of their roots, and where all lines occur that have a copy or a candidate.

    A line's component is that of its root in the first table, which the second may
    join with others; a line or root that a table does not name stands for itself.

    Every line is first compared with the smallest key of one of its buckets.
    Where that leaves a bucket with several components, their lines are compared
    across in blocks. So no pair of a bucket goes unseen, and a large bucket of
    variants of one line costs about one comparison each. Sketches, from which a
    bound follows on what two lines can share, are joined and compared first;
    the texts only follow for pairs that this leaves.
    """
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = kept(_shared_buckets(_signed_lines(rows.select("text"), n_parts), n_parts), "members")
    members = shared.filter("least IS NOT NULL")
    occurrences = kept(_occurrences(rows, bit_map(members.select("k")), bit_map(shared.filter("least IS NULL").select("k"))), "occurrences")
    texts = kept(_texts(occurrences, members.select("k").distinct()), "lines")
    # two lines whose keys only share their first half meet here as well
    twins = texts.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k", F.col("k").alias("least"))
    left = texts.select("k", F.col("key").alias("a"), F.col("cells").alias("cells_a"), F.col("fewest").alias("fewest_a"))
    right = texts.select(F.col("k").alias("least"), F.col("key").alias("b"), F.col("cells").alias("cells_b"), F.col("fewest").alias("fewest_b"))
    pairs = lambda some: some.join(left, "k").join(right, "least").filter("a <> b")
    # one comparison a line; what it leaves apart is looked at by bucket
    first = members.filter("k <> least").groupBy("k").agg(F.min("least").alias("least"))
    near = kept(_near(pairs(first.unionByName(twins))), "near")
    lines = _lines(texts, near.select("k").unionByName(near.select(F.col("least").alias("k"))))
    with_a = near.hint("shuffle_hash").join(lines.select(F.col("key").alias("a"), F.col("line").alias("line_a")), "a")
    edges = kept(_verified(with_a.join(lines.select(F.col("key").alias("b"), F.col("line").alias("line_b")), "b")), "edges")
    components = kept(connected_components(edges), "components")

    seen = first.select("k", F.col("least").alias("compared"))
    rooted = _rooted(texts.select("k", "key"), components).join(seen, "k", "left")
    open_members = members.join(rooted, "k").select("bucket", "key", "k", "root", F.coalesce(F.col("compared") == F.col("least"), F.lit(False)).alias("compared"))
    open_members = kept(open_members, "members")
    content = [F.bit_xor(F.xxhash64(F.lit(seed), "key")).alias(f"h{seed}") for seed in (0, 1)]
    # roots are told apart by 128 bits, as lines are by their keys; numbers need no sort
    roots = [pick(F.xxhash64(F.lit(seed), "root")).alias(f"{name}{seed}") for seed in (0, 1) for name, pick in (("least", F.min), ("most", F.max))]
    each = open_members.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("compared").alias("done"), *roots, *content)
    # buckets of several bands with the same members are looked through once
    several = each.filter("(least0 <> most0 OR least1 <> most1) AND (n > 2 OR done = 0)")
    open_buckets = several.groupBy("n", "h0", "h1").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    order = Window.partitionBy("bucket").orderBy("root", "key")
    blocks = open_members.join(open_buckets, "bucket").withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    last = F.floor((F.col("n") - 1) / BLOCK)
    spread = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    grouped = spread.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "key", "k")
    partners = kept(_with_partners(grouped.join(texts.select("key", "cells", "fewest"), "key")), "partners")
    more = kept(_across(partners.join(_lines(texts, partners.select("k")), "key")), "edges")
    return components, connected_components(more), occurrences.select("key", "doc", "text_hash", "line_no")


def dropped_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, text_hash, line_nos)``: the lines that go, by document."""
    rows = _rows(documents, doc_id, text)
    components, joined, occurrences = line_components(rows)
    place = F.struct(F.isnull("doc").alias("nameless"), "doc", "text_hash", "line_no")
    each = occurrences.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first_roots = _rooted(each, components).withColumnRenamed("root", "node")
    rooted = kept(_rooted(first_roots, joined, "node").drop("node"), "repeated")
    parts = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("total")).filter("total > 1")
    keep = rooted.join(parts, "root").select("key", "keep")
    gone = occurrences.join(keep, "key").filter(place != F.col("keep"))
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("line_nos"))


def _rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return input_columns(documents, doc=doc_id, text=text).select("doc", F.xxhash64("text").alias("text_hash"), "text")


def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one line kept of every component of similar lines.

    Lines are compared after white space is normalised; two are linked if the
    Jaccard similarity of their character shingles is at least 0.8, and of each
    component the line stays whose document id is smallest, then the first in
    it. Blank lines stay where they are. No document goes: one that loses all
    its lines is left with empty text. Null texts stay null. Rows alike in id
    and text count as one document and share their fate; null ids come last.
    """
    gone = kept(dropped_lines(documents, doc_id, text), "gone")
    names = documents.columns
    at = names.index(text)
    fields = {f.name: f for f in documents.schema.fields}
    private = [f"_{i}" for i in range(len(names))]
    plain = documents.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, private)])
    hashed = plain.withColumn("text_hash", F.xxhash64(private[at])).withColumn("doc", F.col(private[names.index(doc_id)]))
    # the line numbers are what is hashed, so no task sorts texts
    place = gone.select(F.col("doc").alias("gone_doc"), F.col("text_hash").alias("gone_hash"), "line_nos").hint("shuffle_hash")
    joined = hashed.join(place, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    source = joined.select(*private, "line_nos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, at):
            texts = []
            for t, numbers in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if numbers:
                    drop = set(numbers)
                    t = "\n".join(line for n, line in enumerate(t.split("\n")) if n not in drop)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))], names=names)

    return source.mapInArrow(lean(run), T.StructType([fields[c] for c in names]))
