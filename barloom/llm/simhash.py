"""Near-duplicate documents by SimHash, matched exactly through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.batches import bounded_sample, by_pieces, input_columns, lean
from barloom.llm.components import connected_components
from barloom.session import kept

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
#: Shingles a task hashes at a time.
HASHED = 262_144
MAX_DISTANCE = 4
#: Fingerprints aimed at in a shard; more are split further.
SHARD_SIZE = 40_000
#: Fingerprints the vantage points and their distances are chosen from.
SAMPLE = 20_000
#: Of the sample, a shard holds about so many at least: the trees are sent to every task.
SHARD_SAMPLE = 32
#: Fingerprints that a task deals to the shards.
DEALT = 500_000
#: Flips of a block's bits are looked up one by one up to this number.
MAX_FLIPS = 300
#: Beyond that a shard's own tree stops splitting here and compares the rest in blocks.
LEAF = 512
#: Values a split inside a shard is chosen by.
SPLIT_SAMPLE = 256
#: Fingerprints of one block value that are compared together.
GROUP = 1024
#: Pairs compared at a time, apart from those of two such groups.
MAX_PAIRS = 1_000_000

_UPPER = bytes(range(65, 91))
LOWER_ASCII = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingle hashes; 0 without words."""
    return int(_fingerprints([text], words)[0])


def _fingerprints(texts: list[str | None], words: int = SHINGLE_WORDS) -> np.ndarray:
    """:func:`fingerprint` of each text, with the shingles of all texts hashed together."""
    made = np.zeros(len(texts), np.uint64)
    spaced = [b" ".join((t or "").encode().translate(LOWER_ASCII).split()) for t in texts]
    worded = [i for i, t in enumerate(spaced) if t]
    if not worded:
        return made
    data = b" ".join([spaced[i] for i in worded]) + b" "
    n_words = np.array([spaced[i].count(b" ") + 1 for i in worded])
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.r_[0, ends[:-1] + 1]
    # a text of fewer words is one shingle
    n = np.maximum(n_words - words + 1, 1)
    first = np.cumsum(n) - n
    first_word = np.cumsum(n_words) - n_words
    last_word = first_word + n_words - 1
    total = np.zeros((len(worded), BITS), np.int64)
    count = int(n.sum())
    for at in range(0, count, HASHED):
        to = min(count, at + HASHED)
        row = np.repeat(np.arange(len(n)), np.maximum(np.minimum(first + n, to) - np.maximum(first, at), 0))
        word = np.arange(at, to) - first[row] + first_word[row]
        begin = starts[word]
        hashes = xxh64(data, begin, ends[np.minimum(word + words - 1, last_word[row])] - begin)
        _add_bits(total, row, hashes)
    made[worded] = np.packbits(total * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return made


def _add_bits(total: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> None:
    """Add to each row of ``total`` how many of its hashes have each bit; rows are in order."""
    place = np.arange(len(row))
    fresh = np.r_[True, row[1:] != row[:-1]]
    # eight counts to a long, which hold 255 hashes
    cuts = np.flatnonzero(fresh | ((place - np.maximum.accumulate(np.where(fresh, place, 0))) % 255 == 0))
    rows = row[cuts]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    for k in range(8):
        sums = np.add.reduceat(hashes >> np.uint64(k) & np.uint64(0x0101010101010101), cuts)
        total[rows[first], k::8] += np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _round(lane: np.ndarray, held: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    return _turned(held + lane * _P2, 31) * _P1


def xxh64(data: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the stretches of ``data``; those of one length are hashed together, rare and long ones by the library."""
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(sizes, 257).astype(np.uint16), kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(sizes[order]) != 0]) if len(sizes) else order
    lengths = sizes[order[at]]
    eights, fours, ones = (np.ndarray(max(0, len(data) - w + 1), f"<u{w}", data, strides=(1,)) for w in (8, 4, 1))
    with np.errstate(over="ignore"):
        for size, a, b in zip(lengths.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
            group = order[a:b]
            place = starts[group]
            if len(group) < 24 or size > 256:
                out[group] = [xxhash.xxh64_intdigest(data[p : p + size], seed) for p in place.tolist()]
                continue
            done = size - size % 32
            if done:
                held = [np.full(len(group), x, np.uint64) for x in (np.uint64(seed) + _P1 + _P2, np.uint64(seed) + _P2, np.uint64(seed), np.uint64(seed) - _P1)]
                for stripe in range(0, done, 32):
                    held = [_round(eights[place + (stripe + 8 * k)], x) for k, x in enumerate(held)]
                h = _turned(held[0], 1) + _turned(held[1], 7) + _turned(held[2], 12) + _turned(held[3], 18)
                for x in held:
                    h = (h ^ _round(x)) * _P1 + _P4
            else:
                h = np.full(len(group), np.uint64(seed) + _P5, np.uint64)
            h = h + np.uint64(size)
            for done in range(done, size - 7, 8):
                h = _turned(h ^ _round(eights[place + done]), 27) * _P1 + _P4
            done = size - size % 8
            if size - done >= 4:
                h = _turned(h ^ fours[place + done].astype(np.uint64) * _P1, 23) * _P2 + _P3
                done += 4
            for done in range(done, size):
                h = _turned(h ^ ones[place + done].astype(np.uint64) * _P5, 11) * _P1
            h = (h ^ h >> np.uint64(33)) * _P2
            h = (h ^ h >> np.uint64(29)) * _P3
            out[group] = h ^ h >> np.uint64(32)
    return out


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every whole text; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, 1):
            made = _fingerprints(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    source = input_columns(documents, doc_id=doc_id, text=text)
    schema = T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType())])
    return source.mapInArrow(lean(run), schema)


# --- vantage-point trees ---------------------------------------------------------
#
# Two fingerprints within distance d agree closely on at least one of the blocks
# their bits are cut into: one block holds at most d // blocks of the differences.
# So there is one tree per block, and its search radius is only that share. All
# distances to vantage points below are Hamming distances on the tree's block,
# where the triangle inequality holds as well.


def blocks_of(distance: int) -> list[int]:
    """Bit masks of the blocks: with three, a radius of 4 becomes 1 on each."""
    n = 1 if distance < 1 else 3
    cuts = np.linspace(0, BITS, n + 1).astype(int)
    return [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]


class Tree:
    """Inner nodes as flat arrays; leaf ``i`` of the last level is shard ``i``.

    Of two points within the radius that a cut parts, the outer one lies at most
    the radius beyond the cut. So points that near it also go to the inner side,
    never the other way, and every such pair meets in a shard.
    """

    def __init__(self, mask: int, radius: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.vantage: list[int] = []
        self.cut: list[int] = []
        self.children: list[list[int]] = []  # below 0: shard -1 - child
        self.shards = 0

    def grow(self, sample: np.ndarray, most: float, rng: np.random.Generator) -> int:
        """Split ``sample`` by the vantage point and distance that balance best and overlap least, to ``most`` points a shard."""
        best = _best_split(sample & self.mask, self.radius, rng) if len(sample) > most else None
        if best is None:
            self.shards += 1
            return -self.shards
        vantage, cut = best
        node = len(self.vantage)
        self.vantage.append(vantage)
        self.cut.append(cut)
        self.children.append([])
        d = np.bitwise_count((sample & self.mask) ^ np.uint64(vantage))
        self.children[node] = [self.grow(sample[d <= cut + self.radius], most, rng), self.grow(sample[d > cut], most, rng)]
        return node

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their shards; a row near a boundary has several."""
        rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        if not self.vantage:
            return rows, nodes
        vantage, cut = np.array(self.vantage, np.uint64), np.array(self.cut)
        children = np.array(self.children)
        out = []
        while len(rows):
            d = np.bitwise_count((fps[rows] & self.mask) ^ vantage[nodes]).astype(np.int64)
            inner, outer = d <= cut[nodes] + self.radius, d > cut[nodes]
            rows, nodes = np.r_[rows[inner], rows[outer]], np.r_[children[nodes[inner], 0], children[nodes[outer], 1]]
            leaf = nodes < 0
            out.append((rows[leaf], -1 - nodes[leaf]))
            rows, nodes = rows[~leaf], nodes[~leaf]
        return tuple(np.concatenate(x) for x in zip(*out))


def _best_split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """Vantage point and cut with the least expected work, or None if nothing separates the points."""
    best, n = None, len(points)
    for v in points[rng.integers(0, n, 8)]:
        d = np.bitwise_count(points ^ v).astype(np.int64)
        counts = np.bincount(d, minlength=BITS + 1)
        within = np.cumsum(counts)
        for cut in np.unique(np.clip(np.searchsorted(within, n // 2) + np.array([-1, 0, 1]), 0, BITS - 1)):
            inner, outer = int(within[min(BITS, cut + radius)]), int(n - within[cut])
            work = inner * inner + outer * outer
            if outer and work < 0.8 * n * n and (best is None or work < best[0]):
                best = work, int(v), int(cut)
    return best and best[1:]


def _near_values(values: np.ndarray, mask: int, radius: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of the sorted, distinct values of a block that differ by at most ``radius`` bits; some come twice.

    Few flips of bits are looked up; more are searched by a vantage-point tree.
    """
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    if sum(comb(len(bits), k) for k in range(1, radius + 1)) <= MAX_FLIPS:
        for flip in (np.uint64(sum(some)) for k in range(1, radius + 1) for some in combinations(bits, k)):
            up = np.flatnonzero(values ^ flip > values)
            wanted = values[up] ^ flip
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            hit = values[at] == wanted
            yield up[hit], at[hit]
        return
    stack = [np.arange(len(values))]
    while stack:
        part = stack.pop()
        split = None
        if len(part) > LEAF:
            split = _best_split(values[part if len(part) <= SPLIT_SAMPLE else part[rng.integers(0, len(part), SPLIT_SAMPLE)]], radius, rng)
        if split is None:
            for at in range(0, len(part), 32):
                for to in range(at, len(part), 4096):
                    i, j = np.nonzero(np.bitwise_count(values[part[at : at + 32], None] ^ values[None, part[to : to + 4096]]) <= radius)
                    fresh = at + i < to + j
                    yield part[at + i[fresh]], part[to + j[fresh]]
            continue
        d = np.bitwise_count(values[part] ^ np.uint64(split[0])).astype(np.int64)
        stack += [part[d <= split[1] + radius], part[d > split[1]]]


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Link ``i`` and ``j`` pair by pair; ``root`` holds the least place of each one's component, before and after."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root[:] = up


def local_components(points: np.ndarray, mask: int, radius: int, distance: int, rng: np.random.Generator) -> np.ndarray:
    """For each of ``points``, sorted by their block, the first one it is linked to through those within ``distance``.

    Only points whose blocks differ by at most ``radius`` are compared, and of large
    groups only those that are not linked yet.
    """
    block = points & np.uint64(mask)
    value_starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[value_starts, len(points)])
    cuts = -(-sizes // GROUP)
    first = np.cumsum(cuts) - cuts
    starts = np.repeat(value_starts - first * GROUP, cuts) + np.arange(cuts.sum()) * GROUP
    ends = np.minimum(starts + GROUP, np.repeat(value_starts + sizes, cuts))
    counts = ends - starts
    root = np.arange(len(points))

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        if len(i) and len(j):
            near = np.bitwise_count(points[i, None] ^ points[None, j]) <= distance
            a, b = np.nonzero(near)
            _join(root, i[a], j[b])

    own = np.arange(len(value_starts))
    several = own[sizes > 1]
    for p, q in chain([(several, several)], _near_values(block[value_starts], mask, radius, rng)):
        for at in range(0, len(p), MAX_PAIRS):
            x, y = _crossed(first[p[at : at + MAX_PAIRS]], cuts[p[at : at + MAX_PAIRS]], first[q[at : at + MAX_PAIRS]], cuts[q[at : at + MAX_PAIRS]])
            work = counts[x] * counts[y]
            large = work > 4096
            for a, b in zip(x[large].tolist(), y[large].tolist()):
                i, j = np.arange(starts[a], ends[a]), np.arange(starts[b], ends[b])
                linked, number = np.unique(root[j], return_counts=True)
                main = linked[number.argmax()]
                inside = root[i] == main
                others = j[root[j] != main]
                compare(i[~inside], j)
                compare(i[inside], others)
            x, y, work = x[~large], y[~large], work[~large]
            share = (np.cumsum(work) - work) // MAX_PAIRS
            for some in np.split(np.arange(len(x)), np.flatnonzero(share[1:] != share[:-1]) + 1):
                i, j = _crossed(starts[x[some]], counts[x[some]], starts[y[some]], counts[y[some]])
                near = np.bitwise_count(points[i] ^ points[j]) <= distance
                _join(root, i[near], j[near])
    return root


def _crossed(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the ``n`` numbers from ``a`` with each of the ``m`` numbers from ``b``, for all places of the arrays."""
    size = n * m
    place = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    i, j = np.divmod(at, m[place])
    return a[place] + i, b[place] + j


def links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints within ``distance``.

    ``fps`` has distinct values in ``fp``. Trees are grown over a bounded sample
    and deal every fingerprint to its shard and to those beyond a boundary that its
    search radius crosses inwards. A shard is searched by one task and gives a star
    for each of its components, never all pairs.
    """
    fps = kept(fps.select("fp"), "fingerprints")
    n = fps.count()
    masks = blocks_of(distance)
    radius = distance // len(masks)
    sample = np.array([r[0] for r in bounded_sample(fps, SAMPLE, "fp").collect()], np.int64).view(np.uint64)
    most = max(SHARD_SAMPLE, SHARD_SIZE * len(sample) / max(1, n))
    rng = np.random.default_rng(7)
    forest = []
    for mask in masks:
        tree = Tree(mask, radius)
        tree.grow(sample, most, rng)
        forest.append(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_numpy()
            for i, tree in enumerate(forest):
                for at in range(0, len(raw), 50_000):
                    part = raw[at : at + 50_000]
                    rows, shards = tree.route(part.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(shards * len(forest) + i), pa.array(part[rows])], names=["shard", "fp"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for shard, fp in _groups(batches):
            if len(fp) > 1:
                tree = forest[shard % len(forest)]
                fp = fp[np.argsort(fp.view(np.uint64) & tree.mask)]
                root = local_components(fp.view(np.uint64), int(tree.mask), tree.radius, distance, rng)
                least = fp.copy()
                np.minimum.at(least, root, fp)
                far = np.flatnonzero(least[root] != fp)
                yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(least[root[far]])], names=["a", "b"])

    spread = fps.repartition(-(-n // DEALT)) if n > DEALT else fps
    dealt = spread.mapInArrow(lean(deal), "shard bigint, fp bigint")
    tasks = min(2000, sum(tree.shards for tree in forest))
    return dealt.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(lean(match), "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Shards of a task, one after the other, from rows sorted by shard."""
    held: list[np.ndarray] = []
    current = None
    for batch in batches:
        key, fp = (batch.column(i).to_numpy() for i in range(2))
        if not len(key):
            continue
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if held and key[a] != current:
                yield current, np.concatenate(held)
                held = []
            current = key[a]
            held.append(fp[a:b])
    if held:
        yield current, np.concatenate(held)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row; the component is named by its smallest doc_id.

    Fingerprints at ``distance`` or fewer differing bits are linked. Null and
    wordless texts have fingerprint 0 and are linked like any other; repeated
    rows stay and share a component; a null doc_id names no component unless
    nothing else does. An empty table gives no rows.
    """
    rows = kept(fingerprints(documents, doc_id, text), "rows")
    each = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "each")
    roots = connected_components(links(each, distance))
    placed = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """``documents`` with one of each group of near-duplicates: that with the smallest id.

    Groups are the components of :func:`near_duplicates`, so wordless texts are
    one group. A null id stays only where its group has no other; of rows alike
    in id the one whose text has the smallest hash stays, once. Columns are
    those of ``documents``.
    """
    names = documents.columns
    private = [f"_{i}" for i in range(len(names))]
    plain = documents.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, private)])
    key, content = F.col(private[names.index(doc_id)]), F.col(private[names.index(text)])
    hashed = plain.select(F.struct(F.isnull(key).alias("nameless"), key.alias("id"), F.xxhash64(content).alias("hash")).alias("row"), content.alias("content"))
    found = kept(near_duplicates(hashed, "row", "content", distance), "groups")
    chosen = found.select(F.col("component_id").alias("row")).distinct().select(F.col("row.id").alias("id"), F.col("row.hash").alias("hash"))
    joined = plain.withColumn("hash", F.xxhash64(content)).join(chosen.withColumnRenamed("hash", "h"), key.eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")))
    once = Window.partitionBy(key, "hash").orderBy(F.lit(0))
    single = joined.withColumn("n", F.row_number().over(once)).filter("n = 1")
    return single.select(*[F.col(p).alias(c) for c, p in zip(names, private)])


def hex_digits(fp) -> Column:
    """The 16 lower-case hex digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
