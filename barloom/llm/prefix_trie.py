"""The trie of conversation prefixes: balanced parentheses per shard, shared spines merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import by_pieces, input_columns
from barloom.session import kept

#: Turns of different sequences that a shard holds on average.
SHARD_TURNS = 100_000
#: Fan-out of the tree of excess minima.
FAN = 64
#: Member ids that are joined to one string before the strings of a sequence meet.
JOINED_IDS = 4096
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- balanced parentheses ---------------------------------------------------------


class Parentheses:
    """Balanced parentheses with a tree of the least excess in blocks, then in blocks of blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.size = len(opens)
        excess = np.cumsum(np.where(opens, 1, -1), dtype=np.int64)
        #: Level 0 is the excess itself; each further level has the minima of FAN entries below.
        self.levels = [self._padded(excess)]
        while len(self.levels[-1]) > FAN:
            self.levels.append(self._padded(self.levels[-1].reshape(-1, FAN).min(axis=1)))
        self.rank = np.cumsum(opens, dtype=np.int64)
        leaf = np.zeros(self.size, bool)
        leaf[:-1] = opens[:-1] & ~opens[1:]
        self.leaf = leaf

    @staticmethod
    def _padded(values: np.ndarray) -> np.ndarray:
        return np.concatenate([values, np.full(-len(values) % FAN, np.iinfo(np.int64).max)])

    def excess(self, at: np.ndarray) -> np.ndarray:
        return self.levels[0][at]

    def findclose(self, opened: np.ndarray, step: int = 65_536) -> np.ndarray:
        """Where each open parenthesis is closed: the first later place of a lower excess."""
        parts = [self._first_below(opened[i : i + step]) for i in range(0, len(opened), step)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def _first_below(self, opened: np.ndarray) -> np.ndarray:
        least = self.excess(opened) - 1
        found = np.full(len(opened), -1, np.int64)
        todo, at, level = np.arange(len(opened)), opened + 1, 0
        hits: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(todo):
            inside = at // FAN * FAN < len(self.levels[level])
            todo, at = todo[inside], at[inside]
            hit, place = self._in_block(level, at, least[todo])
            hits.append((level, todo[hit], place[hit]))
            todo, at, level = todo[~hit], at[~hit] // FAN + 1, level + 1
            if level == len(self.levels):
                break
        for level, who, place in reversed(hits):
            for below in range(level - 1, -1, -1):
                _, place = self._in_block(below, place * FAN, least[who])
            found[who] = place
        return found

    def _in_block(self, level: int, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first entry of a block, from ``at`` on, that is not above ``least``."""
        rows = self.levels[level].reshape(-1, FAN)[at // FAN]
        good = (rows <= least[:, None]) & (np.arange(FAN) >= (at % FAN)[:, None])
        return good.any(axis=1), at // FAN * FAN + good.argmax(axis=1)


def _range_minimum(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of each range that is not empty."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.frexp((end - begin).astype(float))[1] - 1
    out = np.empty(len(begin), values.dtype)
    for i, row in enumerate(table):
        mine = np.flatnonzero(level == i)
        out[mine] = np.minimum(row[begin[mine]], row[end[mine] - (1 << i)])
    return out


# --- one shard --------------------------------------------------------------------

_NODE = "id binary, parent_id binary, conv_id bigint, parent_conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NODE_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _path_ids(keys: list[bytes], depth: int) -> list[bytes]:
    """Ids of the first ``depth`` nodes below the root on a path, and the root's."""
    ids = [bytes(16)]
    for key in keys[:depth]:
        ids.append(xxhash.xxh3_128_digest(ids[-1] + key))
    return ids


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def shard_nodes(keys: list[list[bytes]], words: list[list[int]], members: np.ndarray, conv: np.ndarray, ends: list[str], before: int, after: int) -> pa.RecordBatch:
    """The nodes of a shard's sequences, which are sorted and different.

    ``before`` and ``after`` are the turns that the first sequence shares with the
    last one of the shard before, and the last with the first one of the shard
    behind; -1 where there is none. Nodes up to those depths lie on the shared
    spines: they carry an id, and what they count is the shard's own part, in
    which a turn or child that the shard before has as well does not count again.
    """
    n_seq = len(keys)
    size = np.fromiter(map(len, keys), np.int64, n_seq)
    shared = np.zeros(n_seq, np.int64)
    for i in range(1, n_seq):
        shared[i] = _common(keys[i - 1], keys[i])
    opened = size - shared
    # the root, then for each sequence what it closes and what it opens
    runs = np.empty(2 * n_seq + 2, np.int64)
    runs[0], runs[1:-1:2], runs[2:-1:2] = 1, np.r_[0, size[:-1] - shared[1:]], opened
    runs[-1] = size[-1] + 1
    kinds = np.ones(len(runs), bool)
    kinds[1:-1:2] = False
    kinds[-1] = False
    tree = Parentheses(np.repeat(kinds, runs))

    at = np.flatnonzero(tree.opens)
    close = tree.findclose(at)
    n = len(at)
    depth = tree.excess(at) - 1
    end = tree.rank[close]
    end_node = np.cumsum(opened)
    # the node before a new one is its parent, but for the first of a sequence
    parent = np.arange(-1, n - 1)
    path = [0]
    for i, (lead, first, last) in enumerate(zip(shared.tolist(), (end_node - opened + 1).tolist(), (end_node + 1).tolist())):
        if first < last:
            parent[first] = path[lead]
            path[lead + 1 :] = range(first, last)
    spine = np.zeros(n, bool)
    spine[: before + 1] = True
    spine[path[: after + 1]] = True
    fresh = np.ones(n, bool)
    fresh[: before + 1] = False

    def below(per_node: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(per_node)]
        return total[end] - total[: len(end)]

    ended = np.zeros(n, np.int64)
    ended[end_node] = members
    n_convs = below(ended)
    turn_words = np.zeros(n, np.int64)
    if n > 1:
        turn_words[1:] = np.concatenate([np.asarray(w[lead:], np.int64) for w, lead in zip(words, shared.tolist())])
    saved = below(n_convs * turn_words) - below(np.where(fresh, turn_words, 0))
    leaves = tree.leaf
    if after == size[-1]:
        # the shard behind goes on where the last sequence ends
        leaves = leaves.copy()
        leaves[at[end_node[-1]]] = False
    leaf_rank = np.r_[0, np.cumsum(leaves, dtype=np.int64)]
    n_leaves = leaf_rank[close + 1] - leaf_rank[at]
    new_child = fresh.copy()
    new_child[0] = False
    n_children = np.bincount(parent[new_child], minlength=n)
    nodes = np.arange(n)
    smallest = _range_minimum(conv, np.searchsorted(end_node, nodes), np.searchsorted(end_node, end))

    ids: list[bytes | None] = [None] * n
    for node, x in zip(range(before + 1), _path_ids(keys[0], before)):
        ids[node] = x
    for node, x in zip(path[: after + 1], _path_ids(keys[-1], max(after, 0))):
        ids[node] = x
    above = parent.clip(0)
    over_spine = spine[above]
    over_spine[0] = False
    parent_conv = pa.array(smallest[above], mask=over_spine | (nodes == 0))
    parent_ids = pa.array([ids[p] if s else None for p, s in zip(above.tolist(), over_spine.tolist())], pa.binary())
    hashes: list[str | None] = [None] * n
    for node, text in zip(end_node.tolist(), ends):
        hashes[node] = text
    columns = [pa.array(ids, pa.binary()), parent_ids, pa.array(smallest), parent_conv, *map(pa.array, (depth, n_convs, n_children, n_leaves, saved)), pa.array(hashes, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=_NODE_NAMES)


# --- Spark ------------------------------------------------------------------------


def turn_lists(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turns)``: the turns of each conversation in order, as a digest and a number of words.

    A turn's digest has 128 bits of its role and whole text, so texts stay where
    they are read. Null roles and texts count as empty, turns without a number
    come first, turns of one number in the order of their digests; repeated rows
    are turns like others. Rows without a conversation id take no part.
    """
    rows = input_columns(conversations, conv=conv_id, turn=turn, role=role, text=text).filter("conv IS NOT NULL")
    kind = rows.schema["turn"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, 3):
            keys, words = [], []
            for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                said_by, said = (r or "").encode(), (t or "").encode()
                keys.append(xxhash.xxh3_128_digest(len(said_by).to_bytes(8, "little") + said_by + said))
                words.append(len(said.split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(words, pa.int64())], names=["conv", "turn", "key", "words"])

    digests = rows.select(F.col("conv").cast("bigint").alias("conv"), "turn", "role", "text").mapInArrow(run, f"conv bigint, turn {kind}, key binary, words bigint")
    place = F.struct(F.isnotnull("turn").alias("numbered"), "turn", "key", "words")
    listed = digests.groupBy("conv").agg(F.array_sort(F.collect_list(place)).alias("turns"))
    return listed.select("conv", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def with_shared_lead(lists: DataFrame, block: int = 20, longest: int = 4) -> DataFrame:
    """Conversations that begin with turns of the first conversation of their block of ids.

    The number of taken turns is the crc32 of the id, modulo ``longest``; they
    replace as many turns of the conversation's own.
    """
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % longest).cast("int")
    heads = lists.filter(F.col("conv") % block == 0).select(F.col("conv").alias("head"), F.slice("turns", 1, longest - 1).alias("lead"))
    joined = lists.withColumn("head", F.col("conv") - F.col("conv") % block).withColumn("taken", taken).join(heads, "head", "left")
    lead = F.when(F.col("lead").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("lead", F.lit(1), F.col("taken")))
    own = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))
    return joined.select("conv", F.concat(lead, own).alias("turns"))


_ID = ["k0", "k1"]


def _end_hashes(members: DataFrame) -> DataFrame:
    """``(k0, k1, ends)``: SHA-256 of the member ids of each sequence, ascending and joined by commas.

    The ids are sorted over the whole cluster and joined in runs; the task of a
    sequence then only streams through its strings.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list[str] = []
        for batch in batches:
            out = []
            for k0, k1, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and ((k0, k1) != held[:2] or len(ids) == JOINED_IDS):
                    out.append((*held, ",".join(ids)))
                    held = None
                if held is None:
                    held, ids = (k0, k1, conv), []
                ids.append(str(conv))
            yield _rows(out)
        if held is not None:
            yield _rows([(*held, ",".join(ids))])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["k0", "k1", "conv", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for k0, k1, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (k0, k1) == held:
                    state.update(b",")
                else:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = (k0, k1), hashlib.sha256()
                state.update(ids.encode())
            yield _ends(out)
        if held is not None:
            yield _ends([(*held, state.hexdigest())])

    def _ends(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k0", "k1", "ends"])

    ranged = members.select(*_ID, "conv").repartitionByRange(*_ID, "conv").sortWithinPartitions(*_ID, "conv")
    strings = ranged.mapInArrow(joined, "k0 bigint, k1 bigint, conv bigint, ids string")
    return strings.repartition(*_ID).sortWithinPartitions(*_ID, "conv").select(*_ID, "ids").mapInArrow(hashed, "k0 bigint, k1 bigint, ends string")


def _shared_turns(a: Column, b: Column) -> Column:
    """Length of the common beginning of two different arrays."""
    return (F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1).cast("int")


def _edges(sequences: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard the turns shared with the one before and the one behind, -1 without one."""
    bounds = kept(sequences.groupBy("shard").agg(F.min("keys").alias("first"), F.max("keys").alias("last")), "bounds")
    present = sorted(r.shard for r in bounds.select("shard").collect())
    follow = sequences.sparkSession.createDataFrame(list(zip(present, present[1:])), "shard int, behind int")
    behind = bounds.select(F.col("shard").alias("behind"), F.col("first").alias("next_first"))
    met = bounds.join(follow, "shard").join(behind, "behind").select("shard", "behind", _shared_turns(F.col("last"), F.col("next_first")).alias("both"))
    out = {s: [-1, -1] for s in present}
    for r in met.collect():
        out[r.shard][1] = out[r.behind][0] = r.both
    return {s: tuple(x) for s, x in out.items()}


def _encoded(sequences: DataFrame, shards: int) -> DataFrame:
    edges = _edges(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def nodes() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            keys, words, ends = (table[c].to_pylist() for c in ("keys", "words", "ends"))
            members, conv = (table[c].to_numpy() for c in ("members", "conv"))
            return shard_nodes(keys, words, members, conv, ends, *edges[table["shard"][0].as_py()])

        for batch in batches:
            shard = batch.column(0).to_numpy()
            for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)])):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != shard[a]:
                    yield nodes()
                    held.clear()
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield nodes()

    ordered = sequences.repartition(shards, "shard").sortWithinPartitions("shard", "keys")
    return ordered.select("shard", "keys", "words", "members", "conv", "ends").mapInArrow(run, _NODE)


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per different beginning of the conversations ``(conv, turns)``, the empty one included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (words that a
    store of the trie has once, summed over the subtree) and ``ends_sha256`` (of
    the ids of the conversations that end there).

    Copies of a conversation are counted first and go on as one sequence. The
    sequences are sorted over the cluster and cut into shards; a shard writes its
    part of the trie as balanced parentheses and reads subtrees off them. Only
    the beginnings that run across a cut occur in several shards: those spines
    are merged by their ids, and every count is a sum of the shards' own parts.

    A conversation without turns ends at the root. No conversations, no rows.
    Very long conversations: a conversation's digests, 24 bytes a turn, are one
    row and must fit in a task; copies, hot beginnings and the number of
    conversations are not bounded.
    """
    keys = F.col("turns.key")
    members = kept(lists.select("conv", "turns", F.xxhash64(F.lit(0), keys).alias("k0"), F.xxhash64(F.lit(1), keys).alias("k1")), "members")
    once = members.groupBy(*_ID).agg(F.count("*").alias("members"), F.min("conv").alias("conv"), F.min_by("turns", "conv").alias("turns"))
    ended = kept(once.join(_end_hashes(members), _ID).select(F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"), "members", "conv", "ends"), "sequences")
    total = ended.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    shards = int(total // shard_turns) + 1
    sequences = kept(ended.repartitionByRange(shards, "keys").withColumn("shard", F.spark_partition_id()), "shards")
    nodes = kept(_encoded(sequences, shards), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = nodes.filter("id IS NOT NULL").groupBy("id").agg(F.max("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    spine = kept(spine, "spine")
    inner = nodes.filter("id IS NULL")
    rows = inner.filter("parent_id IS NOT NULL").drop("id", "parent_conv_id").unionByName(spine.drop("id"))
    above = spine.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    whole = inner.filter("parent_id IS NULL").unionByName(rows.join(above, "parent_id", "left").withColumn("id", F.lit(None).cast("binary")))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
