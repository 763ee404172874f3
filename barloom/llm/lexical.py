"""Ranked lexical search: an Aho-Corasick automaton of all query terms scans the documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barloom.llm.batches import by_pieces, input_columns
from barloom.session import kept

TOP = 50
#: Items and item characters of one automaton; more items take further scans of the documents.
MAX_ITEMS, MAX_ITEM_CHARS = 20_000, 1_000_000
#: Cells (documents x items) and term-item pairs that a task scores at a time.
CELLS = 2_000_000
#: Candidates a task holds before it cuts them back to the best of each item.
HELD = 200_000
#: Longest term in bytes that the automaton holds; longer ones are looked up whole, as its depth is theirs.
LONG_TERM = 1000
#: First-level groups of an item's candidates, so that no task sorts those of all tasks.
GROUPS = 64

#: A-Z to lower case, every byte that belongs to no term to a space.
_NORMAL = bytes(32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class Queries:
    """Items, their different terms, and which items each term belongs to."""

    def __init__(self, items: list[tuple[object, str | None]]):
        wanted: dict[object, set[bytes]] = {}
        for item, text in items:
            wanted.setdefault(item, set()).update(terms_of(text))
        self.items = list(wanted)
        self.terms = sorted(set().union(*wanted.values()))
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], i) for i, item in enumerate(self.items) for t in wanted[item])
        self.item_of = np.array([i for _, i in pairs], np.int64)
        self.degree = np.bincount([t for t, _ in pairs], minlength=len(self.terms)).astype(np.int64)
        self.begin = np.cumsum(self.degree) - self.degree
        self.long = {t: i for i, t in enumerate(self.terms) if len(t) > LONG_TERM}

    def automaton(self):
        """Terms between spaces, over the bytes of the text; the value of a word is its number."""
        words = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.terms):
            if t not in self.long:
                words.add_word(f" {t.decode('latin-1')} ", i)
        if len(words):
            words.make_automaton()
        return words


def _counted(documents: DataFrame, queries: Queries) -> DataFrame:
    """``(doc, n, terms, tfs)``: a document's terms, and how often each query term occurs in it."""
    shared = documents.sparkSession.sparkContext.broadcast((queries.automaton(), queries.long)) if queries.terms else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itemgetter(1)
        for batch in by_pieces(batches, 1):
            totals, sizes, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode().translate(_NORMAL)
                words = raw.split()
                totals.append(len(words))
                if shared is not None:
                    automaton, long = shared.value
                    found = np.fromiter(map(number, automaton.iter(f" {raw.decode('latin-1')} ")), np.int32) if len(automaton) else np.empty(0, np.int32)
                    if long:
                        found = np.r_[found, [long[w] for w in words if len(w) > LONG_TERM and w in long]].astype(np.int32)
                    ids, tf = np.unique(found, return_counts=True)
                    terms.append(ids)
                    tfs.append(tf)
                sizes.append(sizes[-1] + (len(terms[-1]) if terms else 0))
            offsets = pa.array(sizes, pa.int32())
            flat = [pa.array(np.concatenate(c) if c else np.empty(0), kind) for c, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            lists = [pa.ListArray.from_arrays(offsets, c) for c in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    return documents.mapInArrow(run, f"doc {documents.schema['doc'].dataType.simpleString()}, n bigint, terms array<int>, tfs array<bigint>")


def _statistics(counted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents of each query term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 2, np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            sums[size:] += (np.count_nonzero(n), n.sum())
            sums[:size] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "x"])

    parts = counted.select("n", "terms").mapInArrow(run, "at bigint, x bigint").groupBy("at").agg(F.sum("x").alias("x"))
    sums = np.zeros(size + 2, np.int64)
    for r in parts.collect():
        sums[r["at"]] = r["x"]
    return int(sums[size]), int(sums[size + 1]), sums[:size]


def _scored(counted: DataFrame, queries: Queries, weights: np.ndarray, documents: int, length: int, k: int, item_type: T.DataType) -> DataFrame:
    """``(item_id, doc, score)``: the best ``k`` documents of each item within each task."""
    n_items = len(queries.items)
    doc_type = counted.schema["doc"].dataType
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc", doc_type), T.StructField("score", T.LongType())])

    def cut_back(held: list[pa.Table], floor: np.ndarray) -> pa.Table:
        """The best of each item, ties to the smaller document; ``floor`` rises to what they ask for."""
        table = pa.concat_tables(held)
        table = table.take(pc.sort_indices(table, [("item", "ascending"), ("score", "descending"), ("doc", "ascending")]))
        item = table["item"].to_numpy()
        first = np.searchsorted(item, np.arange(n_items))
        rank = np.arange(len(item)) - first[item]
        last = np.flatnonzero(rank == k - 1)
        floor[item[last]] = table["score"].to_numpy()[last]
        return table.filter(pa.array(rank < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not n_items:
            return
        held: list[pa.Table] = []
        floor = np.ones(n_items, np.int64)
        waiting, arrow_doc = 0, None
        for batch in batches:
            arrow_doc = batch.column(0).type
            size = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            terms, tfs = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            m = 50 + (50 * batch.column(1).to_numpy() * documents) // max(length, 1)
            doc_of = np.repeat(np.arange(len(size)), size)
            value = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc_of]))
            ends = np.cumsum(size)
            load = np.bincount(doc_of, weights=queries.degree[terms], minlength=len(size)) + n_items
            groups = (np.cumsum(load) // CELLS).astype(np.int64)
            for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.r_[0, np.flatnonzero(np.diff(groups)) + 1, len(groups)])):
                lo, hi = ends[a] - size[a], ends[b - 1]
                times = queries.degree[terms[lo:hi]]
                inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                item = queries.item_of[np.repeat(queries.begin[terms[lo:hi]], times) + inner]
                scores = np.zeros((b - a) * n_items, np.int64)
                np.add.at(scores, np.repeat(doc_of[lo:hi] - a, times) * n_items + item, np.repeat(value[lo:hi], times))
                rows, items = np.nonzero(scores.reshape(-1, n_items) >= floor)
                if len(rows):
                    held.append(pa.table({"item": items, "score": scores[rows * n_items + items], "doc": batch.column(0).take(pa.array(rows + a))}))
                    waiting += len(rows)
                if waiting > HELD:
                    held = [cut_back(held, floor)]
                    waiting = 0
        if held:
            best = cut_back(held, floor)
            ids = pa.array([queries.items[i] for i in best["item"].to_pylist()], arrow_item)
            yield from pa.table({"item_id": ids, "doc": best["doc"].cast(arrow_doc), "score": best["score"]}).to_batches()

    arrow_item = to_arrow_type(item_type)
    return counted.mapInArrow(run, schema)


def search(documents: DataFrame, benchmark: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item.

    A term is a run of letters, digits and non-ASCII signs, with A-Z in lower
    case. A document scores, for each different term of the item, the term's
    weight times its saturated frequency, in whole numbers; documents that score
    0 are left out. There is no index: an automaton of all terms, each guarded by
    spaces, reads every whole text once, and its outputs are dealt to the items
    of the term. Each task keeps its own best ``k`` of an item, which are merged
    in two levels. Items beyond the stated sizes take further automata and scans.

    Null, empty and term-free texts score nothing, nor do such items, and do not
    count as documents; very long texts are scanned like others. Rows of one item
    id count as one item with the terms of all; each document row counts, also
    where ids or texts repeat. Ties go to the smaller id, null ids last. Empty
    tables give no rows. Other columns are not looked at.
    """
    docs = input_columns(documents, doc=doc_id, text=text)
    items = input_columns(benchmark, item=item_id, text=item_text)
    chars, rows = items.agg(F.sum(F.length("text")), F.count("*")).first()
    parts = max(int(chars or 0) // MAX_ITEM_CHARS, rows // MAX_ITEMS) + 1
    out = None
    for part in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        queries = Queries([tuple(r) for r in own.collect()])
        counted = kept(_counted(docs, queries), "terms")
        n_docs, length, df = _statistics(counted, len(queries.terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        best = _scored(counted, queries, weights, n_docs, length, k, items.schema["item"].dataType)
        out = best if out is None else out.unionByName(best)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    grouped = out.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    first = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "group").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(F.col("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
