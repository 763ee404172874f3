"""Arrow helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task works on about this many characters of text at a time, however many rows Arrow delivers.
CHUNK_CHARS = 1_000_000


def chunks(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` units each; a larger row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def by_pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text each.

    Only so much text is turned into Python strings at a time; a longer text
    stands alone.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in chunks(size, limit):
            yield batch.slice(a, b - a)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which at the end of a task gives the memory it used back to the system.

    Workers live on from task to task, and an executor keeps more of them than it
    has cores; what each has freed but still holds would add up.
    """

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return trimmed


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def input_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names.

    Extra columns of the caller never reach an operator's internal joins, so
    their names cannot clash.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


#: Into how many equal parts hashes are cut where a share of them is drawn.
SHARES = 1 << 30


def bounded_sample(rows: DataFrame, size: int, *by: str, alike: bool = True) -> DataFrame:
    """At most ``size`` rows, chosen by the hash of ``by``.

    The rows are counted first, and a share of about twice the size is kept where
    they lie, so that what meets in one place does not grow with the table. With
    ``alike`` rows of one hash stay or go together; without, each is drawn on its
    own, so that copies make up the share of the sample that they have in the
    table. ``rows`` must then be a written table, whose rows keep their places.
    """
    total = rows.count()
    own = [] if alike else [F.monotonically_increasing_id()]
    number = F.xxhash64(F.lit(71), *by, *own)
    if total > size:
        rows = rows.filter(F.pmod(number, F.lit(SHARES)) < F.lit(int(SHARES * min(1.0, 2 * size / total))))
    return rows.orderBy(number, *by).limit(size)
