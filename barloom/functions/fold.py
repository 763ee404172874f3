"""Ordered fold per key, for decisions that depend on the decisions before them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    outputs: list[T.StructField],
    new_state: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """Stream each key's rows in order through a small step function.

    Spark shuffles by key and sorts inside the partitions; the task then reads
    Arrow batches one after the other and carries only the state of the current
    key, so a key with very many rows never has to fit in memory. ``new_state``
    makes a fresh step for a key; the step gets the ``inputs`` of a row and
    returns the ``outputs`` to append.
    """
    schema = T.StructType([*rows.schema.fields, *outputs])
    names = [f.name for f in outputs]
    key_names, input_names = list(keys), list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for batch in batches:
            made = []
            key_rows = zip(*[batch[k] for k in key_names])
            for key, values in zip(key_rows, zip(*[batch[c] for c in input_names])):
                if key != current:
                    current, step = key, new_state()
                made.append(step(*values))
            extra = pd.DataFrame(made, columns=names, index=batch.index)
            yield pd.concat([batch, extra], axis=1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
