"""Tasks over key-sorted partitions: whole groups, many at a time, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_sorted_runs(
    df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, rows: int = 100_000
) -> DataFrame:
    """Bring equal ``keys`` together and call ``work(table, starts)`` on runs of whole groups of about ``rows`` rows.

    ``starts`` holds the first row of each group in the table. Unlike one call per group, a million small groups cost a
    few vectorised calls. Only one run, plus the group that is still arriving, is held in memory.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def starts_of(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, dtype=bool)
            new[:1] = True
            for k in keys:
                c = table.column(k).combine_chunks()
                c = c.dictionary_encode().indices.fill_null(-1) if not pa.types.is_integer(c.type) else c
                v = c.to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(new)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                table = pa.Table.from_batches(held)
                starts = starts_of(table)
                if len(starts) > 1:
                    last = int(starts[-1])
                    yield from work(table.slice(0, last), starts[:-1])
                    rest = table.slice(last).combine_chunks()
                    held, size = rest.to_batches(), 0  # the open group is not tested again before another run has arrived
                else:
                    size = 0
        if held:
            table = pa.Table.from_batches(held)
            yield from work(table, starts_of(table))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)
