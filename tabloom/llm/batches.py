"""Arrow batches in and out of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def record_batch(names: str, *columns) -> pa.RecordBatch:
    """Columns under space-separated names."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch_first = [batch.column(k)[0] for k in range(keys)]
            held_last = [held[-1].column(k)[held[-1].num_rows - 1] for k in range(keys)]
            if batch_first != held_last:
                yield pa.Table.from_batches(held)
                held = []
        cut = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in range(keys):
            value = batch.column(k).to_numpy(zero_copy_only=False)
            cut |= value[1:] != value[:-1]
        begin = 0
        for end in (np.flatnonzero(cut) + 1).tolist():
            held.append(batch.slice(begin, end - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], end
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)
