"""Batches of texts cut into runs that a task can hold beside its other work.

Python objects made of a text take many times its bytes, and a batch may hold ten thousand long
texts.  Column functions therefore work through a batch run by run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text in one run, unless a single text has more.
RUN_BYTES = 1 << 20


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[pa.Array]:
    """The texts in order, as slices of at most ``limit`` bytes or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    row = 0
    while row < len(texts):
        before = int(ends[row - 1]) if row else 0
        last = max(int(np.searchsorted(ends, before + limit, "right")), row + 1)
        yield texts.slice(row, last - row)
        row = last


def by_runs(
    texts: pa.Array, arrow_type: pa.DataType, each: Callable[[list], list], limit: int = RUN_BYTES
) -> pa.Array:
    """``each`` over the texts of every run, as one array."""
    made = [pa.array(each(run.to_pylist()), arrow_type) for run in runs(texts, limit)]
    return pa.concat_arrays(made) if made else pa.array([], arrow_type)
