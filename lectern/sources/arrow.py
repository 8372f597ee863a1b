"""Arrow batches in small slices, so that what Python makes of them stays small."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `most` bytes; an empty batch has none."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, lengths) of a column of lists; a missing list is empty."""
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths, lengths
