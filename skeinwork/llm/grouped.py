"""Whole groups out of batches whose rows lie together by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """``(rows, bounds)``: rows of whole groups only, group k from bounds[k] to bounds[k + 1]. Groups have to be of bounded size."""

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        starts = edges(batch)
        if len(starts) > 1:
            yield batch.slice(0, int(starts[-1])), starts
            batch = batch.slice(int(starts[-1]))
        held = batch
    if held is not None:
        yield held, np.array([0, held.num_rows])
