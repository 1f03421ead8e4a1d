"""Runs of equal keys in sorted Arrow batches: groups of any number in one task, one at a time in memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs with the runs' bounds, from batches sorted by ``keys`` (no nulls in them).

    A run that may go on in the next batch is kept back until it is whole, so no group is cut.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        same = bool(kept) and all(kept[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if len(starts) == 1 and (same or not kept):
            kept.append(batch)
            continue
        last = int(starts[-1])
        if not same and kept and len(starts) == 1:
            yield _whole(kept, keys)
            kept = [batch]
            continue
        head = batch.slice(0, last)
        yield _whole([*kept, head], keys)
        kept = [batch.slice(last)]
    if kept:
        yield _whole(kept, keys)


def _starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _whole(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches([b for b in batches if b.num_rows]).combine_chunks()
    return t, np.append(_starts(t, keys), t.num_rows)
