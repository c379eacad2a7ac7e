"""Whole-batch views of Arrow text columns as bytes, for numpy kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(batch: pa.RecordBatch, column: str, limit: int = 500_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least).

    Yields (rows, bytes, offsets): row i's text is ``bytes[offsets[i]:offsets[i + 1]]``; a null text is empty.
    """
    texts = batch.column(column).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def clean(texts: pa.Array) -> list[str]:
    return ["" if t is None else t for t in texts.to_pylist()]


def runs(batch: pa.RecordBatch, column: str, limit: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows as in ``slices``, with their texts as strings (null: empty)."""
    for rows, _, _ in slices(batch, column, limit):
        yield rows, clean(rows.column(column))
