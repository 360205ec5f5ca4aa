"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def groups(batch: pa.RecordBatch, most: int = 4_000_000, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with not many more than so many bytes of text each, to bound what Python holds."""
    texts = batch.column(column)
    at, held = 0, 0
    for i in range(len(texts)):
        held += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if held >= most:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < len(texts):
        yield batch.slice(at)
    pa.default_memory_pool().release_unused()  # workers are kept, and so is what they don't give back
