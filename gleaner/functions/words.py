"""Counting words of Arrow batches: token texts are cut up and coded by Arrow, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut up at once; a longer text is a slice of its own.
SLICE_BYTES = 4 * 1024 * 1024


def slices(batch: pa.RecordBatch, text: str, n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take ``n_bytes`` at most."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end, low = np.cumsum(size), 0
    while low < batch.num_rows:
        used = end[low - 1] if low else 0
        high = max(int(np.searchsorted(end, used + n_bytes, side="right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def coded(norm: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and word number of each occurrence, and the words, of texts made by ``token_text``."""
    cut = pc.split_pattern(norm, " ")
    row, word = pc.list_parent_indices(cut), pc.list_flatten(cut)
    held = pc.not_equal(word, "")  # an empty text is cut into one empty word
    found = word.filter(held).dictionary_encode()
    rows = row.filter(held).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()
