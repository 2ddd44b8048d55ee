"""Arrow batches in parts, so that what Python makes of one follows the part and not the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and rows of a part; a longer text is a part of its own.
PART_BYTES = 1 << 19
PART_ROWS = 512


def parts(texts: pa.Array, most: int = PART_BYTES, rows: int = PART_ROWS) -> Iterator[pa.Array]:
    """An array of texts or bytes in slices of at most ``rows`` rows and about ``most`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(start + 1, min(stop, start + rows))
        yield texts.slice(start, stop - start)
        start = stop
