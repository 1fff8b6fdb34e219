"""Vectors of an Arrow batch as whole numbers in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_ENTRIES = 1 << 21


def usable(column: pa.Array, scale: float, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, floor(scale * entry) of those rows as int64) by vector length, in slices of bounded size.

    Null and empty vectors, and those with an entry that is null, not finite or `most` or more in size once
    scaled, are left out.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # entries of null vectors are not in it
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        step = max(1, SLICE_ENTRIES // int(length))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            places = (starts[part][:, None] + np.arange(length)).ravel()
            whole = flat.slice(int(places[0]), int(places[-1] - places[0]) + 1)  # nulls become NaN
            entries = whole.cast(pa.float64()).to_numpy(zero_copy_only=False)[places - places[0]].reshape(len(part), length)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(entries * scale)
                fine = (np.abs(scaled) < most).all(axis=1)
            yield part[fine], scaled[fine].astype(np.int64)
