"""Array columns of Arrow batches as flat NumPy arrays, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of integer lists, and the row each came from."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of lists from all their elements in a row and the lists' sizes."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
