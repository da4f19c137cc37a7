"""Arrow text as flat numpy arrays of code points, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(arr) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all rows one after the other, and their n+1 offsets.

    Null rows count as empty. The text buffer is decoded once for the whole batch.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):  # no chunks at all
        arr = pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    offsets = np.zeros(n + 1, np.int64)
    if n == 0:
        return np.zeros(0, np.uint32), offsets
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, off, data = arr.buffers()
    at = np.frombuffer(off, kind)[arr.offset : arr.offset + n + 1]
    raw = b"" if data is None else data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    np.cumsum(pc.utf8_length(arr).to_numpy(zero_copy_only=False), out=offsets[1:])
    return np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def strings(cp: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of flat(): one Arrow string for each offset range, without per-row calls."""
    text = cp.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    ends = at[offsets]
    if ends[-1] < 2**31:
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(text))
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(text))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(starts, counts)


def groups(offsets: np.ndarray, limit: int):
    """Row ranges whose texts together have about `limit` code points; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = max(i + 1, min(n, j))
        yield i, j
        i = j
