"""Arrays of numbers as short bytes: planes of their bytes, compressed; of whole numbers, the
differences. Sorted keys take a few bytes each, where rows of Spark take a dozen."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<BBI")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of int64, float32 or float64."""
    heads, planes = [], []
    for a in arrays:
        real = a.dtype.kind == "f"
        if real:
            width, cells = a.itemsize, np.ascontiguousarray(a)
        else:
            step = np.diff(a.astype(np.int64), prepend=np.int64(0))
            cells = ((step << 1) ^ (step >> 63)).view(np.uint64)
            width = (int(cells.max(initial=0)).bit_length() + 7) // 8
        heads.append(_HEAD.pack(real, width, len(a)))
        planes.append(cells.view(np.uint8).reshape(len(a), cells.itemsize)[:, :width].T.tobytes())
    body = b"".join(planes)
    return bytes([len(arrays)]) + b"".join(heads) + (pa.Codec("zstd", compression_level=1).compress(body, asbytes=True) if body else b"")


def unpacked(blob: bytes) -> list[np.ndarray]:
    count = blob[0]
    heads = [_HEAD.unpack_from(blob, 1 + _HEAD.size * k) for k in range(count)]
    size = sum(width * n for _, width, n in heads)
    body = pa.Codec("zstd").decompress(blob[1 + _HEAD.size * count :], size, asbytes=True) if size else b""
    out, at = [], 0
    for real, width, n in heads:
        planes = np.frombuffer(body, np.uint8, width * n, at).reshape(width, n)
        at += width * n
        if real:
            out.append(np.ascontiguousarray(planes.T).view(np.float32 if width == 4 else np.float64).ravel())
            continue
        cells = np.zeros((n, 8), np.uint8)
        cells[:, :width] = planes.T
        cells = cells.view(np.uint64).ravel()
        out.append(np.cumsum((cells >> np.uint64(1)).view(np.int64) ^ -(cells & np.uint64(1)).view(np.int64)))
    return out
