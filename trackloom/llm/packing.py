"""Arrays of numbers as compact bytes, and hash buckets of sorted arrays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np


def deflated(a: np.ndarray) -> bytes:
    """An integer array by byte planes, so that equal high bytes nearly vanish."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def inflated(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def sorted_bytes(a: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences; only the byte planes in use, uncompressed since they are random."""
    if not len(a):
        return b""
    # The first number goes in front, so that it doesn't widen the differences.
    delta = np.diff(a, prepend=a[:1])
    used = (int(delta.max()).bit_length() + 7) // 8
    planes = delta.view(np.uint8).reshape(-1, 8).T[:used]
    return a[:1].tobytes() + bytes([used]) + np.ascontiguousarray(planes).tobytes()


def sorted_numbers(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    used = raw[8]
    delta = np.zeros((n, 8), np.uint8)
    delta[:, :used] = np.frombuffer(raw, np.uint8, offset=9).reshape(used, n).T
    delta = delta.reshape(-1).view(np.uint64)
    delta[0] = np.frombuffer(raw[:8], np.uint64)[0]
    return np.cumsum(delta, dtype=np.uint64)


def bucket_cuts(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit hashes; a bucket is the hash's first ``bits`` bits."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for a, b in zip(first, [*first[1:], len(bucket)], strict=False):
        yield int(bucket[a]), a, b
