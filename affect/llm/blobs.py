"""Numpy arrays of one shuffle record packed into a compressed binary value.

Tens of millions of hashes travel as a few thousand binary columns instead of
as rows of their own: a shuffle then costs the bytes of the hashes, and both
ends work on whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays, byte planes apart (so that high bytes compress), under zstd."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    body = b"".join(planes)
    head = np.array([len(body), len(arrays)] + [len(a) for a in arrays], np.int64).tobytes() + "".join(a.dtype.str.ljust(8) for a in arrays).encode()
    return head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack(blob: bytes) -> list[np.ndarray]:
    size, count = np.frombuffer(blob, np.int64, 2)
    lengths = np.frombuffer(blob, np.int64, int(count), 16)
    at = 16 + 8 * int(count)
    kinds = [np.dtype(blob[at + 8 * i:at + 8 * i + 8].decode().strip()) for i in range(int(count))]
    body = pa.decompress(blob[at + 8 * int(count):], int(size), codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for n, kind in zip(lengths, kinds):
        n = int(n)
        raw = np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T
        out.append(np.ascontiguousarray(raw).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of the 64-bit hash space each hash is in, by its top 24 bits."""
    return (((hashes >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int32)
